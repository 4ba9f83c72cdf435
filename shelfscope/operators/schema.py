"""Header folding, alias renaming and role resolution (metadata only, no job)."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# Alias table, applied in this order; a rename happens only when the target
# name is not present yet.
ALIASES: list[tuple[str, str]] = [
    ("productname", "product_name"),
    ("name", "product_name"),
    ("categories", "category"),
    ("mrp", "price"),
    ("discount", "discount_percentage"),
    ("discount%", "discount_percentage"),
    ("user_rating", "rating"),
    ("reviews", "review_count"),
    ("transaction_id", "order_id"),
    ("invoice_no", "order_id"),
    ("cost", "cost_price"),
    ("buy_price", "cost_price"),
    ("sell_price", "selling_price"),
    ("qty", "quantity"),
    ("purchase_date", "order_date"),
    ("expense", "expenditure"),
    ("spend", "expenditure"),
]

# Role candidates: the first name present in the table wins.
PRICE = ["price", "selling_price"]
PRODUCT = ["product_name", "product", "item_name", "item", "sku"]
TRANSACTION = ["transaction_id", "order_id", "orderid", "invoice_no", "invoice",
               "bill_no", "basket_id", "txn_id"]
COST = ["cost_price", "cost", "buy_price", "buy", "purchase_price", "expenditure"]
SELL = ["selling_price", "sell_price", "price", "revenue", "sold_price"]
QUANTITY = ["quantity", "qty", "units_sold", "sold_units"]
EXPENDITURE = ["expenditure", "expense", "spend", "cost", "buy", "purchase_value"]
DATE = ["date", "order_date", "purchase_date", "invoice_date", "txn_date", "year"]
SALES = ["sales_volume", "review_count"]
# ---------------------------------------------------------------------------


class HeaderCollision(ValueError):
    """Two input headers fold to the same name."""


def fold_name(name: str, strict: bool = True) -> str:
    """Lower-case then strip; ``strict=False`` also joins inner spaces with ``_``
    and turns ``discount %`` into ``discount%``."""
    folded = name.lower().strip()
    if not strict:
        folded = re.sub(r"\s*%", "%", folded)
        folded = re.sub(r"\s+", "_", folded)
    return folded


def fold_headers(df: DataFrame, strict: bool = True) -> DataFrame:
    """Fold every header. Raises ``HeaderCollision`` on duplicates."""
    names = [fold_name(c, strict) for c in df.columns]
    seen: dict[str, str] = {}
    for original, folded in zip(df.columns, names):
        if folded in seen:
            raise HeaderCollision(
                f"headers {seen[folded]!r} and {original!r} both fold to {folded!r}")
        seen[folded] = original
    return df.toDF(*names)


def alias_map(columns: list[str]) -> dict[str, str]:
    """The renames the ordered alias table makes on these column names."""
    present = list(columns)
    renames: dict[str, str] = {}
    for old, new in ALIASES:
        if old in present and new not in present:
            present[present.index(old)] = new
            renames[old] = new
    return renames


def apply_aliases(df: DataFrame) -> DataFrame:
    renames = alias_map(df.columns)
    return df.withColumnsRenamed(renames) if renames else df


def resolve(df_or_columns, candidates: list[str]) -> str | None:
    """First candidate present, else None."""
    columns = df_or_columns.columns if isinstance(df_or_columns, DataFrame) else df_or_columns
    for name in candidates:
        if name in columns:
            return name
    return None


def requires(empty_schema: str | None, *needs):
    """Decorator: when a needed column or role (a name or a candidate list) is
    missing, return an empty result instead of failing, as the original does
    ({} / [] rather than an error). ``empty_schema=None`` keeps the input's
    columns with no rows (for row filters)."""
    def wrap(fn):
        @functools.wraps(fn)
        def run(df: DataFrame, *args, **kwargs):
            for need in needs:
                if resolve(df, need if isinstance(need, list) else [need]) is None:
                    if empty_schema is None:
                        return df.where(F.lit(False))
                    return df.sparkSession.createDataFrame([], empty_schema)
            return fn(df, *args, **kwargs)
        return run
    return wrap
