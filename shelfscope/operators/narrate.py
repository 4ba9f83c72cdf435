"""Recommendation lines, explanation and data overview.

All three are built from one-row frames (the shared ``metrics_row`` scan and
the best/worst category pick), so the text work is constant-size; the scans
underneath are ordinary partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.text import fmt_plain, money
from shelfscope.operators import category, metrics, schema

# Text templates.
FALLBACK = "Your data looks good! Upload more data for detailed insights."
EXPLANATION_HEAD = [
    "How suggestions are generated:",
    "• Ratings: We flag low-rated products (<3.0) because they usually drive returns or poor reviews.",
    "• Discounts vs Ratings: High discounts with low ratings often indicate quality or expectation gaps.",
    "• Price Anchor: We find the median price of high-rated products to suggest a strong pricing band.",
    "• Category Performance: We compare average ratings per category to spot winners and underperformers.",
]
EXPLANATION_BASIS = {
    "sales_volume": "• Top sellers are derived from the synthetic sales volume model based on rating, price, and discount.",
    "review_count": "• Top sellers are inferred from review counts (as a proxy for demand).",
    "unavailable": "• Top sellers are unavailable because no sales or review signals were found.",
}


def _basis(columns: list[str], incomplete: Column) -> Column:
    """M7 as data: ``sales_volume`` when the input has it or the synthetic volume
    can be built for every row (``incomplete`` == 0), else ``review_count``,
    else ``unavailable``."""
    if schema.resolve(columns, schema.PRODUCT) is None:
        return F.lit("unavailable")  # no product column, so no sellers to rank
    fallback = F.lit("review_count" if "review_count" in columns else "unavailable")
    if "sales_volume" in columns:
        return F.lit("sales_volume")
    price = schema.resolve(columns, schema.PRICE)
    if price and "rating" in columns and "discount_percentage" in columns:
        return F.when(incomplete == 0, F.lit("sales_volume")).otherwise(fallback)
    return fallback


def basis_column(df: DataFrame) -> Column:
    """The sales basis as an aggregate expression over ``df`` (one-row result)."""
    cols = df.columns
    if "rating" in cols and "discount_percentage" in cols:
        incomplete = F.count_if(F.col("rating").isNull() | F.col("discount_percentage").isNull())
    else:
        incomplete = F.lit(1)
    return _basis(cols, incomplete)


def _lines(row: DataFrame, lines: list[Column], fallback: str | None) -> DataFrame:
    # lines become plain columns first: subqueries may not sit inside a lambda
    named = row.select(*[line.alias(f"l{i}") for i, line in enumerate(lines)])
    arr = F.filter(F.array(*[F.col(f"l{i}") for i in range(len(lines))]), lambda x: x.isNotNull())
    if fallback is not None:
        arr = F.when(F.size(arr) == 0, F.array(F.lit(fallback))).otherwise(arr)
    return (named.select(F.posexplode(arr).alias("pos", "line"))
            .select((F.col("pos") + 1).cast("int").alias("position"), "line"))


def recommendations(df: DataFrame, basis: str | None = None) -> DataFrame:
    """Ordered recommendation lines (position, line)."""
    cols = df.columns
    m = metrics.metrics_row(df)
    # the basis comes from the same metrics row: no extra scan
    m = m.withColumn("basis", _basis(cols, F.col("n_incomplete")) if basis is None else F.lit(basis))
    has_r, has_d = "rating" in cols, "discount_percentage" in cols
    lines = []
    if has_r:
        lines.append(F.when(F.col("n_low_rated") > 0, F.concat(
            F.col("n_low_rated").cast("string"),
            F.lit(" products have low ratings (<3.0). Improve quality, listings, or consider discontinuation."))))
    if has_r and has_d:
        lines.append(F.when(F.col("n_discount_gap") > 0, F.concat(
            F.col("n_discount_gap").cast("string"),
            F.lit(" products have high discount but low rating. Review quality or positioning."))))
    if has_r and schema.resolve(df, schema.PRICE):
        lines.append(F.when(F.col("n_high_rated") > 0, F.concat(
            F.lit("Price anchor: high-rated products cluster around "), money(F.col("price_anchor")),
            F.lit(". Keep new launches near this band."))))
    if has_r and "category" in cols:
        bw = category.best_worst_category(df)
        best, worst = bw.select("best_category").scalar(), bw.select("worst_category").scalar()
        lines.append(F.concat(F.lit("Best performing category: "), best))
        lines.append(F.concat(F.lit("Category needing improvement: "), worst))
    lines.append(F.when(F.col("basis") != "unavailable", F.concat(
        F.lit("Top sellers are based on "), F.col("basis"),
        F.lit(". Use these items for bundles, ads, and cross-sell placement."))))
    return _lines(m, lines, FALLBACK)


def insights_explanation(df: DataFrame) -> DataFrame:
    """R2: the fixed header lines plus the line for the table's sales basis."""
    row = df.agg(basis_column(df).alias("basis"))
    basis_line = F.coalesce(*[F.when(F.col("basis") == k, F.lit(v))
                              for k, v in EXPLANATION_BASIS.items()])
    return _lines(row, [F.lit(x) for x in EXPLANATION_HEAD] + [basis_line], None)


def overview_column(columns: list[str]) -> Column:
    """R3 text from a ``metrics_row`` frame of a table with these columns."""
    lines = [F.concat(F.lit("Data Overview: "), F.col("n_rows").cast("string"),
                      F.lit(" products analyzed"))]
    if "category" in columns:
        lines.append(F.concat(F.lit("Categories: "), F.col("n_categories").cast("string"),
                              F.lit(" unique categories")))
    if schema.resolve(columns, schema.PRICE):
        lines.append(F.concat(F.lit("Price Range: "), money(F.col("min_price")), F.lit(" - "),
                              money(F.col("max_price"))))
        lines.append(F.concat(F.lit("Average Price: "), money(F.col("avg_price"))))
    if "rating" in columns:
        lines.append(F.concat(F.lit("Average Rating: "), fmt_plain(F.col("avg_rating"), 1), F.lit("/5")))
    if "discount_percentage" in columns:
        lines.append(F.concat(F.lit("Average Discount: "), fmt_plain(F.col("avg_discount"), 1),
                              F.lit("%")))
    return F.concat_ws("\n", *lines)


def general_insights(df: DataFrame) -> DataFrame:
    """The overview text (one row, ``text``); lines for missing roles are left out."""
    return metrics.metrics_row(df).select(overview_column(df.columns).alias("text"))


__all__ = ["recommendations", "insights_explanation", "general_insights", "overview_column",
           "basis_column"]
