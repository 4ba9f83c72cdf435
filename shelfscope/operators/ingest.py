"""Normalisation: header fold, aliases, numeric coercion and median imputation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfscope.functions.numeric import to_number
from shelfscope.functions.quantile import median
from shelfscope.operators import schema

# Columns typed as numbers when present (by role). Others keep their input type.
IMPUTED = ["price", "rating"]
NUMERIC = ["discount_percentage", "selling_price", "cost_price", "quantity",
           "expenditure", "review_count", "sales_volume"]


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """``to_numeric(errors='coerce')`` on the named columns that exist."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    present = [c for c in columns if c in types]
    if not present:
        return df
    return df.withColumns({c: to_number(F.col(c), types[c]) for c in present})


def impute_median(df: DataFrame, columns: list[str],
                  all_null_fill: float | None = None) -> DataFrame:
    """NULLs of each column become the column's exact median.

    The median is one number, found when this is called (``functions.quantile``), so the
    table itself is never shuffled for it. The columns are made once for all their medians. With
    ``all_null_fill`` set, an all-NULL column is filled with that value.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    kept = df.select(*[F.col(c).cast("double").alias(c) for c in present]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = {c: median(kept, c, keep=False) for c in present}
    finally:
        kept.unpersist()
    fills = {}
    for c in present:
        med = F.lit(found[c]).cast("double")
        if all_null_fill is not None:
            med = F.coalesce(med, F.lit(float(all_null_fill)))
        fills[c] = F.coalesce(F.col(c), med)
    return df.withColumns(fills)


def normalize(df: DataFrame, strict: bool = True, impute: bool = True,
              all_null_fill: float | None = None) -> DataFrame:
    """Fold headers, rename aliases, coerce numeric roles, impute price and rating."""
    df = schema.apply_aliases(schema.fold_headers(df, strict))
    df = coerce_numeric(df, IMPUTED + NUMERIC)
    if impute:
        df = impute_median(df, IMPUTED, all_null_fill)
    return df


def null_na_words(df: DataFrame, na_words: list[str]) -> DataFrame:
    """Text cells equal to an NA word become NULL (string columns only)."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not strings:
        return df
    return df.withColumns({c: F.when(~F.col(c).isin(na_words), F.col(c)) for c in strings})
