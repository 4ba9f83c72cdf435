"""Per-category aggregates.

Each is one ``groupBy(category)`` (partial aggregation before the shuffle, so
a hot category costs one row per task), and top-k reports end in
``orderBy(...).limit(k)``, which plans as TakeOrderedAndProject: every task
keeps its own k best and only those meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import exact
from shelfscope.operators import schema
from shelfscope.operators.schema import requires


def _by_category(df: DataFrame, *figures: exact.Figure) -> DataFrame:
    # pandas groupby drops NULL keys; Spark would keep them.
    return exact.aggregate(df.where(F.col("category").isNotNull()), ["category"], figures)


@requires("category string, revenue double", "category", schema.PRICE)
def category_revenue(df: DataFrame, n: int | None = 5, price_col: str | None = None) -> DataFrame:
    """Sum of price per category (quantity ignored), largest first."""
    price = price_col or schema.resolve(df, schema.PRICE)
    out = _by_category(df, exact.total(df, price, "revenue", default=0.0))
    out = out.orderBy(F.col("revenue").desc(), F.col("category"))
    return out.limit(n) if n else out


@requires("category string, avg_rating double", "category", "rating")
def category_rating(df: DataFrame, n: int | None = 5) -> DataFrame:
    """A3: mean rating per category, highest first (NULL means last)."""
    out = _by_category(df, exact.mean(df, "rating", "avg_rating"))
    out = out.orderBy(F.col("avg_rating").desc_nulls_last(), F.col("category"))
    return out.limit(n) if n else out


def category_mean_by_name(df: DataFrame, column: str, alias: str, n: int | None = 10) -> DataFrame:
    """A4/A5: mean of ``column`` for the first n categories by name (not by value)."""
    out = _by_category(df, exact.mean(df, column, alias)).orderBy("category")
    return out.limit(n) if n else out


@requires("category string, avg_price double", "category", schema.PRICE)
def avg_price_by_category(df: DataFrame, n: int | None = 10) -> DataFrame:
    return category_mean_by_name(df, schema.resolve(df, schema.PRICE), "avg_price", n)


@requires("category string, avg_discount double", "category", "discount_percentage")
def avg_discount_by_category(df: DataFrame, n: int | None = 10) -> DataFrame:
    return category_mean_by_name(df, "discount_percentage", "avg_discount", n)


@requires("best_category string, worst_category string", "category", "rating")
def best_worst_category(df: DataFrame) -> DataFrame:
    """Categories with the highest and lowest mean rating; ties go to the
    first name. One row, or none when no category has a rating."""
    means = _by_category(df, exact.mean(df, "rating", "m")).where("m IS NOT NULL")
    # min over (-mean, name) picks the highest mean and, on a tie, the first name.
    picked = means.agg(F.min(F.struct((-F.col("m")).alias("k"), F.col("category"))).alias("best"),
                       F.min(F.struct(F.col("m").alias("k"), F.col("category"))).alias("worst"),
                       F.count(F.lit(1)).alias("n"))
    return picked.where("n > 0").select(F.col("best.category").alias("best_category"),
                                        F.col("worst.category").alias("worst_category"))


@requires("category string, avg_rating double, n long", "category", "rating")
def category_top_rating_with_count(df: DataFrame, n: int = 3) -> DataFrame:
    """Top n categories by mean rating with the category's row count."""
    out = _by_category(df, exact.mean(df, "rating", "avg_rating"), exact.count("n"))
    return out.orderBy(F.col("avg_rating").desc_nulls_last(), F.col("category")).limit(n)


@requires("category string, revenue double", "category", "price")
def category_top_revenue(df: DataFrame, n: int = 3) -> DataFrame:
    """As A2 with n rows, on the ``price`` column only."""
    return category_revenue(df, n, price_col="price")


@requires("category string", "category")
def category_list(df: DataFrame) -> DataFrame:
    """distinct non-empty categories, sorted."""
    c = F.col("category")
    return df.select(c).where(c.isNotNull() & (c != "")).distinct().orderBy(c)
