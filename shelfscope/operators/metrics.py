"""Table-wide figures, each a single global aggregate.

Global aggregates run as partial aggregation in every task followed by one
tiny merge, so they scale with the scan, not with any key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import exact
from shelfscope.functions.quantile import median_column, median_frame, medians
from shelfscope.operators import schema
from shelfscope.operators.schema import requires

LOW_RATING = 3.0
HIGH_RATING = 4.0
HIGH_DISCOUNT = 30.0
GAP_RATING = 3.5


def kpis(df: DataFrame) -> DataFrame:
    """A1: row count, distinct categories, mean price / discount / rating (0 when absent)."""
    price = schema.resolve(df, schema.PRICE)
    def mean(column: str | None, name: str) -> exact.Figure:
        return exact.mean(df, column, name) if column in df.columns else exact.fixed(F.lit(0.0), name)

    return exact.aggregate(df, [], [
        exact.count("total_products"),
        exact.distinct("category", "total_categories") if "category" in df.columns
        else exact.fixed(F.lit(0).cast("long"), "total_categories"),
        mean(price, "avg_price"), mean("discount_percentage", "avg_discount"), mean("rating", "avg_rating"),
    ])


@requires(None, "rating")
def low_rated(df: DataFrame) -> DataFrame:
    """F1: rows rated below 3.0."""
    return df.where(F.col("rating") < LOW_RATING)


@requires(None, "discount_percentage", "rating")
def discount_rating_gap(df: DataFrame) -> DataFrame:
    """discount above 30 and rating below 3.5."""
    return df.where((F.col("discount_percentage") > HIGH_DISCOUNT) & (F.col("rating") < GAP_RATING))


@requires("high_discount_avg_rating double", "discount_percentage", "rating")
def high_discount_rating(df: DataFrame) -> DataFrame:
    """Mean rating of rows with discount > 30; 0 when there is no such row."""
    hot = F.col("discount_percentage") > HIGH_DISCOUNT
    found = exact.aggregate(df, [], [exact.count("n", hot), exact.mean(df, F.when(hot, F.col("rating")), "m")])
    return found.select(F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("m")).alias("high_discount_avg_rating"))


@requires("price_anchor double", schema.PRICE, "rating")
def price_anchor(df: DataFrame) -> DataFrame:
    """Exact median price of rows rated 4.0 or more (NULL when none)."""
    price = schema.resolve(df, schema.PRICE)
    return median_frame(df.where(F.col("rating") >= HIGH_RATING), price, alias="price_anchor")


@requires("avg_discount double, max_discount double, min_discount double", "discount_percentage")
def discount_profile(df: DataFrame) -> DataFrame:
    """A16."""
    d = F.col("discount_percentage")
    return exact.aggregate(df, [], [exact.mean(df, d, "avg_discount"), exact.most(d, "max_discount"),
                                    exact.least(d, "min_discount")])


@requires("avg_rating double, best_rating double, worst_rating double", "rating")
def rating_profile(df: DataFrame) -> DataFrame:
    """A17."""
    r = F.col("rating")
    return exact.aggregate(df, [], [exact.mean(df, r, "avg_rating"), exact.most(r, "best_rating"),
                                    exact.least(r, "worst_rating")])


@requires("avg_price double, median_price double, min_price double, max_price double", schema.PRICE)
def price_profile(df: DataFrame) -> DataFrame:
    """Mean, exact median, min and max of the price role."""
    price = schema.resolve(df, schema.PRICE)
    p = F.col(price)
    med = median_column(df, price)
    return exact.aggregate(df, [], [exact.mean(df, p, "avg_price"), exact.least(p, "min_price"), exact.most(p, "max_price")]) \
        .select("avg_price", med.alias("median_price"), "min_price", "max_price")


def metrics_row(df: DataFrame, with_medians: bool = True) -> DataFrame:
    """One scan, one row: every table-wide figure used by narration and answers.

    Missing columns give NULL figures; ``has_*`` flags say which roles exist.
    ``with_medians=False`` leaves the two medians NULL and skips their pass.
    """
    cols = df.columns
    price = schema.resolve(df, schema.PRICE)
    has_rating, has_disc = "rating" in cols, "discount_percentage" in cols
    has_cat = "category" in cols
    none = F.lit(None).cast("double")
    r = F.col("rating") if has_rating else none
    d = F.col("discount_percentage") if has_disc else none
    p = F.col(price) if price else none
    def profile(c, there: bool, name: str) -> list[exact.Figure]:
        names = [f"{k}_{name}" for k in ("avg", "min", "max")]
        if not there:
            return [exact.fixed(none, n) for n in names]
        return [exact.mean(df, c, names[0]), exact.least(c, names[1]), exact.most(c, names[2])]

    row = exact.aggregate(df, [], [
        exact.count("n_rows"),
        exact.distinct("category", "n_categories") if has_cat else exact.fixed(F.lit(None).cast("long"), "n_categories"),
        *profile(p, price is not None, "price"), *profile(r, has_rating, "rating"), *profile(d, has_disc, "discount"),
        exact.count("n_low_rated", r < LOW_RATING),
        exact.count("n_discount_gap", (d > HIGH_DISCOUNT) & (r < GAP_RATING)),
        exact.count("n_high_rated", r >= HIGH_RATING),
        # rows that stop the synthetic sales volume (decides the sales basis)
        exact.count("n_incomplete", r.isNull() | d.isNull()),
    ])
    flags = {"has_price": F.lit(price is not None), "has_rating": F.lit(has_rating),
             "has_discount": F.lit(has_disc), "has_category": F.lit(has_cat),
             "price_is_price": F.lit(price == "price")}
    if price and with_medians:
        # both medians come from the same passes over the price values
        subsets = {"median_price": F.lit(True)}
        if has_rating:
            subsets["price_anchor"] = F.col("rating") >= HIGH_RATING
        found = medians(df, price, subsets)
        flags["median_price"] = F.lit(found["median_price"]).cast("double")
        flags["price_anchor"] = F.lit(found.get("price_anchor")).cast("double")
    else:
        flags["median_price"] = none
        flags["price_anchor"] = none
    return row.withColumns(flags)
