"""A6 price bands and A8 segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.quantile import median_column
from shelfscope.operators import schema
from shelfscope.operators.schema import requires

# Right-closed price bins (lower, upper] and their labels.
BANDS = [
    (1, "Budget (<500)", 0.0, 500.0),
    (2, "Economy (500-1000)", 500.0, 1000.0),
    (3, "Standard (1000-2000)", 1000.0, 2000.0),
    (4, "Premium (2000-5000)", 2000.0, 5000.0),
    (5, "Luxury (5000-10000)", 5000.0, 10000.0),
    (6, "Ultra-Luxury (>10000)", 10000.0, float("inf")),
]

# Segment labels.
STAR = "Star Products (High Rating, High Price)"
GEM = "Hidden Gems (High Rating, Low Price)"
DECLINING = "Declining Products (Low Rating, High Price)"
DEAD = "Dead Weight (Low Rating, Low Price)"


def band_order(price) -> "F.Column":
    """Band number 1-6 of a price; NULL for price <= 0 or NULL."""
    p = price.cast("double")
    branches = [((p > lo) & (p <= hi), order) for order, _, lo, hi in BANDS]
    expr = reduce(lambda acc, b: acc.when(b[0], F.lit(b[1])), branches[1:],
                  F.when(branches[0][0], F.lit(branches[0][1])))
    return expr


def band_label(price) -> "F.Column":
    p = price.cast("double")
    first = BANDS[0]
    expr = F.when((p > first[2]) & (p <= first[3]), F.lit(first[1]))
    for _, label, lo, hi in BANDS[1:]:
        expr = expr.when((p > lo) & (p <= hi), F.lit(label))
    return expr


def with_price_band(df: DataFrame) -> DataFrame:
    price = schema.resolve(df, schema.PRICE)
    return df.withColumn("price_band", band_label(F.col(price)))


@requires("band_order int, price_band string, n long", schema.PRICE)
def price_bands(df: DataFrame) -> DataFrame:
    """Rows per band, all six bands listed (zero counts included), count desc.

    The data side is a 6-group aggregate (partial aggregation before its one
    shuffle); the band list is a constant 6-row dimension; the join broadcasts
    the aggregated counts, which are bounded by the number of bands.
    """
    price = schema.resolve(df, schema.PRICE)
    spark = df.sparkSession
    counts = (df.select(band_order(F.col(price)).alias("band_order"))
              .where("band_order IS NOT NULL").groupBy("band_order")
              .agg(F.count(F.lit(1)).alias("n")))
    dim = spark.createDataFrame([(o, label) for o, label, _, _ in BANDS],
                                "band_order int, price_band string")
    # counts has at most six rows (one per band), so it is the side to broadcast
    return (dim.join(F.broadcast(counts), "band_order", "left")
            .select("band_order", "price_band", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy(F.col("n").desc(), "band_order"))


@requires("segment string, n long", "rating", schema.PRICE)
def segmentation(df: DataFrame) -> DataFrame:
    """Four segments by rating (>=4 high, <3 low) and price against the exact
    median (> high, <= low). Always four rows."""
    price = schema.resolve(df, schema.PRICE)
    p, r = F.col(price).cast("double"), F.col("rating")
    med = median_column(df, price)
    hi_r, lo_r = r >= 4.0, r < 3.0
    hi_p, lo_p = p > med, p <= med
    flags = df.select((hi_r & hi_p).alias("star"), (hi_r & lo_p).alias("gem"),
                      (lo_r & hi_p).alias("declining"), (lo_r & lo_p).alias("dead"))
    counts = flags.agg(*[F.count_if(F.col(k)).alias(k)
                         for k in ("star", "gem", "declining", "dead")])
    return counts.select(F.explode(F.array(
        F.struct(F.lit(STAR).alias("segment"), F.col("star").alias("n")),
        F.struct(F.lit(GEM).alias("segment"), F.col("gem").alias("n")),
        F.struct(F.lit(DECLINING).alias("segment"), F.col("declining").alias("n")),
        F.struct(F.lit(DEAD).alias("segment"), F.col("dead").alias("n")),
    )).alias("s")).select("s.segment", "s.n")
