"""The grouped figures of a whole analysis from one aggregate.

The table is read once (and once more for each pass of the price median) and grouped by category and price band.
The states of these few groups merge into the table-wide, per-category and per-band figures, so A1-A8 and
A16-A20 cost one shuffle of at most one row for each category and band of a task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import exact
from shelfscope.functions.quantile import median
from shelfscope.operators import bands, metrics, schema


class FusedFigures:
    """The grouped states of a table, and every insight that is made from them.

    A column that the table lacks leaves out the insights that need it, as the
    single operators do. ``with_median=False`` leaves out what needs the median price.
    """

    KEYS = ["category", "band"]

    def __init__(self, df: DataFrame, keep: bool = True, with_median: bool = True) -> None:
        self.spark = df.sparkSession
        price = schema.resolve(df, schema.PRICE)
        self.has = {"price": price is not None, "rating": "rating" in df.columns,
                    "discount": "discount_percentage" in df.columns, "category": "category" in df.columns,
                    "own_price": "price" in df.columns}
        none = F.lit(None)
        base = df.select(
            (F.col("category") if self.has["category"] else none.cast("string")).alias("category"),
            (bands.band_order(F.col(price)) if price else none.cast("int")).alias("band"),
            (F.col(price) if price else none.cast("double")).alias("price"),
            (F.col("rating") if self.has["rating"] else none.cast("double")).alias("rating"),
            (F.col("discount_percentage") if self.has["discount"] else none.cast("double")).alias("discount"))
        self.median_price = median(df, price) if price and with_median else None
        p, r, d = F.col("price").cast("double"), F.col("rating"), F.col("discount")
        hot = d > metrics.HIGH_DISCOUNT
        self.figures = {f.name: f for f in (
            exact.count("n"), exact.count("n_hot", hot), exact.mean(base, F.when(hot, r), "hot_rating"),
            exact.total(base, "price", "revenue", default=0.0),
            *(f(base, c, f"avg_{c}") for c in ("price", "rating", "discount") for f in (exact.mean,)),
            *(f(F.col(c), f"{k}_{c}") for c in ("price", "rating", "discount") for k, f in (("min", exact.least), ("max", exact.most))),)}
        if with_median:
            dear, well, badly = p > F.lit(self.median_price), r >= 4.0, r < 3.0
            self.figures |= {f.name: f for f in (
                exact.count("star", well & dear), exact.count("gem", well & (p <= F.lit(self.median_price))),
                exact.count("declining", badly & dear), exact.count("dead", badly & (p <= F.lit(self.median_price))))}
        self.base = base
        rows = exact.states(base, self.KEYS, list(self.figures.values()))
        self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK) if keep else rows

    def _of(self, keys: list[str], *names: str, rows: DataFrame | None = None) -> DataFrame:
        figures = [self.figures[n] for n in names]
        return exact.finished(exact.merged(self.rows if rows is None else rows, keys, figures), keys, figures)

    def _by_category(self, *names: str) -> DataFrame:
        return self._of(["category"], *names, rows=self.rows.where("category IS NOT NULL"))

    def insights(self) -> dict[str, DataFrame]:
        """A1-A8 and A16-A20 by name, equal to the operators of the same names."""
        out = {"kpis": self._kpis()}
        both = self.has["category"] and self.has["price"]
        if both:
            out["top_categories_by_revenue"] = self._revenue(5)
            if self.has["own_price"]:
                out["category_top3_revenue"] = self._revenue(3)
            out["avg_price_by_category"] = self._by_category("avg_price").orderBy("category").limit(10)
        if self.has["category"] and self.has["rating"]:
            best = [F.col("avg_rating").desc_nulls_last(), F.col("category")]
            out["top_categories_by_rating"] = self._by_category("avg_rating").orderBy(*best).limit(5)
            out["category_top3_rating"] = self._by_category("avg_rating", "n").orderBy(*best).limit(3)
        if self.has["category"] and self.has["discount"]:
            out["avg_discount_by_category"] = self._by_category("avg_discount").orderBy("category").limit(10)
        if self.has["price"]:
            out["price_bands"] = self._bands()
            out["price_profile"] = self._of([], "avg_price", "min_price", "max_price").select(
                "avg_price", F.lit(self.median_price).cast("double").alias("median_price"), "min_price", "max_price")
            if self.has["rating"]:
                out["segmentation"] = self._segments()
        if self.has["discount"]:
            out["discount_profile"] = self._of([], "avg_discount", "max_discount", "min_discount")
            if self.has["rating"]:
                out["high_discount_rating"] = self._of([], "n_hot", "hot_rating").select(
                    F.when(F.col("n_hot") == 0, F.lit(0.0)).otherwise(F.col("hot_rating")).alias("high_discount_avg_rating"))
        if self.has["rating"]:
            out["rating_profile"] = self._of([], "avg_rating", "max_rating", "min_rating").toDF(
                "avg_rating", "best_rating", "worst_rating")
        return out

    def _kpis(self) -> DataFrame:
        names = ["n", "avg_price", "avg_discount", "avg_rating"]
        figures = [self.figures[n] for n in names]
        state = exact.merged(self.rows, [], figures, F.countDistinct("category").alias("total_categories"))
        one = exact.finished(state, [], figures, "total_categories")
        shown = [(F.col(n) if self.has[n[4:]] else F.lit(0.0)).alias(n) for n in ("avg_price", "avg_discount", "avg_rating")]
        return one.select(F.col("n").alias("total_products"), "total_categories", *shown)

    def _revenue(self, n: int) -> DataFrame:
        return self._by_category("revenue").orderBy(F.col("revenue").desc(), "category").limit(n)

    def _bands(self) -> DataFrame:
        counts = self._of(["band"], "n", rows=self.rows.where("band IS NOT NULL")).withColumnRenamed("band", "band_order")
        names = self.spark.createDataFrame([(o, label) for o, label, _, _ in bands.BANDS], "band_order int, price_band string")
        # at most six rows
        return (names.join(F.broadcast(counts), "band_order", "left").select("band_order", "price_band", F.coalesce("n", F.lit(0)).alias("n"))
                .orderBy(F.col("n").desc(), "band_order"))

    def _segments(self) -> DataFrame:
        labels = {"star": bands.STAR, "gem": bands.GEM, "declining": bands.DECLINING, "dead": bands.DEAD}
        return self._of([], *labels).select(F.explode(F.array(*[
            F.struct(F.lit(label).alias("segment"), F.col(k).alias("n")) for k, label in labels.items()])).alias("s")).select("s.*")


def long_table(parts: dict[str, DataFrame]) -> DataFrame:
    """(insight, label, figure, value) of several insights: text columns name a row, numbers are its figures."""
    out = None
    for name, df in sorted(parts.items()):
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        numbers = [c for c in df.columns if c not in texts and c != "band_order"]
        rows = df.select(F.lit(name).alias("insight"), (F.col(texts[0]) if texts else F.lit("")).alias("label"),
                         F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("f"))
        rows = rows.select("insight", "label", "f.figure", "f.value")
        out = rows if out is None else out.unionByName(rows)
    return out
