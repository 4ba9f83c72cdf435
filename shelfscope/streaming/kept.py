"""Insights that are kept up while rows arrive.

A micro-batch leaves two small tables in a folder: the whole-number parts of the grouped figures
(``functions.exact``) by category and price band, and the rows of each price by rating class, from which the median
price and the segments come. Parts of several batches add up exactly, so the figures after any number
of batches have the digits of one batch over all rows. A batch counts once the mark of its id is written, which is the
last step; a batch that comes again after its mark changes nothing, one that was cut short is written anew. A
compaction puts the batches so far into one; readers take the newest one and the batches after it.

One folder belongs to one checkpoint location, as batch ids are those of one stream.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfscope.functions import exact
from shelfscope.functions.quantile import median
from shelfscope.operators import bands
from shelfscope.plans.fused import FusedFigures
from shelfscope.sources import store


class _Figures(FusedFigures):
    """Insights from kept parts instead of a table."""

    def __init__(self, empty: DataFrame, groups: DataFrame, prices: DataFrame) -> None:
        super().__init__(empty, keep=False, with_median=False)
        self.prices = prices
        self.rows = exact.lifted(groups, self.KEYS, list(self.figures.values()))
        self.median_price = median(prices, "price", weight="n") if self.has["price"] else None

    def _segments(self) -> DataFrame:
        dear, cheap = F.col("price") > F.lit(self.median_price), F.col("price") <= F.lit(self.median_price)
        well, badly = F.col("class") == 1, F.col("class") == -1
        labels = ((bands.STAR, well, dear), (bands.GEM, well, cheap), (bands.DECLINING, badly, dear), (bands.DEAD, badly, cheap))
        counted = self.prices.agg(*[F.coalesce(F.sum(F.when(rated & priced, F.col("n"))), F.lit(0)).alias(f"n{i}")
                                    for i, (_, rated, priced) in enumerate(labels)])
        return counted.select(F.explode(F.array(*[F.struct(F.lit(label).alias("segment"), F.col(f"n{i}").alias("n"))
                                                  for i, (label, *_) in enumerate(labels)])).alias("s")).select("s.*")


class KeptInsights:
    """The kept parts of a stream of rows with the given (normalised) columns."""

    PARTS = ("groups", "prices")

    def __init__(self, spark: SparkSession, folder: str, columns: StructType) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.empty = spark.createDataFrame([], columns)

    def _marks(self) -> tuple[tuple[int, str] | None, list[int]]:
        """(id and folder of the newest compaction, ids of the batches after it)."""
        packed = max(((int(n.split("-")[0]), n) for n in store.names(self.spark, f"{self.folder}/packed")), default=None)
        after = packed[0] if packed else -1
        return packed, sorted(i for i in map(int, store.names(self.spark, f"{self.folder}/batches")) if i > after)

    def _parts(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        fused = FusedFigures(batch, keep=False, with_median=False)
        groups = exact.binned(fused.base, fused.KEYS, list(fused.figures.values()))
        rated = F.when(F.col("rating") >= 4.0, 1).when(F.col("rating") < 3.0, -1).otherwise(0)
        prices = fused.base.where("price IS NOT NULL").groupBy(F.col("price").cast("double").alias("price"), rated.alias("class")).agg(
            F.count(F.lit(1)).alias("n"))
        return groups, prices

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Add a micro-batch; for ``foreachBatch``."""
        packed, marked = self._marks()
        if batch_id in marked or (packed and batch_id <= packed[0]):
            return
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, part in zip(self.PARTS, self._parts(batch), strict=True):
                part.write.mode("overwrite").parquet(f"{self.folder}/{name}/{batch_id}")
        finally:
            batch.unpersist()
        store.put(self.spark, f"{self.folder}/batches/{batch_id}", "")

    def _kept(self) -> tuple[DataFrame, DataFrame]:
        packed, marked = self._marks()
        places = ([packed[1]] if packed else []) + marked
        out = []
        for name, part in zip(self.PARTS, self._parts(self.empty), strict=True):
            rows = part
            if packed:  # its sums may be of a wider type than those of a batch
                rows = rows.unionByName(self.spark.read.parquet(f"{self.folder}/{name}/{packed[1]}"))
            if marked:
                rows = rows.unionByName(self.spark.read.parquet(*[f"{self.folder}/{name}/{i}" for i in marked]))
            out.append(rows)
        if not places:
            return out[0], out[1]
        fused = FusedFigures(self.empty, keep=False, with_median=False)
        return (exact.rebinned(out[0], fused.KEYS, list(fused.figures.values())),
                out[1].groupBy("price", "class").agg(F.sum("n").alias("n")))

    def insights(self) -> dict[str, DataFrame]:
        """A1-A8 and A16-A20 over all batches that are marked, by name."""
        return _Figures(self.empty, *self._kept()).insights()

    def compact(self) -> None:
        """Put the marked batches into one, so that a reader opens few files. Their own folders stay for
        readers that have begun."""
        packed, marked = self._marks()
        if not marked:
            return
        name = f"{marked[-1]}-{uuid.uuid4().hex[:8]}"
        for part, rows in zip(self.PARTS, self._kept(), strict=True):
            rows.write.parquet(f"{self.folder}/{part}/{name}")
        store.put(self.spark, f"{self.folder}/packed/{name}", "")


def start(rows: DataFrame, kept: KeptInsights, checkpoint_location: str) -> StreamingQuery:
    """Keep the insights of a stream of normalised rows up; recovers from its checkpoint location."""
    return (rows.writeStream.foreachBatch(kept.update)
            .option("checkpointLocation", checkpoint_location).start())
