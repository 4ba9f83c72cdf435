"""Exact medians by radix selection.

``median``/``percentile`` keep a value->count map per group and merge all maps
of a global aggregate in one final task, so their memory grows with the number
of distinct values. Here no value is shuffled or sorted: the order-preserving bits of a
double are taken ``DIGIT`` at a time, most significant first. A pass counts the rows of each
digit (a partial aggregate of at most 2**DIGIT rows), the counts name the digit that holds the
wanted rank, and the next pass reads only the rows within the least and greatest value of that
digit, a range that is pushed to the scan. A digit with a single value ends the search, at
the latest after 64 bits; once no more than 2**DIGIT rows are left, a pass
counts their values instead of digits, and is the last. The passes run when a median is
asked for; the driver receives at most 2**DIGIT counts for each open rank. What is above them (joins, parsed
text) is run once: the values are kept on the executors, in memory or on disk, until the median is found.

The result equals the interpolated median (pandas ``median``, Spark ``percentile(x, 0.5)``):
lo + (hi - lo) * 0.5 over the two middle values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numeric import nan_to_null

#: Bits of a digit.
DIGIT = 16
#: Smaller absolute values have no leading bit of their own.
LEAST_NORMAL = 2.0 ** -1022


def _pow2(n: Column) -> Column:
    return F.pow(F.lit(2.0), n)


def with_ordered_bits(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the bits of a double as a long of the same order; both zeros are 0.

    Exponent and mantissa come from a logarithm, whose last digit may be off by
    one place next to a power of two; the mantissa tells, and corrects it. The steps are
    projections of their own, so that none is computed twice.
    """
    size, near, half, scaled = F.abs(F.col(column)), F.col("_near"), F.col("_half"), F.col("_scaled")
    steps = (df.withColumn("_near", F.floor(F.log2(size)))
             .withColumn("_half", F.floor((F.lit(52) - near) / 2))
             .withColumn("_scaled", size * _pow2(half) * _pow2(F.lit(52) - near - half)))
    one = F.lit(1 << 52)
    usual = (F.when(scaled < float(1 << 52), (near + 1021) * one + (scaled * 2).try_cast("long"))
             .when(scaled >= float(1 << 53), (near + 1023) * one + (scaled / 2).try_cast("long"))
             .otherwise((near + 1022) * one + scaled.try_cast("long")))
    bits = (F.when(size < LEAST_NORMAL, (size * float(2 ** 537) * float(2 ** 537)).try_cast("long"))
            .when(size == float("inf"), F.lit(2047 << 52)).otherwise(usual))
    return steps.withColumn(name, bits).withColumn(name, F.when(F.col(column) < 0, -F.col(name)).otherwise(F.col(name))).drop(
        "_near", "_half", "_scaled")


@dataclass
class _Target:
    """A wanted rank: how many values of the digits found so far come before it."""
    subset: str
    rank: int
    prefix: int | None = None
    left: int = 0
    low: float | None = None
    high: float | None = None

    def open(self) -> bool:
        return self.prefix is None or self.low != self.high


def medians(df: DataFrame, value: Column | str, subsets: dict[str, Column], digit: int = DIGIT,
            weight: str | None = None, keep: bool = True) -> dict[str, float | None]:
    """The exact median of the non-null values over each row subset, all from the same passes.
    A row counts ``weight`` times (a column of whole numbers above zero), or once. ``keep=False``:
    ``df`` is kept already."""
    col = F.col(value) if isinstance(value, str) else value
    flags = {f"_in{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(subsets.values())}
    values = df.select(col.cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"), *[c.alias(k) for k, c in flags.items()])
    if not keep:
        return _medians(values, subsets, list(flags), digit)
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _medians(values, subsets, list(flags), digit)
    finally:
        values.unpersist()


def _medians(values: DataFrame, subsets: dict[str, Column], flags: list[str], digit: int) -> dict[str, float | None]:
    rows = values.where("v IS NOT NULL AND NOT isnan(v)")
    targets: list[_Target] = []
    depth = 0
    while depth < 64 and (not depth or any(t.open() for t in targets)):
        step = min(digit, 64 - depth)
        wanted = [t for t in targets if t.open()]
        # few enough rows to count their values themselves
        last = bool(targets) and sum({t.prefix: t.left for t in wanted}.values()) <= 1 << digit
        step, depth = (64 - depth, 64) if last else (step, depth + step)
        near = rows
        if targets:
            bounds = {(t.low, t.high) for t in wanted}
            within = F.lit(False)
            for low, high in bounds:
                within = within | F.col("v").between(low, high)
            near = rows.where(within)
        counted = with_ordered_bits(near, "v", "bits").groupBy(F.shiftright("bits", 64 - depth).alias("prefix")).agg(
            F.sum("w").alias("rows"),
            *[c for k in flags for c in (F.sum(F.when(F.col(k), F.col("w")).otherwise(0)).alias(f"n{k}"), F.min(F.when(F.col(k), F.col("v"))).alias(f"low{k}"),
                                               F.max(F.when(F.col(k), F.col("v"))).alias(f"high{k}"))])
        histogram = sorted(counted.collect(), key=lambda r: r.prefix)  # at most 2**DIGIT rows for every open rank
        if not targets:
            for k in flags:
                n = sum(r[f"n{k}"] for r in histogram)
                if n:
                    targets += [_Target(k, (n - 1) // 2), _Target(k, n // 2)]
            wanted = targets
        for t in wanted:
            own = [r for r in histogram if t.prefix is None or r.prefix >> step == t.prefix]
            for r in own:
                n = r[f"n{t.subset}"]
                if t.rank < n:
                    t.prefix, t.left, t.low, t.high = r.prefix, r.rows, r[f"low{t.subset}"], r[f"high{t.subset}"]
                    break
                t.rank -= n
    found = {}
    for name, k in zip(subsets, flags):
        pair = [t.low for t in targets if t.subset == k]
        found[name] = pair[0] + (pair[1] - pair[0]) * 0.5 if pair else None
    return found


def median(df: DataFrame, value: Column | str, weight: str | None = None, keep: bool = True) -> float | None:
    """The exact median of the non-null values, None if there are none."""
    return medians(df, value, {"median": F.lit(True)}, weight=weight, keep=keep)["median"]


def median_column(df: DataFrame, value: Column | str) -> Column:
    return F.lit(median(df, value)).cast("double")


def median_frame(df: DataFrame, value: Column | str, alias: str = "median", approx: bool = False,
                 accuracy: int = 10000) -> DataFrame:
    """One-row DataFrame ``[alias]``: exact median of the non-null values (NULL if none).

    ``approx=True`` opts into ``percentile_approx`` (a value of the data within
    rank error n/accuracy, no interpolation): one pass, fixed memory per task.
    """
    if approx:
        col = F.col(value) if isinstance(value, str) else value
        return df.agg(F.percentile_approx(nan_to_null(col.cast("double")), 0.5, accuracy).alias(alias))
    return df.sparkSession.createDataFrame([(median(df, value),)], f"`{alias}` double")
