"""Global ranks without a single-partition window.

A global running count (``row_number() over (order by x)``) would pull every
row into one task. Here rows are range-partitioned on the order key, each
range is ranked by its own window, and ranges learn their starting offset from
a table with one row per range (a count fixed by configuration, not by the
data). Used for exact medians and for dense codes of sorted distinct values.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_count(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def range_ranked(df: DataFrame, key: str, weight: Column | None = None,
                 ranges: int | None = None, weights: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``df`` (one per distinct ``key`` expected) with ``start``/``end``:
    the global positions, in ``key`` order, covered by the row's ``weight``
    (default 1), plus ``n``, the total weight. Positions are 0-based, ``end``
    exclusive.

    With ``weights={name: column}`` several independent rankings share the one
    range pass: columns ``start_<name>``, ``end_<name>`` and ``n_<name>``.

    The range exchange feeds both the per-range totals and the ranked rows, which
    need the same columns of it; Spark reuses that one exchange, so both see the same
    range bounds. Columns beside the key are joined back afterwards.
    """
    named = weights if weights is not None else {
        "": weight if weight is not None else F.lit(1).cast("long")}
    tag = {k: (f"_{k}" if k else "") for k in named}
    n_ranges = ranges or range_count(df)
    payload = [c for c in df.columns if c != key]
    weighted = df.withColumns({f"_w{tag[k]}": w for k, w in named.items()})
    # only the key and its weights are ranked, so that both readers of the ranges want the
    # same columns and share one exchange; other columns come back by a join on the key
    ranged = (weighted.select(key, *[f"_w{tag[k]}" for k in named])
              .repartitionByRange(n_ranges, key)
              .withColumn("_r", F.spark_partition_id()))
    if df.sparkSession.conf.get("spark.sql.exchange.reuse", "true").lower() == "false":
        # without exchange reuse each branch would sample its own range bounds;
        # a shared cached relation gives both branches the same partitions
        ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
    per_range = ranged.groupBy("_r").agg(*[F.sum(f"_w{tag[k]}").alias(f"_rw{tag[k]}") for k in named])
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offset_cols = []
    for k in named:
        t = tag[k]
        offset_cols.append(F.coalesce(F.sum(f"_rw{t}").over(before), F.lit(0)).alias(f"_off{t}"))
        offset_cols.append(F.sum(f"_rw{t}").over(every).alias(f"n{t}"))
    offsets = per_range.select("_r", *offset_cols)
    upto = Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_r")  # one row per range: bounded
    for k in named:
        t = tag[k]
        out = (out.withColumn(f"end{t}", F.col(f"_off{t}") + F.sum(f"_w{t}").over(upto))
               .withColumn(f"start{t}", F.col(f"end{t}") - F.col(f"_w{t}")))
    out = out.drop("_r", *[f"_off{tag[k]}" for k in named], *[f"_w{tag[k]}" for k in named])
    return df.join(out, key) if payload else out


def dense_codes(df: DataFrame, column: str, alias: str = "code") -> DataFrame:
    """Distinct non-null values of ``column`` with their 0-based position in
    sorted order (as double, like a fitted string index)."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return range_ranked(distinct, column).select(column, F.col("start").cast("double").alias(alias))
