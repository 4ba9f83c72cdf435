"""The retail view over the TPC-H-style driver tables.

One row per ``lineitem``, inner-joined to ``part`` and ``orders``; see
FIXTURES.md section 3 for the column rules. The same rules, as SQL text, are
the oracle's view (``RETAIL_SQL``). Spark builds the view with the DataFrame
API so that Catalyst prunes columns and pushes filters into each scan: a query
that needs only price and category never reads ``orders`` columns other than
the join key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a lazy DataFrame of this session."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Lines of an order that a task joins and groups.
LINES_A_TASK = 250_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks among which the lines are dealt by order, so that a task's memory does not grow with the
    table (the count comes from the file footers). None: few enough for the session's own dealing."""
    tasks = math.ceil(table(spark, sf_dir, "lineitem").count() / LINES_A_TASK)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def retail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical retail columns derived from lineitem x part x orders.

    Join strategy is left to Catalyst/AQE: ``orders`` is as large as a quarter
    of ``lineitem`` and ``part`` grows with scale too, so neither is forced to
    broadcast; AQE turns a join into a broadcast only when the measured side
    is under ``spark.sql.autoBroadcastJoinThreshold``. A large table is dealt by order
    into ``line_tasks``, which the join and whatever groups by order then share. Where the
    session has fewer partitions than these, parts are dealt into as many, and the lines follow
    them if that join is no broadcast.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    tasks = line_tasks(spark, sf_dir)
    if tasks and tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        part = part.repartition(tasks, "p_partkey")
    lines = li.join(part, li.l_partkey == part.p_partkey)
    if tasks:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    price = (F.col("l_extendedprice") / F.lit(10.0)).cast("decimal(18,3)")
    cost = (price * (F.lit(6) + F.col("l_suppkey") % 7).cast("decimal(3,0)") / F.lit(10)) \
        .cast("decimal(18,4)")
    rating = F.lit(1.0) + ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3
                            + F.col("l_linenumber")) % 41) / F.lit(10.0)
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("p_name").alias("product_name"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 61 != 0, F.col("p_brand"))
         .alias("category"),
        price.alias("price"),
        (F.round(F.col("l_discount") * 100) * 5).cast("double").alias("discount_percentage"),
        F.when(F.col("l_orderkey") % 50 != 0, rating).alias("rating"),
        ((F.col("l_partkey") * 13 + F.col("l_orderkey")) % 97).alias("review_count"),
        F.col("l_quantity").cast("int").alias("quantity"),
        cost.alias("cost_price"),
        F.col("o_orderdate").alias("order_date"),
    )


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` on the executors' disks, for several passes over what is costly to join anew; freed at the end."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()


def materialize_view(spark: SparkSession, sf_dir: str, target: str,
                     files_per_partition: int | None = None) -> str:
    """Write the retail view once as Parquet under ``target`` (a shared folder,
    e.g. next to ``spark.checkpoint.dir``), so that repeated analyses read one
    table instead of re-joining lineitem, part and orders every time.

    Rows are clustered by order (``repartitionByRange`` + sort within files), so
    a basket's lines sit together and row-group statistics on ``order_id``
    stay tight; the write is one job, and a failed task is simply rerun.
    """
    view = retail_view(spark, sf_dir)
    n = files_per_partition or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (view.repartitionByRange(n, "order_id").sortWithinPartitions("order_id", "line_no")
     .write.mode("overwrite").parquet(target))
    return target


def read_materialized(spark: SparkSession, target: str) -> DataFrame:
    """The materialised retail view (same columns and types as ``retail_view``)."""
    return spark.read.parquet(target)


def with_expenditure(df: DataFrame) -> DataFrame:
    """Spend per line for the expenditure operators: cost_price x quantity."""
    return df.withColumn("expenditure", F.col("cost_price") * F.col("quantity"))


# The oracle's definition of the same view (DuckDB dialect, also valid Spark SQL).
RETAIL_SQL = """
SELECT
  l_orderkey AS order_id,
  l_linenumber AS line_no,
  l_partkey AS part_key,
  l_suppkey AS supp_key,
  p_name AS product_name,
  CASE WHEN (l_orderkey + l_linenumber) % 61 = 0 THEN NULL ELSE p_brand END AS category,
  CAST(l_extendedprice / 10.0 AS DECIMAL(18,3)) AS price,
  CAST(round(l_discount * 100) * 5 AS DOUBLE) AS discount_percentage,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL
       ELSE 1.0e0 + ((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 41) / 10.0e0 END AS rating,
  (l_partkey * 13 + l_orderkey) % 97 AS review_count,
  CAST(l_quantity AS INT) AS quantity,
  CAST(CAST(l_extendedprice / 10.0 AS DECIMAL(18,3)) * CAST(6 + l_suppkey % 7 AS DECIMAL(3,0)) / 10
       AS DECIMAL(18,4)) AS cost_price,
  o_orderdate AS order_date
FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey
"""
