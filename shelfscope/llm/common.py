"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_text(column: str = "text") -> Column:
    """The text column; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset and driver and executors are one process (tests, trials), a
    temporary folder is made and set; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs only the tasks it was running,
    and several readers do not recompute what is above.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def binary_list(column: pa.Array) -> list[bytes]:
    """Strings of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def string_list(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


#: Bytes of a batch that are turned into Python objects at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES``, one row at least."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``per_batch`` to Arrow batches of bounded size; it returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = per_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow],
                    schema=arrow)

    return df.mapInArrow(run, schema)
