"""Table sources and the insight sink."""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.operators import ingest, schema
from shelfscope.sources import store

#: Folder that names the complete runs of an insight folder.
MANIFESTS = "_manifests"

# Fixed value: text read as missing (pandas' default NA words).
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
            "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
            "nan", "null"]

UNSUPPORTED = "This input is neither CSV nor Parquet; name the format if the path does not tell it."
EXCEL = ("Excel workbooks are not decoded on the cluster; save the sheet as CSV (or Parquet) "
         "and read that.")


def _data_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a path or folder, through the file system that Spark itself uses.

    Hidden and marker files (``_SUCCESS``, ``.crc``) do not count. Only the listing
    reaches the driver, as it does for any Spark read.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(root).isDirectory():
        return [str(fs.getFileStatus(root).getPath().toString())]
    found, listing = [], fs.listFiles(root, True)
    base = fs.getFileStatus(root).getPath().toString()
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().toString()
        inner = name[len(base):].strip("/").split("/")
        if status.getLen() and not any(part.startswith(("_", ".")) for part in inner):
            found.append(name)
    return sorted(found)


def check_format(path: str, fmt: str | None = None, spark: SparkSession | None = None) -> str:
    """``csv`` or ``parquet`` for a path. A single file must end in ``.csv``
    (case-sensitive) or ``.parquet``; a folder (local or remote) is what all its data
    files are, which takes a session to list them. ``fmt`` overrides the inference.
    Excel is not decoded here: convert it first."""
    if fmt is not None:
        if fmt not in ("csv", "parquet"):
            raise ValueError(UNSUPPORTED)
        return fmt
    if path.endswith((".xlsx", ".xls")):
        raise ValueError(EXCEL)
    for ending in ("csv", "parquet"):
        if path.endswith(f".{ending}"):
            return ending
    if spark is None:
        raise ValueError(UNSUPPORTED)
    # a file within a folder may be compressed
    kinds = {next((k for k in ("csv", "parquet") if f".{k}" in name.rsplit("/", 1)[-1]), None)
             for name in _data_files(spark, path)}
    if len(kinds) != 1 or None in kinds:
        raise ValueError(UNSUPPORTED)
    return kinds.pop()


def _cells(record: str) -> list[str]:
    return next(csv.reader([record.removeprefix("\ufeff").removesuffix("\r")]), [])


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, id, value, quotes) of every line; ``block`` is where its split starts, and
    ids ascend within a split. Large files are read by many tasks."""
    return (spark.read.option("lineSep", "\n").text(files)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("id"), "value")
            .withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"')))))


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, first, record) of CSV files whose cells may hold line breaks; ``first`` orders the records of a file.

    A line starts a record if the quotes before it in its file are even in number. Each split counts its own
    quotes; a running sum over the splits of a file (one row each) tells on which side of a
    quote a split starts, and which record of an earlier split goes on into it. Only lines are
    shuffled, to their split and to their record, so no file is read by one task.
    """
    lines = _lines(spark, files)
    place, in_order = ["file", "block"], Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*place).agg(F.sum("quotes").alias("own")).select(
        *place, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"))
    in_block = Window.partitionBy(*place).orderBy("id")
    so_far = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.struct("block", "id")
    marked = (lines.join(blocks, place)
              .withColumn("starts", (F.col("earlier") + so_far) % 2 == 0)
              .withColumn("first", F.last(F.when(F.col("starts"), here), ignorenulls=True).over(
                  in_block.rowsBetween(Window.unboundedPreceding, 0))))
    carried = marked.groupBy(*place).agg(F.max("first").alias("last_start")).select(
        *place, F.last("last_start", ignorenulls=True).over(before).alias("carried"))
    owned = marked.join(carried, place).withColumn("first", F.coalesce("first", "carried"))
    gathered = owned.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return gathered.select("file", "first", F.regexp_replace(text, "\r$", "").alias("record"))


def _survey(spark: SparkSession, files: list[str], multi_line: bool) -> dict[str, tuple[tuple[str, ...], bool]]:
    """Header cells of each file, and whether its records need more than one line: one pass of many tasks.

    One row for each file reaches the driver, as its listing does.
    """
    jvm = spark._jvm
    listed = {jvm.org.apache.hadoop.fs.Path(name).toUri().toString(): name for name in files}
    # a lone carriage return ends a line for some readers
    across = (F.col("quotes") % 2 == 1) | F.col("value").rlike("\r.")
    found = _lines(spark, files).groupBy("file").agg(
        F.min_by("value", F.struct("block", "id")).alias("header"), F.max(across).alias("across")).collect()
    headers = {r.file: r.header for r in found}
    broken = [r.file for r in found if r.across and multi_line]
    if any(headers[f].count('"') % 2 for f in broken):  # a line break within a header
        firsts = records(spark, [listed[f] for f in broken]).groupBy("file").agg(F.min_by("record", "first").alias("header"))
        headers |= {r.file: r.header for r in firsts.collect()}
    return {listed[f]: (tuple(_cells(h)), f in broken) for f, h in headers.items()}


def read_csv(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV files as text columns under folded header names.

    Doubled quotes and quoted line breaks are read as they are meant, by many tasks a file (``records``). Files of a folder
    may order or choose their columns differently: they are read by their own headers and
    united by name. A row that does not have its header's number of cells fails the read. Lines
    end with a line feed, after a carriage return or not.
    ``multi_line=False`` says that no cell holds a line break.
    """
    files = _data_files(spark, path)
    if not files:
        raise ValueError("empty input: no header row")
    by_header: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for name, kind in _survey(spark, files, multi_line).items():
        by_header.setdefault(kind, []).append(name)
    parts = []
    for (header, across), names in sorted(by_header.items()):
        if not header:
            raise ValueError("empty input: no header row")
        folded = [schema.fold_name(h, strict) for h in header]
        if len(set(folded)) != len(folded):
            raise schema.HeaderCollision(f"headers fold to duplicates: {list(header)}")
        wanted = T.StructType([T.StructField(name, T.StringType()) for name in folded])
        parts.append(_parsed(spark, sorted(names), wanted, across))
    df = parts[0]
    for other in parts[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


def _parsed(spark: SparkSession, names: list[str], wanted: T.StructType, across: bool) -> DataFrame:
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": str(across).lower()}
    if not across:
        return (spark.read.options(**options, inferSchema="false", encoding="UTF-8", header=True, enforceSchema=True)
                .schema(wanted).csv(names))
    whole = records(spark, names)
    heads = whole.groupBy("file").agg(F.min("first").alias("first"))
    rows = whole.where(F.trim("record") != "").join(heads, ["file", "first"], "left_anti")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in wanted)
    return rows.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")


# The words that are read as truth values.
TRUTH = ["True", "TRUE", "true", "False", "FALSE", "false"]


def infer_types(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Text columns typed by all their values, from one pass that many tasks merge.

    The types of a value are ordered long, double, text, beside boolean, text; a column gets the narrowest one that holds all its
    values. Missing cells make whole numbers doubles and truth values text; a column
    without any value is double. Columns of ``keep`` stay text.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not texts:
        return df

    def quoted(name: str) -> Column:
        return F.col(f"`{name.replace('`', '``')}`")

    kinds = []
    for i, name in enumerate(texts):
        c = F.trim(quoted(name))
        number = c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(c).rlike("^[+-]?inf(inity)?$")
        whole = c.rlike("^[+-]?[0-9]+$") & c.try_cast("long").isNotNull()
        kinds += [F.count(c).alias(f"n{i}"), *[F.count_if(k).alias(f"{tag}{i}") for tag, k in (
            ("long", whole), ("double", number), ("boolean", quoted(name).isin(TRUTH)))]]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *kinds).first()
    casts = {}
    for i, name in enumerate(texts):
        n, full = seen[f"n{i}"], seen[f"n{i}"] == seen["rows"]
        c = F.trim(quoted(name))
        if n and seen[f"boolean{i}"] == n:
            if full:
                casts[name] = F.lower(c) == "true"
        elif n and full and seen[f"long{i}"] == n:
            casts[name] = c.try_cast("long")
        elif seen[f"double{i}"] == n:
            casts[name] = c.try_cast("double")
    return df.select(*[(casts[x].alias(x) if x in casts else quoted(x)) for x in df.columns])


def read_table(spark: SparkSession, path: str, strict: bool = True, impute: bool = True,
               all_null_fill: float | None = None, fmt: str | None = None,
               multi_line: bool = True, infer: bool = True) -> DataFrame:
    """Read a CSV file or folder, null the NA words, type the columns by their values (``infer_types``; date
    columns stay text), then normalise (fold, alias, coerce, impute). Parquet keeps its types."""
    if check_format(path, fmt, spark) == "parquet":
        return ingest.normalize(spark.read.parquet(path), strict, impute, all_null_fill)
    df = ingest.null_na_words(read_csv(spark, path, strict, multi_line), NA_WORDS)
    if infer:
        date = schema.resolve(schema.apply_aliases(df), schema.DATE)
        df = infer_types(df, [c for c in df.columns if c == date and c != "year"])
    return ingest.normalize(df, strict=True, impute=impute, all_null_fill=all_null_fill)


def write_insights(insights: dict[str, DataFrame], out_dir: str, fmt: str = "json") -> list[str]:
    """S3: one folder per insight, written by the executors (no collect).

    Each call writes a run folder of its own, and names it in a manifest once every insight
    is there. Readers follow the last manifest, so a run that was killed leaves the former insights as they were.
    """
    if not insights:
        return []
    spark = next(iter(insights.values())).sparkSession
    root = out_dir.rstrip("/")
    run = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    tables = {}
    for name, df in insights.items():
        writer = df.write.format(fmt)
        if fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.save(f"{root}/{run}/{name}")
        tables[name] = df.schema.jsonValue()
    store.put(spark, f"{root}/{MANIFESTS}/{run}", json.dumps({"format": fmt, "tables": tables}))
    return [f"{root}/{run}/{name}" for name in tables]


def insight_runs(spark: SparkSession, out_dir: str) -> list[str]:
    """The complete runs of an insight folder, the last one at the end."""
    return store.names(spark, f"{out_dir.rstrip('/')}/{MANIFESTS}")


def read_insights(spark: SparkSession, out_dir: str, run: str | None = None) -> dict[str, DataFrame]:
    """The insights of the last complete run (or of the one named), with the types they were written with."""
    runs = insight_runs(spark, out_dir)
    if not runs or (run is not None and run not in runs):
        raise FileNotFoundError(f"no complete run in {out_dir}")
    run, root = run or runs[-1], out_dir.rstrip("/")
    manifest = json.loads(store.get(spark, f"{root}/{MANIFESTS}/{run}"))
    return {name: spark.read.schema(T.StructType.fromJson(fields)).format(manifest["format"]).load(f"{root}/{run}/{name}")
            for name, fields in manifest["tables"].items()}
