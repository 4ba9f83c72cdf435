"""Parallel CSV records, inferred types, elected date formats, the consistent sink, kept-up insights."""

import csv
import random

import pytest
from conftest import SF_SMALL, rows
from pyspark.sql import functions as F

from shelfscope.operators import finance
from shelfscope.plans.fused import FusedFigures
from shelfscope.sources import files
from shelfscope.sources.retail_view import retail_view
from shelfscope.streaming import kept as kept_insights


@pytest.fixture
def small_splits(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(3)
    words = ["tea", "cup", 'say "hi"', "a,b", "one\ntwo", "\n\n", '"', "x\r\ny", "", "long\n" * 30]
    data = [[str(i), rng.choice(words) + rng.choice(words), rng.choice(words)] for i in range(9000)]
    data[100][1] = "line\n" * 15000  # a cell that holds several splits
    path = f"{tmp_path}/big.csv"
    with open(path, "w", newline="") as out:
        csv.writer(out).writerows([["Row No", "Name", "Note\nof two lines"], *data])
    assert files._lines(spark, [path]).rdd.getNumPartitions() > 10
    df = files.read_csv(spark, path)
    assert df.columns == ["row_no", "name", "note\nof_two_lines"] or len(df.columns) == 3
    got = {int(r[0]): (r[1] or "", r[2] or "") for r in df.collect()}
    assert got == {int(i): (a, b) for i, a, b in data}


def test_plain_files_keep_the_native_split_scan(spark, tmp_path, small_splits):
    path = f"{tmp_path}/plain.csv"
    with open(path, "w") as out:
        out.write("name,price\r\n" + "".join(f'"cup, ""{i}""",{i}\r\n' for i in range(9000)))
    df = files.read_csv(spark, path)
    assert df.rdd.getNumPartitions() > 3 and "Window" not in df._jdf.queryExecution().toString()
    assert df.count() == 9000 and df.where(F.col("name") == 'cup, "8999"').first().price == "8999"


def test_wrong_width_fails_across_lines_too(spark, tmp_path):
    with open(f"{tmp_path}/w.csv", "w") as out:
        out.write('name,price\n"a\nb",1\n"c\nd",1,2\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_csv(spark, f"{tmp_path}/w.csv").collect()


def test_types_of_all_columns_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("whole,mixed,real,flag,some_flag,late,text,none,gap\n1,1,1.5,True,true,1,x,,1\n-2,2, 2,FALSE,,2,1,NA,\n")
    (tmp_path / "in" / "b.csv").write_text("whole,mixed,real,flag,some_flag,late,text,none,gap\n+3,2.5,1e3,true,false,three,2,,3\n")
    df = files.read_table(spark, str(tmp_path / "in"))
    assert dict(df.dtypes) == {"whole": "bigint", "mixed": "double", "real": "double", "flag": "boolean", "some_flag": "string",
                               "late": "string", "text": "string", "none": "double", "gap": "double"}
    assert sorted(rows(df, "whole", "mixed", "flag")) == [(-2, 2.0, False), (1, 1.0, True), (3, 2.5, True)]
    assert {t for _, t in files.read_table(spark, str(tmp_path / "in"), infer=False).dtypes} == {"string"}


def test_day_and_month_are_settled_by_the_column(spark):
    def years(dates, formats=None):
        df = spark.createDataFrame([(d, 1.0) for d in dates], "date string, expenditure double")
        name = finance._elected(df, "date", formats)
        return [r[0] for r in df.select(F.coalesce(*[F.try_to_timestamp(F.trim("date"), F.lit(f)) for f in name]).cast("date").cast("string")).collect()]
    assert years(["25/12/2021", "05/12/2021"]) == ["2021-12-25", "2021-12-05"]
    assert years(["12/25/2021", "05/12/2021"]) == ["2021-12-25", "2021-05-12"]
    assert years(["05/12/2021"]) == ["2021-05-12"]
    assert years(["05/12/2021 10:30", "25/12/2021", "1/2/2021 11:00:00"]) == ["2021-12-05", "2021-12-25", "2021-02-01"]
    df = spark.createDataFrame([("2021-01-02",)] * 5 + [("3 Mar 2020",)] * 2 + [("no date",)], "date string")
    assert finance.elected_formats(df, "date") == ["yyyy-MM-dd", "d MMM yyyy"]
    none = spark.createDataFrame([("?", 1.0)], "date string, expenditure double")
    assert finance.elected_formats(none, "date") == []
    assert finance.avg_annual_expenditure(none).first().note == finance.NO_YEARS


def test_a_killed_run_leaves_the_former_insights(spark, tmp_path):
    good = {"kpis": spark.createDataFrame([(1, None)], "n int, note string"), "empty": spark.createDataFrame([], "d decimal(9,2)")}
    files.write_insights(good, f"{tmp_path}/out")
    broken = {"kpis": spark.createDataFrame([(2, "new")], "n int, note string"),
              "bad": spark.range(3).select(F.raise_error(F.lit("killed")).alias("x"))}
    with pytest.raises(Exception, match="killed"):
        files.write_insights(broken, f"{tmp_path}/out")
    back = files.read_insights(spark, f"{tmp_path}/out")
    assert rows(back["kpis"]) == [(1, None)] and back["empty"].dtypes == [("d", "decimal(9,2)")]
    files.write_insights({"kpis": broken["kpis"]}, f"{tmp_path}/out", fmt="parquet")
    assert list(files.read_insights(spark, f"{tmp_path}/out")) == ["kpis"]
    runs = files.insight_runs(spark, f"{tmp_path}/out")
    assert len(runs) == 2 and rows(files.read_insights(spark, f"{tmp_path}/out", runs[0])["kpis"]) == [(1, None)]
    with pytest.raises(FileNotFoundError):
        files.read_insights(spark, f"{tmp_path}/nothing")


def _same(got, want):
    assert sorted(got) == sorted(want)
    for name in want:
        assert got[name].columns == want[name].columns, name
        assert sorted(rows(got[name]), key=str) == sorted(rows(want[name]), key=str), name


def test_kept_insights_equal_the_batch(spark, tmp_path):
    view = retail_view(spark, SF_SMALL).select(
        "category", "price", "rating", "discount_percentage", F.col("order_id").alias("k")).withColumn(
        "discount_percentage", F.col("discount_percentage").cast("double") / 3)  # more than six decimals
    view.repartition(3).write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    want = FusedFigures(table, keep=False).insights()
    kept = kept_insights.KeptInsights(spark, f"{tmp_path}/kept", table.schema)
    assert rows(kept.insights()["kpis"])[0][0] == 0
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    query = kept_insights.start(stream, kept, f"{tmp_path}/checkpoint")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert len(kept._marks()[1]) == 3
    _same(kept.insights(), want)
    kept.update(table, 1)  # the batch comes again
    kept.compact()
    kept.update(table, 0)
    _same(kept.insights(), want)
    # a batch that was cut short left a part, but no mark
    kept._parts(table)[0].write.parquet(f"{tmp_path}/kept/groups/3")
    _same(kept.insights(), want)
    kept.update(table.where("rating > 3"), 3)
    kept.compact()
    _same(kept.insights(), FusedFigures(table.unionByName(table.where("rating > 3")), keep=False).insights())
