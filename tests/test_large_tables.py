"""What large tables need: input made once for several passes, cheap parsing, tasks of bounded size."""

import datetime
import re

import pytest
from conftest import SF_SMALL, rows
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfscope.functions.numeric import to_number
from shelfscope.functions.quantile import medians
from shelfscope.operators import basket, finance, forest, ingest, models
from shelfscope.plans import registry
from shelfscope.sources import retail_view as view

N = 60


@pytest.fixture()
def counted(spark):
    """A table whose rows count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def price(i):
        made.add(1)
        return float(i * i % 37)

    df = spark.range(N).select(
        F.col("id").alias("k"), F.udf(price, "double")("id").alias("price"), F.when(F.col("id") % 5 > 0, F.col("id") % 4 + 1.5).alias("rating"),
        (F.col("id") % 3 * 10.0).alias("discount_percentage"), F.concat(F.lit("c"), F.col("id") % 4).alias("category"))
    return df, made



def test_medians_make_their_input_once(spark, counted):
    df, made = counted
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    medians(df, "price", {"all": F.lit(True), "some": F.col("rating") > 2}, digit=8)
    assert made.value == N
    ingest.impute_median(df, ["price", "rating"])
    assert made.value == 2 * N
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_models_make_their_input_once(spark, counted):
    df, made = counted
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = models.rating_model(df, 2, 2, ["k"])
    assert made.value == N
    assert found.metrics.count() == 1 and found.codes.count() == 4 and made.value <= 2 * N
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_text_numbers_are_matched_once(spark):
    texts = [" 1 ", "+.5", "1.", "1e3\n", " -2.5E-1\x85", "1e999", "", " ", "nan", "5d", "1,2", "Infinity", "1 2", "0x1", None]
    df = spark.createDataFrame([(t,) for t in texts], "some_text string")
    number = to_number(F.col("some_text"), StringType())
    assert [r[0] for r in rows(df.select(number))] == [1.0, 0.5, 1.0, 1000.0, -0.25, float("inf"), *[None] * 9]
    assert str(number).count("some_text") == 1


def test_shapes_refuse_no_date(spark):
    days = [datetime.date(2021, 12, 25), datetime.date(2020, 2, 29), datetime.date(1999, 5, 3), datetime.date(2024, 9, 10)]
    odd = ["", "x", "1/2/2020", "0001/2/2020", "13/13/2020", "31/4/2021", "20200229", "2020-2-9", "2020-02-30", "2020-01-02t03:04:05z",
           "2020-01-02T03:04:05+01:00", "2020-01-02 23:59:59.123456", "2020-01-02 03:04:05.1.2", "2020-01-02 24:00", "5 may 2020", "5 MAY 2020",
           "5 Sept 2020", "12020-01-01", "+12020-01-01", "-0044-03-15", "1.1.2020", "00000000"]
    plain = [f.replace("[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", ".SSS").replace("[XXX]", "XXX") for f in finance.DATE_FORMATS]
    stamps = spark.createDataFrame([(d,) for d in days], "d date").select(F.to_timestamp("d").alias("d"))
    written = [r[0] for r in rows(stamps.select(F.explode(F.array(*[F.date_format("d", f) for f in plain]))))]
    df = spark.createDataFrame([(t,) for t in [*written, *odd]], "t string")
    for f in finance.DATE_FORMATS:
        assert finance._shape(f) is not None
        both = rows(df.select("t", finance._parsed(F.col("t"), f).cast("string"), F.try_to_timestamp("t", F.lit(f)).cast("string")))
        assert [r for r in both if r[1] != r[2]] == [], f


def test_large_lines_are_dealt_by_order(spark, monkeypatch):
    plain = view.retail_view(spark, SF_SMALL)
    want = {k: sorted(rows(f(plain))) for k, f in (("pairs", basket.item_pairs), ("sizes", basket.basket_sizes), ("counts", basket.item_counts))}
    cards = sorted(rows(basket.bought_together_cards(plain)))
    monkeypatch.setattr(view, "LINES_A_TASK", 500)
    tasks = view.line_tasks(spark, SF_SMALL)
    assert tasks == 12
    dealt = view.retail_view(spark, SF_SMALL)
    assert basket.baskets(dealt).rdd.getNumPartitions() == tasks
    assert sorted(rows(basket.item_pairs(dealt, tasks=tasks))) == want["pairs"]
    assert sorted(rows(basket.item_pairs(dealt, chunk=2, tasks=tasks))) == want["pairs"]
    assert sorted(rows(basket.basket_sizes(dealt))) == want["sizes"]
    assert sorted(rows(basket.item_counts(dealt))) == want["counts"]
    assert sorted(rows(basket.bought_together_cards(dealt, tasks=tasks))) == cards


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_large_lines_meet_their_parts_in_as_many_tasks(spark, monkeypatch, broadcast):
    want = sorted(rows(view.retail_view(spark, SF_SMALL)), key=str)
    monkeypatch.setattr(view, "LINES_A_TASK", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        dealt = view.retail_view(spark, SF_SMALL)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        dealings = re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan)
        assert ("p_partkey", "12") in dealings
        assert (("l_partkey", "12") in dealings) == (broadcast == "-1")
        assert {n for _, n in dealings} == {"12"}
        assert sorted(rows(dealt), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_many_rules_are_joined_and_sorted_in_as_many_tasks(spark, broadcast):
    n, tasks = 400, 12
    lines = spark.range(5 * n).select((F.col("id") % n).alias("order_id"), F.concat(F.lit("p"), F.col("id") * F.col("id") % 97).alias("product_name"))
    want = basket.association_rules(lines)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rules = basket.association_rules(lines, tasks=tasks)
        plan = rules._jdf.queryExecution().executedPlan().toString()
        for product in ("product_a", "product_b"):
            assert {m for m in re.findall(rf"hashpartitioning\({product}#\d+, (\d+)\)", plan)} == {str(tasks)}
        assert rules.rdd.getNumPartitions() == tasks
        assert rules.dtypes == want.dtypes and rows(rules) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pairs_are_summed_in_as_many_tasks(spark):
    n, tasks = 400, 12
    lines = spark.range(7 * n).select((F.col("id") % n).alias("order_id"), F.concat(F.lit("p"), F.col("id") * F.col("id") % 97).alias("product_name"))
    odd = spark.createDataFrame([(None, "p1"), (1, None), (1, " p1 "), (1, "p1"), (-1, "alone"), *((-2, f"q{i}") for i in range(9))], lines.schema)
    lines = lines.union(odd).union(odd)
    plain = basket.item_pairs(lines)
    want = sorted(rows(plain))
    assert len([r for r in want if r[0].startswith("q")]) == 9 * 8 // 2
    for chunk in (2, 2000):
        pairs = basket.item_pairs(lines, chunk=chunk, tasks=tasks)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        # counted within each task first, then dealt by pair
        assert re.findall(r"hashpartitioning\(product_a#\d+, product_b#\d+, (\d+)\)", plan) == [str(tasks)]
        assert re.search(r"hashpartitioning\(product_a.*?HashAggregate\(keys=\[slot#\d+, product_a#\d+, product_b#\d+\], functions=\[count", plan, re.DOTALL)
        assert pairs.rdd.getNumPartitions() == tasks
        assert pairs.dtypes == plain.dtypes and sorted(rows(pairs)) == want


def test_forest_keeps_cells_and_sums_not_rows(spark):
    n = 4000
    rows = spark.range(n).select((F.col("id") % 8).alias(forest.CELL), F.xxhash64("id").alias(forest.DRAW), (F.col("id") % 8 % 5 * 1.25).alias("y"))
    labels = forest.Labels(2.0, 2.0 ** 40)
    found = rows.withColumn("other", F.rand()).repartition(7, "other")
    bags = [sorted(rows_of(forest._bags(x, "y", labels, 12, 7))) for x in (rows, found)]
    assert bags[0] == bags[1] and len(bags[0]) == 12 * 8  # a row for each tree and cell, however many lines
    drawn = [sum(w for t, _, w, _ in bags[0] if t == i) for i in range(12)]
    assert all(abs(d - n) < 5 * n ** 0.5 for d in drawn) and len(set(drawn)) > 6
    for _, c, w, y in bags[0]:
        assert abs(y / w / labels.size + labels.center - c % 5 * 1.25) < 1e-9


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_forest_finds_the_best_splits(spark):
    """Each split of a tree is the one that plain arithmetic over its rows finds, and MLlib's model of it predicts the same."""
    n = 600
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 37 % 101 * 1.5).alias("price"), (F.col("id") % 7 * 5.0).alias("discount_percentage"),
                               (F.col("id") * 37 % 101 % 40 / 10 + F.col("id") % 7).alias("rating"), F.lit("train").alias("split"))
    names = ["price", "discount_percentage"]
    cuts, labels = forest.edges(df, df, names, "rating")
    assert len(cuts[0]) == 31 and len(cuts[1]) == 6
    lines = forest.with_cells(df, names, cuts).select(forest.CELL, F.xxhash64("k").alias(forest.DRAW), "rating", *names)
    grown = forest.grown(lines, names, cuts, "rating", labels, 3, 4, 42)
    bags = rows_of(forest._bags(lines, "rating", labels, 3, 42))
    for tree in range(3):
        own = [(c >> 5, c & 31, w, y) for t, c, w, y in bags if t == tree]
        splits = {r.node: r for level in grown.splits for r in level if r.tree == tree}

        def check(node, part):
            w, y = sum(p[2] for p in part), sum(p[3] for p in part)
            assert abs(grown.means[tree, node][0] - labels.mean(y, w)) < 1e-9 and grown.means[tree, node][1] == w
            gains = []
            for f in (0, 1):
                for b in range(32):
                    left = [p for p in part if p[f] <= b]
                    wl, yl = sum(p[2] for p in left), sum(p[3] for p in left)
                    if 0 < wl < w:
                        gains.append((yl * yl / wl + (y - yl) ** 2 / (w - wl) - y * y / w, f, b))
            r = splits.get(node)
            if r is None:
                assert node >= 16 or not gains or max(gains)[0] <= 1e-9 * labels.size ** 2 * w
                return
            f, b = r.split >> 5, r.split & 31
            gain = [g for g, *at in gains if at == [f, b]][0]
            assert gain >= max(gains)[0] * (1 - 1e-9)
            check(2 * node, [p for p in part if p[f] <= b])
            check(2 * node + 1, [p for p in part if p[f] > b])

        check(1, own)
    known = {c: p for c, p in rows_of(grown.predictions(lines))}
    for c, p in rows_of(grown.model().transform(lines).select(forest.CELL, "prediction")):
        assert abs(p - known[c]) < 1e-9


def test_registered_models_join_the_view_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(registry, "_v", lambda s, sf: made.append(sf) or view.retail_view(s, sf))
    monkeypatch.setattr(registry, "MODEL_TREES", 2)
    monkeypatch.setattr(registry, "MODEL_DEPTH", 2)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    for name in ("rating_model", "sales_model", "rating_model_bounds", "sales_model_bounds"):
        made.clear()
        assert len(registry.QUERIES[name](spark, SF_SMALL).collect()) == 1
        assert made == [SF_SMALL], name
        assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_answers_join_the_view_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(key):
        made.add(1)
        return key

    monkeypatch.setattr(registry, "_v", lambda s, sf: view.retail_view(s, sf).withColumn("order_id", F.udf(seen, "long")("order_id")))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = registry.QUERIES["answer_table"](spark, SF_SMALL)
    assert found.count() == 19 and made.value == view.retail_view(spark, SF_SMALL).count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
