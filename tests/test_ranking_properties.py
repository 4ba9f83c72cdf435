"""Distributed ranks and medians against brute force on small random inputs."""

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfscope.functions.quantile import median, median_frame, medians, with_ordered_bits
from shelfscope.functions.ranking import dense_codes, range_ranked

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(lambda x: x / 4)),
                  min_size=0, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(values, st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=40)), st.sampled_from([5, 16, 64]))
def test_median_matches_brute_force(spark, xs, digit):
    df = spark.createDataFrame([(x,) for x in xs] or [(None,)], "x double")
    got = medians(df, "x", {"m": F.lit(True)}, digit)["m"]
    present = [x for x in xs if x is not None]
    if not present:
        assert got is None
    else:
        s = sorted(present)
        lo, hi = s[(len(s) - 1) // 2], s[len(s) // 2]
        assert got == lo + (hi - lo) * 0.5
        assert abs(lo) > 1e100 or abs(hi) > 1e100 or got == pytest.approx(statistics.median(present))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["b", "a", "zz", "Z", "é", "a b", None]), max_size=40), st.integers(1, 4))
def test_dense_codes_match_sorted_distinct(spark, cats, ranges):
    df = spark.createDataFrame([(c,) for c in cats] or [(None,)], "category string")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {r.category: r.code for r in dense_codes(df, "category").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = {c: float(i) for i, c in enumerate(sorted({c for c in cats if c is not None},
                                                         key=lambda s: s.encode("utf-8")))}
    assert got == expected


def test_hot_value_median(spark):
    # one value holds most rows: still one counted row, exact answer
    df = spark.range(0, 10001).select(
        F.when(F.col("id") < 7000, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("x"))
    assert median_frame(df, "x").first()[0] == 5.0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 30).map(float)), st.booleans()),
                max_size=50), st.sampled_from([7, 16]))
def test_medians_match_brute_force(spark, pairs, digit):
    df = spark.createDataFrame(pairs or [(None, False)], "x double, flag boolean")
    got = medians(df, "x", {"all": F.lit(True), "flagged": F.col("flag")}, digit)

    def brute(xs):
        return statistics.median(xs) if xs else None

    assert got["all"] == brute([x for x, _ in pairs if x is not None])
    assert got["flagged"] == brute([x for x, f in pairs if x is not None and f])


def test_median_of_a_million_distinct_values(spark):
    df = spark.range(0, 1000001, 1, 8).select((F.pmod(F.col("id") * 7919, F.lit(1000001)) / 3.0 - 1000).alias("x"))
    assert median_frame(df, "x").first()[0] == 500000 / 3.0 - 1000
    assert median(df.where("x < 5e4 OR x > 3e5"), "x") == statistics.median(
        [i / 3.0 - 1000 for i in range(1000001) if i / 3.0 - 1000 < 5e4 or i / 3.0 - 1000 > 3e5])


def test_ordered_bits_are_those_of_the_double(spark):
    import random
    import struct
    rng = random.Random(1)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.0, float("inf"), -float("inf"), 1.7976931348623157e308]
    xs += [s * 2.0 ** e * f for s in (1, -1) for e in range(-1022, 1023, 31) for f in (1.0, 1 + 2.0 ** -52, 2 - 2.0 ** -52)]
    xs += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)) if x == x]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    df = with_ordered_bits(df, "x", "k")
    for r in df.collect():
        raw = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-raw if r.x < 0 else raw), r.x


def test_approx_median_option(spark):
    df = spark.range(0, 1001).select(F.col("id").cast("double").alias("x"))
    assert median_frame(df, "x", approx=True).first()[0] == 500.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 40), min_size=1, max_size=300), st.integers(1, 20))
def test_every_large_basket_is_split_by_its_size(spark, sizes, chunk):
    from shelfscope.operators import basket
    rows_ = [(t, f"i{j}") for t, k in enumerate(sizes) for j in range(k)]
    b = spark.createDataFrame(rows_, "txn long, item string")
    got = {r.txn: r.s for r in basket.split_factors(b, chunk).collect()}
    assert got == {t: -(-k // chunk) for t, k in enumerate(sizes) if k > chunk}


def test_payload_columns_do_not_disturb_positions(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 20000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("x"), F.col("id").alias("payload"))
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = [(r.x, r.payload, r.start) for r in range_ranked(df, "x").collect()]
        finally:
            spark.conf.set("spark.sql.exchange.reuse", "true")
        assert [s for *_, s in sorted(got)] == list(range(len(got))) and len(got) == 20000


def _sum_and_mean(df):
    from shelfscope.functions import exact
    return tuple(exact.aggregate(df, [], [exact.total(df, "x", "s"), exact.mean(df, "x", "m")]).first())


def test_sums_keep_small_and_large_doubles(spark):
    small = spark.createDataFrame([(4e-7,), (2e-7,), (None,)], "x double")
    assert abs(_sum_and_mean(small)[1] - 3e-7) < 1e-20
    large = spark.createDataFrame([(1e33,), (2.0,)], "x double")
    assert _sum_and_mean(large)[0] == 1e33
    whole = spark.createDataFrame([(3,), (4,)], "x long")
    assert _sum_and_mean(whole)[0] == 7.0
    none = spark.createDataFrame([(None,)], "x double")
    assert _sum_and_mean(none) == (None, None)
    assert _sum_and_mean(none.limit(0)) == (None, None)
    longs = spark.createDataFrame([(2 ** 62,)] * 5 + [(-3,)], "x long")
    assert _sum_and_mean(longs)[0] == float(5 * 2 ** 62 - 3)
    endless = spark.createDataFrame([(float("inf"),), (1.0,)], "x double")
    assert _sum_and_mean(endless) == (float("inf"), float("inf"))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False, width=64).filter(lambda x: abs(x) < 1e300),
                          st.integers(-10 ** 9, 10 ** 9).map(lambda x: x / 100), st.none()), max_size=80))
def test_sums_do_not_depend_on_the_order(spark, xs):
    import math
    from fractions import Fraction
    schema = "g int, x double"
    rows_ = [(i % 2, x) for i, x in enumerate(xs)]
    from shelfscope.functions import exact

    def sums(rows_, n):
        df = spark.createDataFrame(rows_ or [(0, None)], schema).repartition(n)
        return {r.g: r.s for r in exact.aggregate(df, ["g"], [exact.total(df, "x", "s")]).collect()}

    first = sums(rows_, 1)
    assert first == sums(rows_[::-1], 4) == sums(sorted(rows_, key=str), 3)
    for g, total in first.items():
        own = [x for h, x in rows_ if h == g and x is not None]
        if not own:
            assert total is None
            continue
        size = sum(abs(Fraction(x)) for x in own)
        assert abs(Fraction(total) - sum(map(Fraction, own))) <= size * Fraction(1, 2 ** 44)
        assert math.isfinite(total)


def test_decimal_figures_sum_as_decimals(spark):
    from pyspark.sql import functions as F
    from shelfscope.functions import exact
    df = spark.range(0, 100000, 1, 5).select((F.col("id") % 7).alias("g"), ((F.col("id") * 37 % 41) / 10 + 1.0).alias("x"))
    got = {r.g: (r.s, r.n) for r in exact.aggregate(df, ["g"], [exact.total(df, "x", "s"), exact.count("n")]).collect()}
    want = {r.g: (float(r.s), r.n) for r in df.groupBy("g").agg(F.sum(F.col("x").cast("decimal(20,6)")).alias("s"), F.count("*").alias("n")).collect()}
    assert got == want
