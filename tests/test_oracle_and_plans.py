"""Registered queries against DuckDB, properties, and plan shape checks."""

import math
import re

import duckdb
import pytest

from conftest import SF_ORACLE, SF_SMALL
from shelfscope.plans import registry
from shelfscope.sources.retail_view import TABLES, retail_view
from shelfscope.operators import basket, bands

FAST = ["kpis", "top_categories_by_revenue", "price_bands", "segmentation", "product_list",
        "profit_loss", "avg_annual_expenditure", "association_rules", "synthetic_sales",
        "recommendations", "question_intents", "bought_together_cards", "impute_median",
        "model_features", "answer_questions"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        t = []
        for i in order:
            v = r[i]
            if hasattr(v, "as_tuple"):
                v = float(v)
            t.append(v)
        out.append(tuple(t))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    sdf = registry.QUERIES[name](spark, SF_ORACLE)
    res = duck.execute(registry.ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in sdf.collect()], sdf.columns) == _norm(res.fetchall(), dcols)


def test_every_query_has_schema_and_runs_small(spark):
    # every registered query plans; the cheap ones also run on sf0.001
    for name, fn in registry.QUERIES.items():
        df = fn(spark, SF_SMALL)
        assert df.columns, name


def test_rule_properties(spark):
    view = retail_view(spark, SF_SMALL)
    rules = basket.association_rules(view).collect()
    counts = {r.item: r.n for r in basket.item_counts(view).collect()}
    total = basket.association_meta(view).first().total_transactions
    for r in rules:
        assert r["count"] <= min(counts[r.product_a], counts[r.product_b])
        assert 0 <= r.confidence_a_to_b <= 1 and 0 <= r.confidence_b_to_a <= 1
        assert abs(r.support * total - r["count"]) <= total * 0.00005 + 1e-9
        assert r.product_a < r.product_b


def test_results_stable_under_repartition(spark):
    view = retail_view(spark, SF_SMALL)
    a = sorted(tuple(r) for r in basket.association_rules(view).collect())
    b = sorted(tuple(r) for r in basket.association_rules(view.repartition(7)).collect())
    assert a == b
    # duplicated order lines do not change the rules
    c = sorted(tuple(r) for r in basket.association_rules(view.unionByName(view)).collect())
    assert a == c


def test_band_counts_sum(spark):
    view = retail_view(spark, SF_SMALL)
    total = sum(r.n for r in bands.price_bands(view).collect())
    assert total == view.where("price > 0").count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_or_cartesian(spark):
    for name, fn in registry.QUERIES.items():
        if name in ("rating_model", "sales_model"):  # planning these fits a model
            continue
        plan = _plan(fn(spark, SF_SMALL))
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                     "ArrowEvalPython"):
            assert node not in plan, (name, node)


def test_scan_is_pruned(spark):
    plan = _plan(registry.QUERIES["top_categories_by_revenue"](spark, SF_SMALL))
    # lineitem is read for price, keys and the category rule only
    assert "l_shipdate" not in plan and "l_returnflag" not in plan
    assert "o_orderpriority" not in plan


def test_models_finite(spark):
    m = registry.QUERIES["rating_model"](spark, SF_SMALL).first()
    assert all(math.isfinite(v) for v in (m.accuracy, m.rmse, m.r2))
    split = {r.split: r.n for r in registry.QUERIES["train_test_split"](spark, SF_SMALL).collect()}
    frac = split["test"] / (split["test"] + split["train"])
    assert abs(frac - 0.2) < 0.03


def test_model_learns_step_function(spark):
    from pyspark.sql import functions as F
    from shelfscope.operators import models
    df = spark.range(0, 3000).select(
        (F.col("id") % 1000).cast("double").alias("price"),
        (F.col("id") % 7).cast("double").alias("discount_percentage"),
        F.when(F.col("id") % 1000 < 500, F.lit(2.0)).otherwise(F.lit(4.5)).alias("rating"),
        F.col("id").alias("k"))
    res = models.rating_model(df, num_trees=10, max_depth=4, key_cols=["k"])
    assert res.metrics.first().r2 > 0.8


def test_profit_identity(spark):
    r = registry.QUERIES["profit_loss"](spark, SF_SMALL).first()
    assert math.isclose(r.total_profit - r.total_loss, r.net_profit, rel_tol=1e-12)
    assert r.total_profit >= 0 and r.total_loss >= 0


def test_model_reproducible(spark):
    a = registry.QUERIES["rating_model"](spark, SF_SMALL).first()
    b = registry.QUERIES["rating_model"](spark, SF_SMALL).first()
    assert (a.rmse, a.r2) == (b.rmse, b.r2)


def test_pairs_are_counted_map_side(spark):
    view = retail_view(spark, SF_SMALL)
    df = basket.item_pairs(view)
    df.collect()
    plan = _plan(df)
    # a partial count sits right after the pair join, before the pair shuffle
    assert "partial_count" in plan
    assert re.search(r"HashAggregate\(keys=\[product_a#\d+, product_b#\d+\], functions=\[partial_count", plan)


def test_median_is_a_number_in_the_plan(spark):
    # no value is shuffled or sorted for it, and the query that uses it reads the view once
    plan = _plan(registry.QUERIES["segmentation"](spark, SF_SMALL))
    assert "rangepartitioning" not in plan and "Subquery" not in plan and plan.count("lineitem.parquet") <= 1
