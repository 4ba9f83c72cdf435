"""Top rules, partner cards and catalogue places against the full tables."""

import random

from conftest import SF_SMALL, rows
from shelfscope.operators import basket, catalog
from shelfscope.plans.fused import FusedFigures
from shelfscope.plans import registry
from shelfscope.sources.retail_view import retail_view


def skewed(spark):
    rng = random.Random(3)
    lines = [(t, f"p{int(rng.paretovariate(0.6)) % 400:03d}") for t in range(1500) for _ in range(rng.randint(1, 6))]
    return spark.createDataFrame(lines, "order_id long, product_name string").repartition(4)


def test_top_rules_equal_the_full_table(spark):
    for df in (skewed(spark), retail_view(spark, SF_SMALL), skewed(spark).where("order_id < 3"), skewed(spark).limit(0)):
        full = rows(basket.association_rules(df))
        for n in (1, 8, 10):
            assert rows(basket.top_rules(df, n)) == full[:n]


def test_fewer_pairs_are_formed(spark):
    df = skewed(spark)
    b = basket.baskets(df)
    kept = basket.pair_counts(b.join(basket.frequent_enough(b, 8), "item", "left_semi")).count()
    assert kept < basket.item_pairs(df).count() / 4


def test_partner_counts_equal_the_full_table(spark):
    df = skewed(spark)
    chosen = spark.createDataFrame([("p001",), ("p002",), ("p399",), ("none",)], "product string")
    want = {(r.product, r.partner, r["count"]) for r in basket.partners_by_product(df).collect() if r.product in ("p001", "p002", "p399")}
    for chunk in (2000, 2):
        assert {tuple(r) for r in basket.partner_counts(basket.baskets(df), chosen, chunk).collect()} == want


def test_places_of_equal_values_spread_over_tasks(spark):
    df = spark.range(0, 3000, 1, 4).selectExpr(
        "concat('n', id) AS product_name", "if(id % 3 = 0, null, double(id % 2)) AS rating", "id AS sales")
    for mode, nulls in (("rating_high", "last"), ("rating_low", "last"), ("rating_low", "js"), ("name", "last"), ("price_low", "last")):
        placed = catalog.catalog_positions(df, mode, nulls)
        assert placed.columns == [*df.columns, "position"]
        plan = placed._jdf.queryExecution().toString()
        assert "hashpartitioning(rating" not in plan
        order = [r.product_name for r in df.orderBy(*catalog.sort_columns(df, mode, nulls)).collect()]
        assert [r.product_name for r in sorted(placed.collect(), key=lambda r: r.position)] == order
        assert sorted(r.position for r in placed.collect()) == list(range(1, 3001))


def test_fused_figures_equal_the_operators(spark):
    view = retail_view(spark, SF_SMALL)
    made = FusedFigures(view).insights()
    for name, df in made.items():
        want = registry.QUERIES[name](spark, SF_SMALL)
        assert rows(df, *want.columns) == rows(want), name
    few = FusedFigures(view.select("category", "rating")).insights()
    assert set(few) == {"kpis", "top_categories_by_rating", "category_top3_rating", "rating_profile"}
    assert few["kpis"].first().avg_price == 0.0
    empty = FusedFigures(view.limit(0)).insights()
    assert empty["kpis"].first().total_products == 0 and empty["price_profile"].first().avg_price is None
