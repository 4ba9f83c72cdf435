"""Hand fixtures with hand-computed results (FIXTURES.md section 4)."""

import pytest

from conftest import rows
from shelfscope.operators import (bands, basket, catalog, category, finance, ingest, metrics,
                                  schema)


def test_basket_rules(spark):
    data = [("o1", "tea"), ("o1", "cup"), ("o1", "tea"), ("o2", "tea"), ("o2", "cup"),
            ("o2", "jam"), ("o3", "jam"), ("o4", " tea "), ("o4", None), (None, "cup")]
    df = spark.createDataFrame(data, "order_id string, product_name string")
    meta = basket.association_meta(df).first()
    assert (meta.total_transactions, meta.unique_products, meta.note) == (4, 3, "")
    counts = dict(rows(basket.item_counts(df), "item", "n"))
    assert counts == {"cup": 2, "jam": 2, "tea": 3}
    got = sorted(rows(basket.association_rules(df)))
    assert got == [("cup", "jam", 1, 0.25, 0.5, 0.5),
                   ("cup", "tea", 2, 0.5, 1.0, 0.6667),
                   ("jam", "tea", 1, 0.25, 0.5, 0.3333)]
    # rule order: count desc, support desc, product_a
    ordered = [r[:2] for r in rows(basket.association_rules(df))]
    assert ordered[0] == ("cup", "tea")


def test_partners_rank(spark):
    data = [("o1", "tea"), ("o1", "cup"), ("o2", "tea"), ("o2", "cup"), ("o2", "jam"), ("o3", "jam")]
    df = spark.createDataFrame(data, "order_id string, product_name string")
    p = {(r.product, r.rank): (r.partner, r["count"]) for r in basket.partners_by_product(df).collect()}
    assert p[("tea", 1)] == ("cup", 2)
    assert p[("tea", 2)] == ("jam", 1)
    assert p[("jam", 1)] == ("cup", 1)


def test_basket_notes(spark):
    no_txn = spark.createDataFrame([("tea",)], "product_name string")
    assert basket.association_meta(no_txn).first().note.startswith("Transaction ID column not found.")
    no_prod = spark.createDataFrame([("o1",)], "order_id string")
    assert basket.association_meta(no_prod).first().note == "Product name column not found."
    empty = spark.createDataFrame([("o1", None)], "order_id string, product_name string")
    assert basket.association_meta(empty).first().note == basket.NO_DATA


def test_hot_basket_split_gives_same_pairs(spark):
    # one basket holds most lines: forcing the split must not change any count
    from pyspark.sql import functions as F
    base = spark.range(0, 300).select(
        F.when(F.col("id") < 200, F.lit(0)).otherwise(F.col("id") % 20).alias("order_id"),
        (F.col("id") % 60).cast("string").alias("product_name"))
    plain = sorted(rows(basket.item_pairs(base)))
    split = sorted(rows(basket.item_pairs(base, chunk=5)))
    assert plain == split
    assert len(plain) >= 60 * 59 // 2 - 1


def test_price_bands(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (500.0,), (500.01,), (1000.0,), (20000.0,), (None,)],
                               "price double")
    got = {r.price_band: r.n for r in bands.price_bands(df).collect()}
    assert got == {"Budget (<500)": 1, "Economy (500-1000)": 2, "Standard (1000-2000)": 0,
                   "Premium (2000-5000)": 0, "Luxury (5000-10000)": 0, "Ultra-Luxury (>10000)": 1}


def test_segments(spark):
    df = spark.createDataFrame([(4.0, 100.0), (4.5, 300.0), (2.9, 100.0), (1.0, 400.0), (3.5, 200.0)],
                               "rating double, price double")
    got = dict(rows(bands.segmentation(df)))
    assert list(got.values()) == [1, 1, 1, 1]


def test_profit(spark):
    df = spark.createDataFrame([("10", "4", "2"), ("5", "8", None), ("x", "2", "3")],
                               "selling_price string, cost_price string, quantity string")
    r = finance.profit_loss(df).first()
    assert (r.available, r.total_profit, r.total_loss, r.net_profit) == (True, 12.0, 9.0, 3.0)
    assert r.basis == "Computed from selling_price - cost_price x quantity"
    missing = finance.profit_loss(spark.createDataFrame([(1.0,)], "price double")).first()
    assert missing.available is False and missing.note == finance.NO_COST_SELL


def test_years(spark):
    df = spark.createDataFrame([("2020-01-02", 10.0), ("2020-05-01", 5.0), ("2021-03-04", 7.0),
                                ("bad", 100.0)], "date string, spend double")
    df = schema.apply_aliases(df)  # spend -> expenditure
    per_year = dict(rows(finance.annual_expenditure_table(df)))
    assert per_year == {2020: 15.0, 2021: 7.0}
    r = finance.avg_annual_expenditure(df).first()
    assert (r.available, r.average_annual_expenditure, r.years) == (True, 11.0, "2020,2021")


def test_year_column_and_notes(spark):
    df = spark.createDataFrame([("2019", 4.0), ("2019", 6.0), ("x", 1.0)], "year string, expense double")
    df = schema.apply_aliases(df)
    assert finance.avg_annual_expenditure(df).first().average_annual_expenditure == 10.0
    none = spark.createDataFrame([(1.0,)], "price double")
    assert finance.avg_annual_expenditure(none).first().note == finance.NO_EXPENDITURE


def test_category_mode(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", None), ("p", None), ("p", None),
                                ("q", None)], "product_name string, category string")
    got = dict(rows(catalog.product_category_mode(df)))
    assert got == {"p": "a", "q": None}


def test_imputation(spark):
    df = spark.createDataFrame([(10.0,), (None,), (20.0,)], "price double")
    assert sorted(r[0] for r in rows(ingest.impute_median(df, ["price"]))) == [10.0, 15.0, 20.0]
    text = spark.createDataFrame([("10",), ("abc",), ("20",)], "price string")
    assert sorted(r[0] for r in rows(ingest.normalize(text))) == [10.0, 15.0, 20.0]
    nulls = spark.createDataFrame([(None,), (None,)], "price double")
    assert rows(ingest.impute_median(nulls, ["price"], all_null_fill=0.0)) == [(0.0,), (0.0,)]


def test_aliases():
    assert schema.alias_map(["name", "productname"]) == {"productname": "product_name"}
    assert schema.alias_map(["transaction_id", "order_id"]) == {}
    assert schema.resolve(["transaction_id", "order_id"], schema.TRANSACTION) == "transaction_id"


def test_kpis_and_profiles(spark):
    df = spark.createDataFrame([("a", 100.0, 10.0, 4.0), ("a", 300.0, 40.0, 2.0),
                                ("b", 200.0, None, None), (None, 50.0, 20.0, 5.0)],
                               "category string, price double, discount_percentage double, rating double")
    k = metrics.kpis(df).first()
    assert (k.total_products, k.total_categories) == (4, 2)
    assert k.avg_price == 162.5 and k.avg_rating == pytest.approx(11 / 3)
    assert metrics.high_discount_rating(df).first()[0] == 2.0
    p = metrics.price_profile(df).first()
    assert (p.median_price, p.min_price, p.max_price) == (150.0, 50.0, 300.0)
    bw = category.best_worst_category(df).first()
    assert (bw.best_category, bw.worst_category) == ("a", "a")
    assert metrics.price_anchor(df).first()[0] == 75.0


def test_many_equal_large_baskets_are_all_split(spark):
    # none of them is a large share of all lines
    from pyspark.sql import functions as F
    b = spark.range(0, 1000 * 30).select((F.col("id") % 1000).alias("txn"), (F.col("id") / 1000).cast("int").cast("string").alias("item"))
    assert {r.s for r in basket.split_factors(b, 10).collect()} == {3}
    assert basket.split_factors(b, 10).count() == 1000
    assert basket.split_factors(b, 30).count() == 0


def test_text_dates(spark):
    from shelfscope.operators import finance
    data = [("25/12/2021", 10.0), ("05/12/2021", 1.0), ("2021-03-04T10:00:00Z", 5.0), ("2021-03-04 10:00:00.5", 5.0),
            ("4 Mar 2021", 2.0), ("bad", 100.0), (None, 50.0), ("2020/1/2", 7.0)]
    df = spark.createDataFrame(data, "date string, expenditure double")
    assert {r.year: r.expenditure for r in finance.annual_expenditure_table(df).collect()} == {2021: 23.0, 2020: 7.0}
    row = finance.avg_annual_expenditure(df).first()
    assert row.average_annual_expenditure == 15.0 and row.note == "1 dates could not be read."
    only = {r.year for r in finance.annual_expenditure_table(df, ["dd/MM/yyyy"]).collect()}
    assert only == {2021}
    numbers = spark.createDataFrame([(20210304, 1.0)], "date int, expenditure double")
    with pytest.raises(finance.NumericDates):
        finance.annual_expenditure(numbers)


def test_sales_basis_needs_a_product(spark):
    from shelfscope.operators import catalog, narrate
    for columns, basis in (("sales_volume long", "sales_volume"), ("review_count long", "review_count"), ("x long", "unavailable")):
        df = spark.createDataFrame([(1, "a")], columns + ", product_name string")
        assert catalog.sales_basis(df) == basis == df.agg(narrate.basis_column(df)).first()[0]
        bare = df.drop("product_name")
        assert catalog.sales_basis(bare) == "unavailable" == bare.agg(narrate.basis_column(bare)).first()[0]


def test_cards_text(spark):
    data = [("o1", "tea"), ("o1", "cup"), ("o2", "tea"), ("o2", "cup"), ("o2", "jam"), ("o3", "jam")]
    df = spark.createDataFrame(data, "order_id string, product_name string")
    cards = {(r.kind, r.position): r for r in basket.bought_together_cards(df).collect()}
    first = cards[("rule", 1)]
    assert first.title == "cup ↔ tea"
    assert first.body == ("When customers purchase cup, they also purchase tea in 2 out of 3 "
                          "transactions. This happens 100.0% of the time.")
    assert first.stats == "Support: 66.7% | Confidence: 100.0%"
    tea = [r for (k, _), r in cards.items() if k == "product" and r.title == "tea"][0]
    assert tea.body.startswith("Often bought with: cup (2x), jam (1x). When customers buy tea")
    assert tea.stats == "2 complementary products identified"


def test_chart_fallback_without_sales(spark):
    from shelfscope.operators import charts
    df = spark.createDataFrame([("b-long-product-name", 10.0), ("a", 30.0), ("a", 10.0)],
                               "product_name string, price double")
    got = rows(charts.top_products(df, 20, label_width=4))
    assert got == [("a", 20.0), ("b-lo…", 10.0)]


def test_with_price_band(spark):
    df = spark.createDataFrame([(100.0,), (750.0,), (0.0,), (None,)], "price double")
    got = [r.price_band for r in bands.with_price_band(df).collect()]
    assert got == ["Budget (<500)", "Economy (500-1000)", None, None]


def test_equal_rows_without_a_key_are_split(spark):
    from shelfscope.operators import models
    df = spark.createDataFrame([("a", 100.0, 10.0, 4.0)] * 1000, "product_name string, price double, discount_percentage double, rating double")
    parts = {r.split: r["count"] for r in models.with_split(df).groupBy("split").count().collect()}
    assert models.with_split(df).columns == [*df.columns, "split"]
    assert 120 < parts["test"] < 280 and sum(parts.values()) == 1000
    volumes = models.with_synthetic_sales(df)
    assert volumes.columns == [*df.columns, "sales_volume"] and volumes.select("sales_volume").distinct().count() > 500


def test_answers_with_missing_text(spark):
    from shelfscope.operators import ask
    df = spark.createDataFrame([(None, 5.0, None, None), ("tea", 4.0, "x", None)],
                               "product_name string, price double, category string, rating double")
    got = {r.intent: r.answer for r in ask.answer_table(df, ["top_products", "rating"]).collect()}
    assert got["top_products"].startswith("Top 5 Products by Price:\n\n• nan\n  Price: ") and "Category: nan" in got["top_products"]
    assert "tea" in got["top_products"] and got["rating"]
