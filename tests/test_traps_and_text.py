"""Ingest traps, routing, narration and the CSV source."""

import os
import tempfile

import pytest

from conftest import rows
from shelfscope.operators import ask, catalog, narrate, schema
from shelfscope.sources import files

ROUTING = [
    ("How many products?", "count"),
    ("Best performing category?", "overview"),
    ("Average rating?", "rating"),
    ("Highest revenue products?", "revenue"),
    ("Discount insights?", "discount"),
    ("Price insights?", "price"),
    ("Products sold together?", "associations"),
    ("What is market basket?", "concept_market_basket"),
    ("Top product by revenue?", "top_products"),
    ("How many discounts?", "discount"),
    ("   ", "empty"),
]


def test_routing(spark):
    qs = spark.createDataFrame([(q,) for q, _ in ROUTING], "question string")
    got = dict(rows(ask.question_intents(qs)))
    assert got == dict(ROUTING)


def test_answers(spark):
    df = spark.createDataFrame(
        [("o1", "tea", "a", 100.0, 10.0, 4.0), ("o1", "cup", "b", 2000.0, 40.0, 2.0),
         ("o2", "tea", "a", 300.0, 20.0, 3.0)],
        "order_id string, product_name string, category string, price double, "
        "discount_percentage double, rating double")
    qs = spark.createDataFrame([("How many products?",), ("Rating?",), ("bought together?",),
                                ("what is average price",)], "question string")
    got = {r.intent: r.answer for r in ask.answer_questions(df, qs).collect()}
    assert got["count"] == "Total Products: 3"
    assert got["rating"] == ("Rating Insights:\n\n• Average Rating: 3.0/5\n• Best Rating: 4.0/5\n"
                             "• Lowest Rating: 2.0/5")
    assert got["associations"].startswith("Top Product Pairs (sold together):\n\n• cup + tea (Count: 1, "
                                          "Support: 50.00%)")
    assert got["concept_average_price"] == "Average price is ₹800."


def test_recommendations_and_overview(spark):
    df = spark.createDataFrame([("a", 100.0, 40.0, 2.0), ("b", 1500.0, 0.0, 4.5)],
                               "category string, price double, discount_percentage double, rating double")
    lines = [r.line for r in narrate.recommendations(df).orderBy("position").collect()]
    named = df.withColumn("product_name", df["category"])
    named_lines = [r.line for r in narrate.recommendations(named).orderBy("position").collect()]
    # without a product column there is no basis for top sellers, and no line about them
    assert lines == named_lines[:-1]
    assert named_lines == [
        "1 products have low ratings (<3.0). Improve quality, listings, or consider discontinuation.",
        "1 products have high discount but low rating. Review quality or positioning.",
        "Price anchor: high-rated products cluster around ₹1,500. Keep new launches near this band.",
        "Best performing category: b", "Category needing improvement: a",
        "Top sellers are based on sales_volume. Use these items for bundles, ads, and cross-sell placement."]
    text = narrate.general_insights(df).first().text
    assert text.split("\n") == ["Data Overview: 2 products analyzed", "Categories: 2 unique categories",
                                "Price Range: ₹100 - ₹1,500", "Average Price: ₹800",
                                "Average Rating: 3.2/5", "Average Discount: 20.0%"]
    bare = spark.createDataFrame([("x",)], "sku string")
    assert [r.line for r in narrate.recommendations(bare).collect()] == [narrate.FALLBACK]


def test_header_fold_and_collision(spark):
    df = spark.createDataFrame([(1, 2)], "` Price ` int, `Discount %` int")
    assert schema.fold_headers(df).columns == ["price", "discount %"]
    assert schema.fold_headers(df, strict=False).columns == ["price", "discount%"]
    dup = spark.createDataFrame([(1, 2)], "price int, `PRICE ` int")
    with pytest.raises(schema.HeaderCollision):
        schema.fold_headers(dup)


def test_csv_source_traps(spark):
    folder = tempfile.mkdtemp(prefix="shelfscope-csv-")
    path = os.path.join(folder, "shop.csv")
    with open(path, "w") as fh:
        fh.write("ProductName, MRP ,User_Rating,Discount\n")
        fh.write("tea,10,4.5,NA\n")
        fh.write("cup,abc,NaN,20%\n")
        fh.write('jam,20,"\t3.5 ",5\n')
        fh.write("pen,5d,null,10\n")
    df = files.read_table(spark, path)
    assert df.columns == ["product_name", "price", "rating", "discount_percentage"]
    got = {r.product_name: (r.price, r.rating, r.discount_percentage) for r in df.collect()}
    # 'abc' and '5d' are not numbers -> median of 10, 20 = 15; rating median of 4.5, 3.5 = 4.0
    assert got["cup"] == (15.0, 4.0, None)
    assert got["pen"] == (15.0, 4.0, 10.0)
    assert got["jam"] == (20.0, 3.5, 5.0)
    with pytest.raises(ValueError, match="neither CSV nor Parquet"):
        files.check_format(os.path.join(folder, "shop.txt"))
    with pytest.raises(ValueError, match="save the sheet as CSV"):
        files.check_format(os.path.join(folder, "shop.xlsx"))
    with pytest.raises(ValueError):  # a remote folder is listed, never guessed
        files.check_format("s3a://bucket/shop/")
    assert files.check_format("s3a://bucket/shop", fmt="parquet") == "parquet"
    assert files.check_format(folder, spark=spark) == "csv"
    pq_dir = tempfile.mkdtemp(prefix="shelfscope-pq-")
    spark.createDataFrame([("tea", 1.0)], "name string, price double").write.mode("overwrite").parquet(pq_dir)
    assert files.check_format(pq_dir, spark=spark) == "parquet"
    assert files.read_table(spark, pq_dir).columns == ["product_name", "price"]


def test_nan_is_null_and_null_keys(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 4.0), (None, 1.0)],
                               "category string, rating double")
    from shelfscope.operators import category, ingest
    clean = ingest.coerce_numeric(df, ["rating"])
    assert rows(category.category_rating(clean)) == [("a", 4.0)]


def test_catalog_views(spark):
    products = spark.createDataFrame(
        [("Red Ring", "x", 5.0, None), ("blue bolt", "y", None, 3.0), ("ring", "x", 7.0, 4.0)],
        "product_name string, category string, price double, rating double")
    assert {r[0] for r in rows(catalog.search(products, "RING"), "product_name")} == {"Red Ring", "ring"}
    assert rows(catalog.search(products, "^r.*g$", "regex"), "product_name") == [("Red Ring",), ("ring",)] \
        or {r[0] for r in rows(catalog.search(products, "^r.*g$", "regex"), "product_name")} == {"Red Ring", "ring"}
    assert rows(catalog.filter_category(products, "All"), "product_name").__len__() == 3
    page = rows(catalog.catalog_page(products, "price_high", 3), "product_name", "position")
    assert page == [("ring", 1), ("Red Ring", 2), ("blue bolt", 3)]
    js = rows(catalog.catalog_page(products, "rating_low", 3, nulls="js"), "product_name")
    assert js[0] == ("Red Ring",)


def test_csv_folder_of_parts(spark):
    folder = tempfile.mkdtemp(prefix="shelfscope-parts-")
    for i, rows_ in enumerate([["tea,10,4.0", "cup,30,2.0"], ["jam,20,3.0"]]):
        with open(os.path.join(folder, f"part-{i}.csv"), "w") as fh:
            fh.write("Name,Price,Rating\n" + "\n".join(rows_) + "\n")
    df = files.read_table(spark, folder)
    assert df.columns == ["product_name", "price", "rating"]
    assert sorted(rows(df)) == [("cup", 30.0, 2.0), ("jam", 20.0, 3.0), ("tea", 10.0, 4.0)]
    dup = os.path.join(tempfile.mkdtemp(prefix="shelfscope-dup-"), "dup.csv")
    with open(dup, "w") as fh:
        fh.write("price,Price \n1,2\n")
    with pytest.raises(schema.HeaderCollision):
        files.read_table(spark, dup)


def test_missing_roles_give_empty_results(spark):
    from shelfscope.operators import (bands, basket, category, charts, finance, metrics,
                                      models)
    only_names = spark.createDataFrame([("tea",), ("cup",)], "product_name string")
    empty_ops = [category.category_revenue, category.category_rating, category.avg_price_by_category,
                 category.avg_discount_by_category, category.best_worst_category,
                 category.category_top_rating_with_count, category.category_top_revenue,
                 category.category_list, bands.price_bands, bands.segmentation,
                 metrics.low_rated, metrics.discount_rating_gap, metrics.high_discount_rating,
                 metrics.price_anchor, metrics.discount_profile, metrics.rating_profile,
                 metrics.price_profile, catalog.product_category_mode, catalog.product_sales,
                 catalog.top_selling_products, catalog.top_by_price, finance.annual_expenditure,
                 charts.category_distribution, charts.rating_distribution]
    for op in empty_ops:
        assert op(only_names).count() == 0, op.__name__
    assert rows(catalog.product_list(only_names)) == [("cup",), ("tea",)]
    assert metrics.kpis(only_names).first().total_categories == 0
    assert finance.profit_loss(only_names).first().available is False
    assert models.rating_model(only_names) is None
    assert basket.association_meta(only_names).first().note.startswith("Transaction ID")
    assert narrate.general_insights(only_names).first().text == "Data Overview: 2 products analyzed"
    no_product = spark.createDataFrame([(1.0,)], "price double")
    assert catalog.product_list(no_product).count() == 0
    assert charts.top_products(no_product).count() == 0


def _written(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", encoding="utf8", newline="") as f:
            f.write(text)
    return folder


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    folder = _written(f"{tmp_path}/q", a='product_name,price,category\n"12"" pan, steel",10.5,kitchen\n"two\nlines",3,"a,b"\n')
    got = {tuple(r) for r in files.read_table(spark, folder).select("product_name", "price", "category").collect()}
    assert got == {('12" pan, steel', 10.5, "kitchen"), ("two\nlines", 3.0, "a,b")}


def test_csv_folder_with_differing_columns(spark, tmp_path):
    folder = _written(f"{tmp_path}/d", a="product_name,price,rating\ntea,20,4\n", b="price,product_name,rating\n10,cup,3\n",
                      c="product_name,price\njam,5\n")
    open(f"{folder}/_SUCCESS", "w").close()
    got = {tuple(r) for r in files.read_table(spark, folder, impute=False).select("product_name", "price", "rating").collect()}
    assert got == {("tea", 20.0, 4.0), ("cup", 10.0, 3.0), ("jam", 5.0, None)}


def test_csv_rows_of_another_width_fail(spark, tmp_path):
    folder = _written(f"{tmp_path}/w", a="product_name,price\ntea,20,4\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_table(spark, folder).collect()


def test_partitioned_parquet_folder(spark, tmp_path):
    spark.createDataFrame([("tea", 1.0, 7), ("cup", 2.0, 8)], "name string, price double, day int").write.partitionBy("day").parquet(f"{tmp_path}/p")
    df = files.read_table(spark, f"{tmp_path}/p")
    assert sorted(df.columns) == ["day", "price", "product_name"] and df.count() == 2


def test_view_survives_csv(spark, tmp_path):
    from conftest import SF_SMALL
    from shelfscope.sources.retail_view import retail_view
    view = retail_view(spark, SF_SMALL).select("order_id", "product_name", "category", "price", "rating", "quantity")
    view.write.option("header", True).option("escape", '"').csv(f"{tmp_path}/v")
    back = files.read_csv(spark, f"{tmp_path}/v")
    same = back.select(*[back[f.name].cast(f.dataType).alias(f.name) for f in view.schema])
    assert same.exceptAll(view).count() == 0 and view.exceptAll(same).count() == 0


def test_json_sink_keeps_null_fields(spark, tmp_path):
    import json
    df = spark.createDataFrame([(None, 1)], "note string, n int")
    (folder,) = files.write_insights({"x": df}, str(tmp_path))
    lines = [line for name in os.listdir(folder) if name.endswith(".json") for line in open(os.path.join(folder, name))]
    assert json.loads(lines[0]) == {"note": None, "n": 1}
