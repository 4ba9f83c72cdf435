"""E1 composite, the insight sink, and questions answered as a stream."""

import os
import tempfile

from conftest import SF_SMALL
from shelfscope.plans.insights import insights
from shelfscope.sources import files
from shelfscope.sources.retail_view import retail_view
from shelfscope.streaming import questions as qstream


def test_insights_composite_and_sink(spark):
    view = retail_view(spark, SF_SMALL)
    out = insights(view, key_cols=["order_id", "line_no", "part_key", "supp_key"],
                   fit_models=False)
    for key in ["kpis", "top_categories_by_revenue", "price_band_distribution", "segmentation",
                "product_list", "recommendations", "profit_loss", "avg_annual_expenditure",
                "association_rules", "association_by_product", "association_meta"]:
        assert key in out, key
    # ratings have NULLs (every 50th order), so the synthetic volume is not added
    assert "sales" in out["product_list"].columns
    assert out["kpis"].first().total_products == view.count()
    target = tempfile.mkdtemp(prefix="shelfscope-sink-")
    written = files.write_insights({"kpis": out["kpis"], "segmentation": out["segmentation"]}, target)
    assert all(os.path.isdir(p) for p in written)
    assert spark.read.json(written[1]).count() == 4
    view.unpersist()


def test_questions_stream(spark):
    view = retail_view(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="shelfscope-q-")
    spark.createDataFrame([("How many products?",), ("Price insights?",), ("hello",)],
                          qstream.QUESTION_SCHEMA).write.mode("append").json(src)
    answers = qstream.frozen_answers(view)
    stream = spark.readStream.schema(qstream.QUESTION_SCHEMA).json(src)
    query = (qstream.answer_stream(stream, answers).writeStream.format("memory")
             .queryName("answered").outputMode("append").start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.intent: r.answer for r in spark.sql("SELECT * FROM answered").collect()}
    assert got["count"] == f"Total Products: {view.count():,}"
    assert got["price"].startswith("Price Insights:")
    assert got["overview"].startswith("Data Overview:")


def test_questions_stream_to_files(spark):
    view = retail_view(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="shelfscope-stream-")
    src, sink, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    spark.createDataFrame([("What is rating?",), ("Which category is best?",)],
                          qstream.QUESTION_SCHEMA).write.json(src)
    query = qstream.start(spark, view, src, sink, ckpt)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.intent: r.answer for r in spark.read.json(sink).collect()}
    assert got["concept_rating"].startswith("Rating is the average score")
    assert got["category_rating"].startswith("Best Performing Categories:")


def test_command_line(spark, capsys):
    from shelfscope.__main__ import main
    folder = tempfile.mkdtemp(prefix="shelfscope-cli-")
    path = os.path.join(folder, "shop.csv")
    with open(path, "w") as fh:
        fh.write("Transaction_ID,ProductName,Categories,MRP,User_Rating,Discount\n")
        fh.write("t1,tea,drinks,10,4.5,40\nt1,cup,kitchen,30,2.0,10\nt2,tea,drinks,12,4.0,0\n")
    assert main(["ask", path, "How many products?", "Which products are bought together?"]) == 0
    printed = capsys.readouterr().out
    assert "Total Products: 3" in printed
    assert "• cup + tea (Count: 1, Support: 50.00%)" in printed
    out_dir = os.path.join(folder, "out")
    assert main(["analyze", path, out_dir, "--no-models"]) == 0
    assert files.read_insights(spark, out_dir)["kpis"].first().total_products == 3


def test_insights_with_checkpointed_base(spark):
    view = retail_view(spark, SF_SMALL)
    out = insights(view, key_cols=["order_id", "line_no", "part_key", "supp_key"],
                   fit_models=False, base="checkpoint")
    assert out["kpis"].first().total_products == view.count()


def test_materialized_view_matches(spark):
    from shelfscope.operators import basket
    from shelfscope.sources.retail_view import materialize_view, read_materialized
    target = os.path.join(tempfile.mkdtemp(prefix="shelfscope-view-"), "retail")
    materialize_view(spark, SF_SMALL, target)
    stored = read_materialized(spark, target)
    live = retail_view(spark, SF_SMALL)
    assert stored.schema.simpleString() == live.schema.simpleString()
    assert stored.count() == live.count()
    a = sorted(tuple(r) for r in basket.association_rules(stored).collect())
    b = sorted(tuple(r) for r in basket.association_rules(live).collect())
    assert a == b


def test_checkpoint_dir_rule(spark):
    from shelfscope.session import checkpoint_dir
    current = spark.conf.get("spark.checkpoint.dir")  # set by the test fixture
    other = tempfile.mkdtemp(prefix="shelfscope-other-")
    # an existing setting wins over any fallback
    assert checkpoint_dir(spark, other) == current
    assert spark.conf.get("spark.checkpoint.dir") == current
