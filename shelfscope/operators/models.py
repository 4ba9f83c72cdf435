"""M1-M7: category codes, split, synthetic sales volume and forest models.

Training uses MLlib (distributed tree growing over binned features); metrics
are DataFrame aggregates over the test predictions. The columns that a model uses
are kept on the executors' disks while it is fitted and tested, so that its many
passes do not join the input anew; they are freed when the call returns. Trees are grown to ``max_depth`` with binned splits, unlike fully
grown exact trees, so scores are comparable in range, not digit for digit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import exact
from shelfscope.functions.numeric import unit_draw
from shelfscope.functions.ranking import dense_codes
from shelfscope.operators import forest, schema

TEST_FRACTION = 0.2
#: Groups among which equal rows without a key are dealt, and names of the helper columns.
DRAW_PARTS = 64
PART, NUMBER, UNIT = "_draw_part", "_draw_number", "_draw_unit"
SEED = 42
#: So many categories are broadcast to the rows.
FEW_CODES = 100_000


def row_key(df: DataFrame, key_cols: list[str] | None = None) -> Column:
    """Key for hash draws: the given columns joined by ':', or every column. Rows that are
    equal in it share a draw; ``keyed`` tells such rows apart where no key is known."""
    cols = key_cols or df.columns
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def keyed(df: DataFrame, key_cols: list[str] | None = None) -> tuple[DataFrame, list[str] | None]:
    """``df`` with the columns of its draws. Without a key, equal rows are numbered among
    themselves; they are interchangeable, so any order gives the same table. They are dealt
    in ``DRAW_PARTS`` groups of their own partitions' making, so many equal rows need no one task."""
    if key_cols:
        return df, key_cols
    dealt = df.withColumn(PART, F.pmod(F.monotonically_increasing_id(), F.lit(DRAW_PARTS)))
    order = Window.partitionBy(*df.columns, PART).orderBy(PART)
    return dealt.withColumn(NUMBER, F.row_number().over(order)), [*df.columns, PART, NUMBER]


def with_split(df: DataFrame, key_cols: list[str] | None = None,
               test_fraction: float = TEST_FRACTION) -> DataFrame:
    """M3: ``split`` = test when the md5 draw of the row key is below the fraction.
    With key columns stable under repartitioning and task retries, unlike ``randomSplit``."""
    df, key_cols = keyed(df, key_cols)
    u = unit_draw(row_key(df, key_cols))
    df = df.withColumn(UNIT, u).drop(PART, NUMBER)
    u = F.col(UNIT)
    df = df.withColumn("split", F.when(u < test_fraction, F.lit("test")).otherwise(F.lit("train")))
    return df.drop(UNIT)


def category_codes(df: DataFrame) -> DataFrame:
    """M1: sorted distinct categories -> 0..k-1 (double). Computed as a
    distributed dense rank; no label list passes through the driver."""
    return dense_codes(df, "category", "code")


def with_category_code(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Attach ``category_code``; NULL or unknown categories get k (the
    number of known categories), like a string index that keeps invalid values.
    The codes table has one row per category; AQE broadcasts it when small."""
    codes = codes if codes is not None else category_codes(df)
    k = codes.agg(F.count(F.lit(1)).cast("double")).scalar()
    return (df.join(codes.withColumnRenamed("code", "category_code"), "category", "left")
            .withColumn("category_code", F.coalesce(F.col("category_code"), k)))


def synthetic_sales(df: DataFrame, key_cols: list[str] | None = None) -> Column:
    """M5: trunc(rating x U(500, 2000) x (1 + discount/100) x (2 if price < 1000 else 1)),
    U drawn from md5 of the row key (500 + 1500 u)."""
    price = schema.resolve(df, schema.PRICE)
    u = unit_draw(row_key(df, key_cols))
    volume = (F.col("rating") * (F.lit(500.0) + F.lit(1500.0) * u)
              * (F.lit(1.0) + F.col("discount_percentage") / F.lit(100.0))
              * F.when(F.col(price) < 1000, F.lit(2)).otherwise(F.lit(1)))
    return volume.cast("long")


def with_synthetic_sales(df: DataFrame, key_cols: list[str] | None = None,
                         strict: bool = True) -> DataFrame:
    """Add ``sales_volume`` (replacing any input column). With ``strict`` a
    NULL rating or discount anywhere leaves the table unchanged, as the
    reproduced step fails as a whole; this check is one small action."""
    price = schema.resolve(df, schema.PRICE)
    if price is None or "rating" not in df.columns or "discount_percentage" not in df.columns:
        return df
    if strict:
        missing = df.agg(F.count_if(F.col("rating").isNull()
                                    | F.col("discount_percentage").isNull()).alias("m")).first()["m"]
        if missing:
            return df
    dealt, keys = keyed(df, key_cols)
    return dealt.withColumn("sales_volume", synthetic_sales(dealt, keys)).drop(PART, NUMBER)


def _mean_filled(df: DataFrame, cols: list[str], now: bool = False) -> DataFrame:
    """M2: NULL features take the column mean (one-row aggregate, scalar subqueries; ``now``: numbers,
    found once for all the passes that follow)."""
    means = exact.aggregate(df, [], [exact.mean(df, c, c) for c in cols])
    found = means.first() if now else None
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found[c]).cast("double") if now else means.select(c).scalar())
                           for c in cols})


@dataclass
class ModelResult:
    metrics: DataFrame
    forest: forest.Forest
    features: list[str]
    codes: DataFrame | None = None  # category -> code table used for the category feature

    @cached_property
    def model(self) -> PipelineModel:
        return self.forest.model()


def _regression_metrics(pred: DataFrame, label: str, with_accuracy: bool) -> DataFrame:
    ybar = exact.aggregate(pred, [], [exact.mean(pred, label, "ybar")]).scalar()
    # deviations are projected first: a subquery may not sit inside an aggregate
    dev = pred.select((F.col(label) - F.col("prediction")).alias("err"),
                      (F.col(label) - ybar).alias("dev"))
    err = F.col("err")
    stats = exact.aggregate(dev, [], [exact.mean(dev, err * err, "mse"), exact.mean(dev, F.abs(err), "mae"),
                                      exact.total(dev, err * err, "ss_res"), exact.total(dev, F.col("dev") * F.col("dev"), "ss_tot")])
    r2 = F.lit(1.0) - F.try_divide(F.col("ss_res"), F.col("ss_tot"))
    if with_accuracy:
        return stats.select((r2 * 100).alias("accuracy"), F.sqrt("mse").alias("rmse"), r2.alias("r2"))
    return stats.select(F.sqrt("mse").alias("rmse"), F.col("mae"), r2.alias("r2"))


def model_features(df: DataFrame, features: list[str], use_category: bool,
                   key_cols: list[str] | None, now: bool = False):
    """M1-M3 for a model: mean-filled features, the category code (when used)
    and the train/test split. Returns (data, feature names, codes table). ``now``: what several passes
    need of the whole table (means, few enough codes to broadcast) is found first."""
    data = _mean_filled(df, features, now)
    names = list(features)
    codes = None
    if use_category:
        codes = category_codes(df)
        if now and codes.limit(FEW_CODES + 1).count() <= FEW_CODES:
            codes = F.broadcast(codes)
        data = with_category_code(data, codes)
        names.append("category_code")
    return with_split(data, key_cols), names, codes


def rating_features(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """The exact table the rating model trains and tests on (label mean-filled)."""
    price = schema.resolve(df, schema.PRICE)
    data, _, _ = model_features(_mean_filled(df, ["rating"]), [price, "discount_percentage"],
                                "category" in df.columns, key_cols)
    return data


def _fitted(df: DataFrame, features: list[str], label: str, num_trees: int, max_depth: int,
            key_cols: list[str] | None, with_accuracy: bool, fill_label: bool = False, keep: bool = True) -> ModelResult:
    """Fit and test on ``df``, of which only the columns needed are kept; ``fill_label``: NULL labels take the mean.
    ``keep=False``: ``df`` is kept already."""
    use_category = "category" in df.columns
    used = [*features, label, *(["category"] if use_category else []), *(key_cols or df.columns)]
    plain = df.select(*dict.fromkeys(used))
    kept = plain.persist(StorageLevel.DISK_ONLY) if keep else plain
    try:
        data, names, codes = model_features(_mean_filled(kept, [label], True) if fill_label else kept, features, use_category, key_cols, True)
        pred, trees = _fit(data, names, label, num_trees, max_depth, key_cols)
        try:
            scores = _regression_metrics(pred, label, with_accuracy)
            metrics = df.sparkSession.createDataFrame(scores.collect(), scores.schema)  # one row
        finally:
            pred.unpersist()
    finally:
        if keep:
            kept.unpersist()
    plain = df.select(*dict.fromkeys(used))
    return ModelResult(metrics, trees, names, category_codes(plain) if codes is not None else None)


def _fit(data: DataFrame, names: list[str], label: str, num_trees: int, max_depth: int, key_cols: list[str] | None):
    """The forest of the training rows (``forest``), and its predictions for the test rows, kept on disk.

    Bootstrap counts are drawn from the key and the values of a row, without a key from its place in the table."""
    train = F.col("split") == "train"
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in (*names, label)])
    own = F.xxhash64(*[F.col(c) for c in dict.fromkeys([*key_cols, *names, label])]) if key_cols \
        else F.xxhash64(F.monotonically_increasing_id())
    cuts, labels = forest.edges(data, data.where(train), names, label)
    wrong = F.raise_error(F.lit("Labels and features of the training rows must not be null or NaN"))
    rows = forest.with_cells(data, names, cuts).select(
        F.when(train & bad, wrong.cast("long")).otherwise(F.col(forest.CELL)).alias(forest.CELL), (~train).alias(forest.TEST),
        F.col(label).cast("double").alias(label), own.alias(forest.DRAW)).persist(StorageLevel.DISK_ONLY)
    try:
        trees = forest.grown(rows.where(~F.col(forest.TEST)), names, cuts, label, labels, num_trees, max_depth, SEED)
        test = rows.where(forest.TEST)
        # at most BINS ** len(names) cells, so their predictions are broadcast
        pred = test.join(F.broadcast(trees.predictions(test)), forest.CELL).select(label, "prediction")
        pred = pred.persist(StorageLevel.DISK_ONLY)
        pred.count()
        return pred, trees
    finally:
        rows.unpersist()


def rating_model(df: DataFrame, num_trees: int = 100, max_depth: int = 10,
                 key_cols: list[str] | None = None, keep: bool = True) -> ModelResult | None:
    """M4: forest predicting rating from price, discount (+ category code).
    NULL targets take the mean rating. Returns None when a role is missing."""
    price = schema.resolve(df, schema.PRICE)
    if price is None or "discount_percentage" not in df.columns or "rating" not in df.columns:
        return None
    return _fitted(df, [price, "discount_percentage"], "rating", num_trees, max_depth, key_cols, True, fill_label=True, keep=keep)


def sales_model(df: DataFrame, num_trees: int = 100, max_depth: int = 10,
                key_cols: list[str] | None = None, keep: bool = True) -> ModelResult | None:
    """M6: forest predicting ``sales_volume`` from price, discount, rating
    (+ category code). Rows without a volume are not used."""
    price = schema.resolve(df, schema.PRICE)
    if price is None or "sales_volume" not in df.columns:
        return None
    data = df.where(F.col("sales_volume").isNotNull()) \
        .withColumn("sales_volume", F.col("sales_volume").cast("double"))
    return _fitted(data, [price, "discount_percentage", "rating"], "sales_volume", num_trees, max_depth, key_cols, False, keep=keep)
