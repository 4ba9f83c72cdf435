"""Forests of bagged, binned regression trees whose rows are few, however long the table.

MLlib's ``RandomForestRegressor`` keeps for each row a count for each tree, and reads every row
at each level of the trees. A binned tree sees of a row only the bins of its features: rows of equal bins
(a cell) always go the same way. So the bootstrap counts are drawn for each row and tree, and
counts and labels are summed by cell and tree; the trees are grown level by level from these sums. They are the
sums that MLlib's trees take over the rows, and so are the gains of all splits (variance, all features at each node).

* ``edges``: the bins, from all rows of the training part.
* ``grown``: ``GROUP`` trees share a pass over the rows. There are at most ``BINS`` to the power of the features
  cells, dealt by tree; all trees grow a level in one job, and the driver receives their splits.
* A row's draws are hashes of its ``DRAW`` column and the tree's number, and sums are sums of whole numbers,
  so a forest does not depend on how rows are dealt to tasks.
* ``Forest.model``: the same trees as a model of MLlib's, made when it is asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Bits of a bin, bins of a feature, and trees that share a pass over the rows.
BITS, GROUP = 5, 10
BINS = 1 << BITS
#: The most often that a row is drawn for a tree (more: one in 10 billion), and gains below this share are rounding.
MOST, LEAST_GAIN = 12, 1e-12
#: Factor of Veltkamp's splitting: what is left of a double's 53 bits is 14, rounded.
SPLITTER, LARGEST = float((1 << 39) + 1), 1e290
CELL, TEST, DRAW = "_cell", "_test", "_draw"


@dataclass
class Labels:
    """Labels as whole numbers: (label - center) x size."""
    center: float
    size: float

    def whole(self, c: Column) -> Column:
        return F.rint((c - F.lit(self.center)) * F.lit(self.size)).cast("long")

    def mean(self, total: int, rows: int) -> float:
        return self.center + total / rows / self.size


def _rounded(d: Column) -> Column:
    """A double rounded to 14 bits, in the same order."""
    c = d * F.lit(SPLITTER)
    return F.when(F.abs(d) < LARGEST, c - (c - d)).otherwise(d)


def edges(data: DataFrame, train: DataFrame, names: list[str], label: str) -> tuple[list[list[float]], Labels]:
    """The least values of the second, third... bin of each feature, and what the labels of ``train`` are like.

    A feature of at most ``BINS`` values has a bin for each; otherwise bins hold about as many rows each.
    Values are counted as 14 bits of their distance from the least one of ``data``, so the counts do not grow with the table."""
    columns = [*names, label]
    finite = [F.min(F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]
    least = data.agg(*finite).first()
    low = F.element_at(F.array(*[F.lit(v if v is not None else 0.0) for v in least]), F.col("f") + 1)
    each = train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("f", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    counted = each.groupBy("f", _rounded(F.col("v") - low).alias("near")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    by, order = Window.partitionBy("f"), Window.partitionBy("f").orderBy("near")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    deep = F.call_function("div", (2 * upto - F.col("n")) * BINS, 2 * F.sum("n").over(by))
    few = F.count(F.lit(1)).over(by) <= BINS
    binned = counted.select("f", "n", "low", "high", F.when(few, F.row_number().over(order).cast("long") - 1).otherwise(deep).alias("bin"))
    found: dict[int, list] = {i: [] for i in range(len(columns))}
    for r in sorted(binned.groupBy("f", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()):
        found[r.f].append(r)  # at most BINS rows for each column
    cuts = []
    for i in range(len(names)):
        own = []
        for a, b in zip(found[i], found[i][1:]):
            middle = a.high / 2 + b.low / 2
            own.append(middle if a.high < middle <= b.low else b.low)
        # a bucketizer needs an edge; a constant feature is above its own
        cuts.append(own or [found[i][0].low if found[i] else 0.0])
    own = found[len(names)]
    rows = sum(r.n for r in own)
    if not rows:
        raise ValueError("A model needs rows to train on.")
    center = sum(r.n / rows * (r.low / 2 + r.high / 2) for r in own)
    spread = max(max(abs(r.low - center), abs(r.high - center)) for r in own)
    # as fine as their sum over all draws leaves room for
    return cuts, Labels(center, 2.0 ** (60 - math.frexp(max(spread, 1e-200) * rows * 2)[1]))


def _array(values: list[str], kind: str) -> str:
    """SQL of a constant array."""
    return f"CAST(split('{','.join(values)}', ',') AS ARRAY<{kind}>)"


def bin_name(name: str) -> str:
    return f"{name}_bin"


def bucketizer(names: list[str], cuts: list[list[float]]) -> Bucketizer:
    return Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=names, outputCols=[bin_name(n) for n in names],
                      handleInvalid="keep")


def with_cells(data: DataFrame, names: list[str], cuts: list[list[float]]) -> DataFrame:
    """``data`` with the bins of a row in one number, ``CELL``; a missing value is in the last bin."""
    bins = [F.least(F.coalesce(F.col(bin_name(n)), F.lit(float(len(c)))), F.lit(float(len(c)))).cast("long") for n, c in zip(names, cuts)]
    return bucketizer(names, cuts).transform(data).withColumn(CELL, reduce(lambda a, b: a * BINS + b, bins)).drop(*map(bin_name, names))


def drawn(h: str) -> str:
    """How often a row is drawn for a tree: Poisson of mean one, from the 64 bits of a hash. (Expressions over many trees
    are SQL text, and few enough for the JVM to compile.)"""
    shares = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k, 40)) for k in range(1, MOST + 1)]  # drawn k times or more
    return "CASE " + " ".join(f"WHEN {h} <= {(1 << 63) - 1 - int(s * 2.0 ** 64)}L THEN {k}L" for k, s in enumerate(shares)) + f" ELSE {MOST}L END"


@dataclass
class Forest:
    """Grown trees: ``splits`` of each level by node, ``means`` of the nodes (1 is a tree's root, 2n and 2n + 1 are below n)."""
    names: list[str]
    cuts: list[list[float]]
    num_trees: int
    max_depth: int
    splits: list[list[Row]]
    means: dict[tuple[int, int], tuple[float, int]]

    def placed(self, frame: DataFrame, columns: list[str], stay: bool) -> DataFrame:
        """``frame`` (``tree``, ``CELL`` and ``columns``) with the ``node`` each row is at after all splits grown so far. Where a
        node has no split, its rows stay there, or are put to node 0."""
        out = frame.selectExpr("tree", CELL, *columns, "1L AS node")
        for level, found in enumerate(self.splits):
            width, bits = 2 << level, len(self.names) * BITS
            at = ["-1"] * (self.num_trees * width)  # a node's split by its number: at most 2 ** level for each tree
            for r in found:
                at[r.tree * width + r.node] = str((bits - BITS * ((r.split >> BITS) + 1)) << BITS | r.split % BINS)
            s = f"s{level}"
            below = f"node * 2L + IF((shiftright({CELL}, shiftright({s}, {BITS})) & {BINS - 1}L) > ({s} & {BINS - 1}), 1L, 0L)"
            out = out.selectExpr("tree", CELL, *columns, f"{_array(at, 'INT')}[CAST(tree * {width}L + node AS INT)] AS {s}",
                                 f"IF({s} < 0, {'node' if stay else '0L'}, {below}) AS node")
        return out

    def predictions(self, rows: DataFrame) -> DataFrame:
        """The prediction for each cell that ``rows`` has."""
        width = 2 << self.max_depth
        means = ["0"] * (self.num_trees * width)
        for (tree, node), (mean, _) in self.means.items():
            means[tree * width + node] = repr(mean)
        each = rows.selectExpr(CELL).distinct().selectExpr(CELL, f"explode(sequence(0L, {self.num_trees - 1}L)) AS tree")
        mean = F.expr(f"{_array(means, 'DOUBLE')}[CAST(tree * {width}L + node AS INT)]")
        return self.placed(each, [], stay=True).groupBy(CELL).agg((F.sum(mean) / F.lit(float(self.num_trees))).alias("prediction"))

    def model(self) -> PipelineModel:
        """The forest as MLlib's, over the bins of the features. Its nodes have rows, means and gains; an impurity is not known (NaN)."""
        from pyspark import SparkContext

        sc = SparkContext._active_spark_context
        ml, impurity = sc._jvm.org.apache.spark.ml, sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
        found = {(r.tree, r.node): r for level in self.splits for r in level}

        def stats(mean: float, rows: int):
            three = sc._gateway.new_array(sc._jvm.double, 3)
            three[0], three[1], three[2] = float(rows), mean * rows, math.nan
            return impurity(three, rows)

        def node(tree: int, number: int):
            mean, rows = self.means[tree, number]
            r = found.get((tree, number))
            if r is None:
                return ml.tree.LeafNode(mean, math.nan, stats(mean, rows))
            split = ml.tree.ContinuousSplit(r.split >> BITS, r.split % BINS + 0.5)
            return ml.tree.InternalNode(mean, math.nan, r.gain, node(tree, 2 * number), node(tree, 2 * number + 1), split, stats(mean, rows))

        trees = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, self.num_trees)
        for t in range(self.num_trees):
            trees[t] = ml.regression.DecisionTreeRegressionModel(node(t, 1), len(self.names))
        packed = ml.regression.RandomForestRegressionModel(trees, len(self.names))
        packed.set(packed.numTrees(), self.num_trees)
        return PipelineModel([
            bucketizer(self.names, self.cuts),
            VectorAssembler(inputCols=[bin_name(n) for n in self.names], outputCol="features", handleInvalid="keep"),
            RandomForestRegressionModel(packed)])


def _bags(rows: DataFrame, label: str, labels: Labels, num_trees: int, seed: int) -> DataFrame:
    """``tree``, ``CELL``, the number ``w`` of rows drawn and the sum ``y`` of their labels, dealt by tree."""
    # in few tasks, each of which sums the rows of a cell before they are shuffled
    together = max(rows.sparkSession.sparkContext.defaultParallelism, 1)
    dealt = rows.coalesce(together).select(CELL, DRAW, labels.whole(F.col(label)).alias("y"))
    parts = []
    for first in range(0, num_trees, GROUP):
        numbers = range(first, min(first + GROUP, num_trees))
        hashed = dealt.selectExpr(CELL, "y", *[f"xxhash64({DRAW}, {seed + i}) AS h{i}" for i in numbers])
        counts = hashed.selectExpr(CELL, "y", *[f"{drawn(f'h{i}')} AS w{i}" for i in numbers])
        cells = counts.groupBy(CELL).agg(*[F.expr(e) for i in numbers for e in (f"sum(w{i}) AS w{i}", f"sum(w{i} * y) AS y{i}")])
        each = ", ".join(f"named_struct('tree', {i}L, 'w', w{i}, 'y', y{i})" for i in numbers)
        parts.append(cells.selectExpr(CELL, f"explode(array({each})) AS e").selectExpr("e.tree", CELL, "e.w", "e.y").where("w > 0"))
    return reduce(DataFrame.union, parts).repartition(num_trees, "tree")


def grown(rows: DataFrame, names: list[str], cuts: list[list[float]], label: str, labels: Labels,
          num_trees: int, max_depth: int, seed: int) -> Forest:
    """The forest of the rows with ``CELL``, ``DRAW`` and ``label``."""
    bags = _bags(rows, label, labels, num_trees, seed).persist(StorageLevel.DISK_ONLY)
    try:
        used = bags
        some = {r.tree for r in bags.select("tree").distinct().collect()}
        if len(some) < num_trees:
            # a tree for which a tiny table gave no row takes every row once
            every = rows.select(CELL, labels.whole(F.col(label)).alias("y")).groupBy(CELL).agg(F.count(F.lit(1)).alias("w"), F.sum("y").alias("y"))
            none = F.array(*[F.lit(t).cast("long") for t in range(num_trees) if t not in some])
            used = bags.union(every.select(F.explode(none).alias("tree"), CELL, "w", "y"))
        forest = Forest(names, cuts, num_trees, max_depth, [], {})
        for level in range(max_depth):
            found = [r for r in _best(forest, used).collect() if r.node >> level]  # at most 2 ** level for each tree
            if not level:
                forest.means.update({(r.tree, 1): (labels.mean(r.y, r.w), r.w) for r in found})
            splits = []
            for r in found:
                if r.best is not None:
                    b = r.best
                    splits.append(Row(tree=r.tree, node=r.node, split=-b.back, gain=b.gain / r.w / labels.size / labels.size))
                    for n, w, y in ((2 * r.node, b.wl, b.yl), (2 * r.node + 1, r.w - b.wl, r.y - b.yl)):
                        forest.means[r.tree, n] = labels.mean(y, w), w
            if not splits:
                break
            forest.splits.append(splits)
        return forest
    finally:
        bags.unpersist()


def _best(forest: Forest, bags: DataFrame) -> DataFrame:
    """The best split of each node, if any: the first of those with the most gain. All within the tasks the trees are dealt to."""
    n = len(forest.names)
    bins = ", ".join(f"(shiftright({CELL}, {BITS * (n - 1 - f)}) & {BINS - 1}L) + {f * BINS}L" for f in range(n))
    sums = forest.placed(bags, ["w", "y"], stay=False).selectExpr("tree", "node", f"explode(array({bins})) AS split", "w", "y") \
        .groupBy("tree", "node", "split").agg(F.sum("w").alias("w"), F.sum("y").alias("y"))
    by = f"PARTITION BY tree, node, shiftright(split, {BITS}) ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND"
    sides = sums.selectExpr("tree", "node", "split", *[f"sum({x}) OVER ({by} {end}) AS {name}" for x, end, name in (
        ("w", "CURRENT ROW", "wl"), ("y", "CURRENT ROW", "yl"), ("w", "UNBOUNDED FOLLOWING", "all_w"), ("y", "UNBOUNDED FOLLOWING", "all_y"))])
    square = "DOUBLE({0}) * DOUBLE({0}) / DOUBLE({1})".format
    gains = sides.selectExpr("*", f"{square('yl', 'wl')} + IF(wl < all_w, {square('(all_y - yl)', '(all_w - wl)')}, 0D) AS parts",
                             f"parts - {square('all_y', 'all_w')} AS gain")
    best = f"max(IF(gain > parts * {LEAST_GAIN!r}D, named_struct('gain', gain, 'back', -split, 'wl', wl, 'yl', yl), NULL)) AS best"
    return gains.groupBy("tree", "node").agg(F.expr(best), F.max("all_w").alias("w"), F.max("all_y").alias("y"))
