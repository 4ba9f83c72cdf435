"""Severity of toxic text by cumulative-link ordinal regression.

    P(grade <= k) = sigmoid(t_k - w . x),  t_0 < t_1 < ...

One weight vector w is shared by all thresholds t_k, which are kept in order by
fitting the logarithms of their distances. x tells which words, and which word
beginnings, of a vocabulary a text holds. The expected severity is the sum over k
of P(grade > k).

The fit takes a bounded sample of labelled rows (``SAMPLE_ROWS``, by a hash of the
id). Every feature that ``LEAST_TEXTS`` of them hold takes part, however many there
are, and the penalty leaves most weights at zero. So the fit grows its set of features: Spark
sums each feature's slope of the likelihood over the sampled rows, the steepest
``AT_ONCE`` of those beyond the penalty join, the driver fits the weights of the joined
ones, and this is repeated until no feature outside is beyond the penalty, which is where
the optimum over all features lies. The driver never holds the other features. Every
document is scored over its whole text.

Cases: null text counts as empty and, like a text without known words, gets the
thresholds' own severity; without labelled rows, or with one grade only, all
texts get that grade; labels that contradict each other count by the highest;
null grades and labels without a document do not count; repeated rows and null
ids are scored row by row; an empty table gives an empty one; other columns of
the input do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import map_batches, string_list, whole_text

#: Bound of the fit: labelled rows.
SAMPLE_ROWS = 20_000
#: A feature of fewer sampled texts says nothing about others.
LEAST_TEXTS = 5
PENALTY, STEPS = 3e-4, 500
#: Features that join the fit in one round; the rounds go on until none is left to join.
AT_ONCE = 500
#: A feature outside is left there if its slope is beyond the penalty by no more than the steps' own error.
SLACK = 1.01
#: Slopes are summed as integers, so that they do not depend on the order of rows.
UNIT = 1 << 40
#: Steps end early once no parameter moves further than this.
SETTLED = 1e-5

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features beside the words, the shortest first.
BEGINNINGS = (5, 6, 7, 8)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]  # t_k, in order

    @cached_property
    def heads(self) -> frozenset[str]:
        """What a word must begin with to have a beginning with a weight."""
        return frozenset(w[:BEGINNINGS[0]] for w in self.weights if w.endswith("-"))

    def above(self, text: str) -> list[float]:
        """P(grade > k) for each k."""
        words = set(_WORD.findall(text.lower()))
        words |= beginnings([w for w in words if w[:BEGINNINGS[0]] in self.heads])
        score = sum(self.weights[w] for w in sorted(words & self.weights.keys()))
        return [1 / (1 + math.exp(max(-500.0, min(500.0, t - score)))) for t in self.thresholds]


def words_of(text: str) -> set[str]:
    """Words of a text and, marked by a dash, the beginnings of the longer ones."""
    words = set(_WORD.findall(text.lower()))
    return words | beginnings(words)


def beginnings(words: Iterable[str]) -> set[str]:
    return set().union(*({w[:n] + "-" for w in words if len(w) > n} for n in BEGINNINGS))


def grade_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade"))


def _sample(docs: DataFrame, grades: DataFrame, rows: int) -> DataFrame:
    """Words and grade of at most ``rows`` labelled documents; grades are sent to all tasks, so few."""
    chosen = (grades.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.max("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows))
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # one text of an id

    def per_batch(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"),
                "words": [sorted(words_of(t)) for t in string_list(batch.column("text"))]}

    return map_batches(texts.select("doc_id", "grade", "text"), per_batch, "doc_id long, grade int, words array<string>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _thresholds_alone(grades: np.ndarray, top: int) -> np.ndarray:
    """Thresholds that give each grade its share of the rows."""
    share = np.bincount(grades, minlength=top + 1).cumsum()[:-1] / len(grades)
    return np.log(share) - np.log1p(-share)


def _slopes(sample: DataFrame, ids: np.ndarray, scores: np.ndarray, cuts: np.ndarray, grades: np.ndarray, least: int) -> DataFrame:
    """(word, slope): n times the likelihood's slope along each feature that ``least`` rows hold, in parts of ``UNIT``."""
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    by_row = 1 - _sigmoid(edges[grades] - scores) - _sigmoid(edges[grades + 1] - scores)
    table = pa.table({"doc_id": ids, "part": np.rint(by_row * UNIT).astype(np.int64)})
    parts = sample.sparkSession.createDataFrame(table)  # as many rows as the sample, which is bounded
    return (sample.join(F.broadcast(parts), "doc_id").select("part", F.explode("words").alias("word"))
            .groupBy("word").agg(F.count("*").alias("texts"), F.sum("part").alias("slope"))
            .where(F.col("texts") >= least).select("word", "slope"))


def _holders(sample: DataFrame, words: list[str], after: int) -> pa.Table:
    """(doc_id, place) of every sampled row and each of ``words`` it holds; places count from ``after``."""
    places = sample.sparkSession.createDataFrame(pa.table({"word": words, "place": np.arange(after, after + len(words))}))
    pairs = sample.select("doc_id", F.explode("words").alias("word")).join(F.broadcast(places), "word")
    return pairs.select("doc_id", F.col("place").cast("int").alias("place")).toArrow()


def cumulative_link(starts: np.ndarray, at: np.ndarray, grades: np.ndarray, width: int, top: int,
                    steps: int = STEPS, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the most likely model with an absolute penalty on the weights.

    Accelerated proximal gradient steps, so most weights end at zero. Row i has the features ``at[starts[i]:starts[i + 1]]`` and a
    grade from 0 to ``top``. ``known`` holds the weights of the first features and the thresholds to begin with.
    """
    n = len(grades)
    row = np.repeat(np.arange(n), np.diff(starts))
    first, begin = known if known else (np.zeros(0), _thresholds_alone(grades, top))
    # parameters: weights, first threshold, logarithms of the distances to the next ones
    value = np.concatenate([first, np.zeros(width - len(first)), begin[:1], np.log(np.diff(begin) + 1e-3)])
    # the largest curvature bounds the step
    v = np.ones(width + 1)
    for _ in range(20):
        product = np.bincount(row, weights=v[at], minlength=n) + v[width]
        v = np.append(np.bincount(at, weights=product[row], minlength=width), product.sum()) / n
        curve = np.linalg.norm(v)
        v /= curve
    rate = 1 / (0.3 * curve + 0.5)
    ahead, momentum = value, 1.0
    for _ in range(steps):
        w, gaps = ahead[:width], np.exp(ahead[width + 1:])
        cuts = np.concatenate([[-np.inf], ahead[width] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(row, weights=w[at], minlength=n)
        low, high = _sigmoid(cuts[grades] - s), _sigmoid(cuts[grades + 1] - s)
        p = np.maximum(high - low, 1e-12)
        down = np.zeros_like(value)  # gradient of the mean negative log likelihood
        down[:width] = np.bincount(at, weights=((1 - high - low) / n)[row], minlength=width)
        by_cut = (np.bincount(grades, weights=-high * (1 - high) / p, minlength=top + 1)[:top]
                  + np.bincount(grades, weights=low * (1 - low) / p, minlength=top + 1)[1:]) / n
        from_here = by_cut[::-1].cumsum()[::-1]  # a distance moves all later thresholds
        down[width] = from_here[0]
        down[width + 1:] = from_here[1:] * gaps
        following = ahead - rate * down
        following[:width] = np.sign(following[:width]) * np.maximum(np.abs(following[:width]) - rate * PENALTY, 0)
        if (ahead - following) @ (following - value) > 0:
            momentum = 1.0  # the momentum points uphill: start it anew
        longer = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = following + (momentum - 1) / longer * (following - value)
        moved = np.abs(following - value).max()
        value, momentum = following, longer
        if moved < SETTLED:
            break
    gaps = np.exp(value[width + 1:])
    return value[:width], value[width] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit(docs: DataFrame, grades: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the documents that ``grades`` (doc_id, grade from 0 up) names."""
    sample = _sample(docs, grades, rows).persist()
    try:
        table = sample.select("doc_id", "grade").toArrow().sort_by("doc_id")
        ids, own = table.column("doc_id").to_numpy(), table.column("grade").to_numpy()
        present = np.unique(own).tolist()
        if len(present) < 2:
            return Model({}, (-500.0,) * (present[0] if present else 0))
        grades_at = np.searchsorted(present, own)  # a grade that no row has gets no threshold of its own
        n, top = len(ids), len(present) - 1
        words, row, at = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, cuts, scores = np.zeros(0), _thresholds_alone(grades_at, top), np.zeros(n)
        while True:
            slopes = _slopes(sample, ids, scores, cuts, grades_at, min(LEAST_TEXTS, n))
            size = F.abs("slope")
            steep = slopes.where(size > int(PENALTY * SLACK * n * UNIT)).orderBy(size.desc(), "word").limit(AT_ONCE + len(words))
            found = steep.toArrow().column("word").to_pylist()
            held = set(words)
            joining = [x for x in found if x not in held][:AT_ONCE]
            if not joining:
                break
            pairs = _holders(sample, joining, len(words))
            words += joining
            row = np.concatenate([row, np.searchsorted(ids, pairs.column("doc_id").to_numpy())])
            at = np.concatenate([at, pairs.column("place").to_numpy()])
            order = np.lexsort((at, row))  # the same sums, in whatever order the pairs came
            row, at = row[order], at[order]
            starts = np.searchsorted(row, np.arange(n + 1))
            w, cuts = cumulative_link(starts, at, grades_at, len(words), top, known=(w, cuts))
            scores = np.bincount(row, weights=w[at], minlength=n)
        weights = {words[k]: float(w[k]) for k in np.flatnonzero(w)}
        by_grade = dict(zip(present[:-1], cuts.tolist(), strict=True))
        thresholds, last = [], -500.0
        for k in range(present[-1]):  # grades below the least one, or missing in between, share a bound
            last = by_grade.get(k, last)
            thresholds.append(last)
        return Model(weights, tuple(thresholds))
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity and the most likely grade's lower bound: thresholds passed at one half."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch: pa.RecordBatch) -> dict:
        above = [sent.value.above(t) for t in string_list(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "expected_severity": [sum(a) for a in above], "grade": [sum(p >= 0.5 for p in a) for a in above]}

    rows = docs.select("doc_id", whole_text().alias("text"))
    return map_batches(rows, per_batch, "doc_id long, expected_severity double, grade int")


def toxicity_report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every document with its expected severity, grade, and whether it is rejected (grade 1 or more)."""
    scored = score(docs, fit(docs, grade_of_labels(labels), rows))
    return scored.select("doc_id", "expected_severity", "grade", (F.col("grade") >= 1).alias("rejected"))


def reject_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows whose text has grade 1 or more."""
    model = fit(docs, grade_of_labels(labels), rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda t: not sum(p >= 0.5 for p in sent.value.above(t or "")[:1]))

    return docs.where(clean(whole_text()))
