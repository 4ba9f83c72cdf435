"""Language identification by levels: family first, then languages within it.

Texts are described by hashed character n-grams (one to three characters, over
the whole text, scaled to length one). One-versus-one linear support vector
machines tell families apart, and inside the winning family others tell its
languages apart; each level goes to the class with most votes, then the larger
sum of margins. A family or language that is alone needs no machine. More than
``WIDTH`` classes of a level are grouped by name, under further levels, so the number of
machines grows with the number of languages and not with its square.

The machines are fitted in parallel, each in a task of its own, on at most
``PER_LANGUAGE`` labelled rows of each language that has any
(for families and groups about ``PER_FAMILY`` of each), taken by a hash of the id. Every
document is predicted from its whole text alone.

Cases: a null text, or one without a letter, is ``und`` with score 0; without
labelled rows every text is ``und``; one learned language is given to all other
texts with score 1; languages of no listed family are a family of their own;
repeated rows and null ids are predicted row by row; an empty table gives an empty
one; other columns of the input do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import map_batches, string_list, whole_text

UNKNOWN = "und"
PER_LANGUAGE, PER_FAMILY = 400, 1200
#: Classes that a level tells apart.
WIDTH = 16
BITS, ROUNDS, COST = 12, 30, 10.0

# Families of language codes (fixed values).
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "malayo-polynesian": ("id", "jv", "mg", "ms", "tl"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.split("-")[0].lower(), language)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


_PLAIN = np.arange(128, dtype=np.uint32)  # ASCII that is no letter counts as a blank
_PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32


def features(text: str) -> np.ndarray:
    """Scaled counts of hashed n-grams of a whole text."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    ascii_ = code < 128
    code[ascii_] = _PLAIN[code[ascii_]]
    counts = np.zeros(1 << BITS)
    gram = np.zeros(len(code), dtype=np.uint32)
    for size in (1, 2, 3):
        gram = gram[:len(code) - size + 1] * np.uint32(0x01000193) + code[size - 1:]
        slot = ((gram ^ np.uint32(size * 0x1BD1E995)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        counts += np.bincount(slot, minlength=1 << BITS)
    return counts / max(np.sqrt((counts * counts).sum()), 1e-12)


@dataclass(frozen=True)
class Level:
    """One-versus-one machines over some classes: for (a, b) a margin above zero is a vote for b."""

    classes: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << BITS)))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The winning class and how sure its machines are, on the average."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.weights @ x + self.biases
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[b if m > 0 else a] += 1
            sums[a] -= m
            sums[b] += m
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sums[k]))
        own = [m if b == best else -m for (a, b), m in zip(self.pairs, margins, strict=True) if best in (a, b)]
        return self.classes[best], sum(1 / (1 + math.exp(-max(-50.0, min(50.0, 2 * m)))) for m in own) / len(own)


@dataclass
class Node:
    """A group of languages: a level over its members, or a single language."""

    name: str
    members: list[Node] = field(default_factory=list)
    level: Level | None = None

    def languages(self) -> list[str]:
        return [k for m in self.members for k in m.languages()] if self.members else [self.name]


def _grouped(nodes: list[Node]) -> list[Node]:
    """At most ``WIDTH`` nodes that hold the given ones, in order of their names."""
    while len(nodes) > WIDTH:
        nodes = [Node(f"{nodes[i].name}..", nodes[i:i + WIDTH]) for i in range(0, len(nodes), WIDTH)]
    return nodes


def grouping(languages: list[str]) -> Node:
    """The tree of families, groups and languages."""
    members: dict[str, list[Node]] = {}
    for language in sorted(languages):
        members.setdefault(family_of(language), []).append(Node(language))
    return Node("", _grouped([Node(f, _grouped(members[f])) for f in sorted(members)]))


@dataclass(frozen=True)
class Model:
    root: Node | None

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.root is None or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        x, node, sure = features(text), self.root, 1.0
        while node.members:
            name, own = node.level.decide(x)
            node = node.members[node.level.classes.index(name)]
            sure *= own
        return node.name, sure


def held_out() -> Column:
    """Documents that the fit must not see; without an id there is nothing to hold out by."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, with their features."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    ids = labelled.select("doc_id", "lang").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    # by the hash about a quarter more than needed is left of a language; the exact number follows
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = ids.join(sizes, "lang").where(place * F.col("n") <= 1.25 * per_language + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = chosen.select("doc_id", "lang", "rank")
    texts = labelled.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text"))

    def per_batch(batch: pa.RecordBatch) -> dict:
        found = [features(t) for t in string_list(batch.column("text"))]
        return {"lang": batch.column("lang"), "rank": batch.column("rank"), "at": [np.flatnonzero(x).tolist() for x in found],
                "value": [x[np.flatnonzero(x)].tolist() for x in found]}

    return map_batches(texts.select("lang", "rank", "text"), per_batch,
                       "lang string, rank int, at array<int>, value array<double>")


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss; y is -1 or 1.

    Dual coordinate descent: each row's multiplier is set to its best value in
    turn, in an order that a fixed seed shuffles.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    soft = 1 / (2 * cost)
    size = (x * x).sum(axis=1) + soft
    shuffled = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in shuffled.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + soft * alpha[i]
            step = max(alpha[i] - slope / size[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def _machines(rows: DataFrame, plan: list[tuple[int, str, float, int]]) -> dict[int, np.ndarray]:
    """Weights by machine; ``plan`` lists (machine, language, side, most rows of the language)."""
    import pandas as pd

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "rank"])  # the order of arrival must not matter
        x = np.zeros((len(group), 1 << BITS))
        for k, (at, value) in enumerate(zip(group["at"], group["value"], strict=True)):
            x[k, at] = value
        weights = support_vectors(x, group["side"].to_numpy())
        return pd.DataFrame({"machine": [int(group["machine"].iloc[0])], "weights": [weights.tobytes()]})

    schema = "machine int, lang string, side double, most int"
    sides = rows.sparkSession.createDataFrame(plan, schema)
    dealt = rows.join(F.broadcast(sides), "lang").where(F.col("rank") <= F.col("most"))
    found = dealt.select("machine", "side", "lang", "rank", "at", "value").groupBy("machine").applyInPandas(
        train, "machine int, weights binary")
    return {r.machine: np.frombuffer(r.weights) for r in found.collect()}


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on labelled documents that are not held out."""
    rows = _sample(docs, per_language).persist()
    try:
        found = sorted(r.lang for r in rows.select("lang").distinct().collect())
        if not found:
            return Model(None)
        root = grouping(found)
        levels, plan, places, count = [root], [], [], 0
        for node in levels:
            levels += [m for m in node.members if m.members]
            of = [m.languages() for m in node.members]
            single = node is not root and not any(m.members for m in node.members)
            most = [per_language if single else max(1, 20 if len(k) <= PER_FAMILY // 20 else 1, PER_FAMILY // len(k)) for k in of]
            pairs = list(combinations(range(len(of)), 2))
            places.append(range(count, count := count + len(pairs)))
            for machine, (a, b) in zip(places[-1], pairs, strict=True):
                plan += [(machine, k, side, most[c]) for c, side in ((a, -1.0), (b, 1.0)) for k in of[c]]
        weights = _machines(rows, plan) if plan else {}
        for node, place in zip(levels, places, strict=True):
            w = np.array([weights[m] for m in place]).reshape(len(place), (1 << BITS) + 1)
            node.level = Level(tuple(m.name for m in node.members), tuple(combinations(range(len(node.members)), 2)), w[:, :-1], w[:, -1])
        return Model(root)
    finally:
        rows.unpersist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch: pa.RecordBatch) -> dict:
        found = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": [f[0] for f in found], "score": [float(f[1]) for f in found]}

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text")), per_batch,
                       "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, fit(docs, per_language))
