"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule names the measures it needs and when a document fails it. On a sample
the cascade takes every rule's cost (seconds to compute it alone) and selectivity
(share of documents that it rejects), and orders the rules by rejection per
cost. A measure is then computed only for documents that no earlier rule has
rejected, unless the caller asks for it on every document. All rules must hold,
so the order changes the work and never the verdict.

Cases: null text counts as empty; a text without words fails the first base
rule; windows need five words; repeated rows and null ids are kept row by row; an
empty table gives an empty one (the rules keep their order); measures are only
added under names that the input's columns do not bear.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfscope.llm.common import whole_text

SPACE = r"[\x20\x09-\x0D]"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
WINDOW = 5
#: Documents on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 2000
#: Timed runs of a rule.
RUNS = 3
#: Prefix of the columns that the cascade adds.
OWN = "_q_"


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``fails`` of the measures holds."""

    name: str
    measures: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
)
#: The method's own rules beside those of the contract.
RULES = BASE_RULES + (
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("shouting", ("n_words", "n_marks"), lambda m: 2 * m["n_marks"] > m["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"),
         lambda m: (m["word_chars"] > 20 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _steps(name: str) -> list[tuple[str, Callable[[Callable[[str], Column]], Column]]]:
    """Columns to add, in order, for a measure; each is a function of earlier ones."""
    if name == "n_words":
        return [("words", lambda c: _words(c("text"))), ("n_words", lambda c: F.size(c("words")).cast("long"))]
    if name == "word_chars":
        return [*_steps("n_words"), ("word_chars", lambda c: F.length(F.array_join(c("words"), "")).cast("long"))]
    if name == "n_symbols":
        return [("n_symbols", lambda c: F.regexp_count(c("text"), F.lit(r"[#*$%&|<>]")).cast("long"))]
    if name == "n_marks":
        return [("n_marks", lambda c: F.regexp_count(c("text"), F.lit("[!?]")).cast("long"))]
    if name in ("n_lines", "n_dup_lines"):
        return [("lines", lambda c: F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(WORD_CHARACTER))),
                ("n_lines", lambda c: F.size(c("lines")).cast("long")),
                ("n_dup_lines", lambda c: c("n_lines") - F.size(F.array_distinct(c("lines"))))]
    if name == "n_repeat_words":
        return [
            *_steps("n_words"),
            ("windows", lambda c: F.when(c("n_words") >= WINDOW, F.transform(
                F.sequence(F.lit(0), F.size(c("words")) - WINDOW),
                lambda i: F.xxhash64(*(F.get(c("words"), i + j) for j in range(WINDOW)))))),
            # only where some window is there twice, its places are looked for
            ("sorted", lambda c: F.when(
                F.size(F.array_distinct(c("windows"))) < F.size(c("windows")),
                F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
            ("places", lambda c: F.sort_array(F.transform(
                F.filter(c("sorted"), lambda x, k: (
                    (k > 0) & (F.get(c("sorted"), k - 1)["h"] == x["h"]))
                    | F.coalesce(F.get(c("sorted"), k + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"]))),
            # a window covers its words up to the next one that counts
            ("n_repeat_words", lambda c: F.coalesce(F.aggregate(
                F.transform(c("places"), lambda p, k: F.least(
                    F.coalesce(F.get(c("places"), k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))),
        ]
    raise ValueError(f"no measure {name}")


def _own(name: str) -> Column:
    return F.col(OWN + name)


def add_measures(docs: DataFrame, names: Iterable[str], alive: Column | None = None) -> DataFrame:
    """``docs`` (with its whole text in OWN + 'text') with the measures, null where not ``alive``."""
    for name in names:
        for step, expression in _steps(name):
            if OWN + step not in docs.columns:
                value = expression(_own)
                docs = docs.withColumn(OWN + step, value if alive is None else F.when(alive, value))
    return docs


def estimate(docs: DataFrame, rules: Iterable[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule, alone, on a sample of about ``rows`` documents.

    The time is the least of ``RUNS`` runs, without the first one, which also compiles, and
    less that of a job which measures nothing.
    """
    total = docs.count()
    if not total:
        return [(rule, 1.0, 0.0) for rule in rules]
    sample = docs.select(whole_text().alias(OWN + "text")).sample(fraction=min(1.0, rows / total), seed=7).persist()
    try:
        idle = _least_time(lambda: sample.agg(F.count(F.lit(1))).first())[0]
        found = []
        for rule in rules:
            alone = add_measures(sample, rule.measures)
            share = F.avg(rule.fails({m: _own(m) for m in rule.measures}).cast("double"))
            seconds, row = _least_time(lambda: alone.agg(share).first())
            found.append((rule, max(seconds - idle, 1e-4), row[0] or 0.0))
        return found
    finally:
        sample.unpersist()


def _least_time(run: Callable[[], Row]) -> tuple[float, Row]:
    run()
    times = []
    for _ in range(RUNS):
        began = time.perf_counter()
        row = run()
        times.append(time.perf_counter() - began)
    return min(times), row


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; ties keep their order."""
    return [r for r, *_ in sorted(estimates, key=lambda x: -x[2] / max(x[1], 1e-9))]


def _judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds OWN + 'kept'; a rule's measures are computed for documents still kept."""
    kept = F.lit(True)
    for number, rule in enumerate(rules):
        docs = add_measures(docs, rule.measures, kept if number else None)
        now = kept & ~F.coalesce(rule.fails({m: _own(m) for m in rule.measures}), F.lit(False))
        docs = docs.withColumn(f"{OWN}kept{number}", now)
        kept = _own(f"kept{number}")
    return docs.withColumn(OWN + "kept", kept)


def cascade(docs: DataFrame, rules: Iterable[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = ordered(estimate(docs, rules, sample_rows))
    judged = _judged(docs.withColumn(OWN + "text", whole_text()), order)
    # the row number keeps the filter above the measures; pushed below, it would repeat them
    numbered = judged.withColumn(OWN + "row", F.monotonically_increasing_id())
    return numbered.where(_own("kept") & (_own("row") >= 0)).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_report(docs: DataFrame, rules: Iterable[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document the contract's measures, its base verdict and the cascade's verdict.

    The measures that are returned are computed for every document; those that
    only other rules need, only while a document is still kept.
    """
    returned = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = ordered(estimate(docs, rules, sample_rows))
    rows = add_measures(docs.select("doc_id", whole_text().alias(OWN + "text")), returned)
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.fails({m: _own(m) for m in rule.measures})
    judged = _judged(rows, order)
    return judged.select("doc_id", *(_own(m).alias(m) for m in returned), failed.alias("base_failed"),
                         (~failed & _own("kept")).alias("kept"))
