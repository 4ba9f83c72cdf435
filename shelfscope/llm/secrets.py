"""Secret scan with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams
that any of its matches must hold (folded to lower case). Documents are indexed
in segments of bounded size inside the tasks that read them: a segment's
postings list, for each trigram that some query names, the documents that hold
it. Postings are intersected and united as the query says and only the
candidates are verified with the expression itself; a rule without mandatory
trigrams scans every document. No text is shuffled.

Cases: null text counts as empty; a document without a match has no spans;
equal starts are ordered by the rules' order; repeated rows and null ids are
kept row by row; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import binary_list, map_batches, whole_text

#: Bytes of text indexed together.
SEGMENT_BYTES = 4 << 20
#: A set of literal strings larger than this is not expanded further.
MAX_STRINGS = 32
_ALL = ("all",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if ``group`` has ``least`` characters. The span is ``span``'s."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    span: int = 0


#: Fixed by the query's contract.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Added kinds: key blocks and tokens with a public, fixed prefix.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # only the first eyJ of a run of its characters can begin a token, and a run is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", span=1),
)
RULES = BASE_RULES + EXTRA_RULES


# Boolean queries ---------------------------------------------------------------

def _both(a, b):
    if a == _ALL:
        return b
    return a if b == _ALL or a == b else ("and", a, b)


def _either(queries):
    queries = list(dict.fromkeys(queries))
    if not queries or _ALL in queries:
        return _ALL
    return queries[0] if len(queries) == 1 else ("or", *queries)


def _of_strings(strings: Iterable[str]):
    """A text that holds one of ``strings`` satisfies this query."""
    each = []
    for s in sorted(strings):
        q = _ALL
        for i in range(len(s) - 2):
            q = _both(q, ("tri", s[i:i + 3]))
        each.append(q)
    return _either(each)


def _literals(op, arg) -> set[str] | None:
    """The folded characters that a one-character node can match, if few and ASCII."""
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.IN and arg and arg[0][0] is not sre.NEGATE:
        found: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL and value < 128:
                found.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    return None


def _analyse(nodes) -> tuple[set[str] | None, tuple]:
    """All strings that the nodes match, if they are few, and a query that holds for any match."""
    whole: set[str] | None = {""}
    run: set[str] = {""}
    query: tuple = _ALL

    def join(strings: set[str] | None, inner: tuple = _ALL) -> None:
        nonlocal whole, run, query
        if strings is not None and len(strings) * len(run) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            if whole is not None:
                whole = run
            return
        query = _both(_both(query, _of_strings(run)), inner if strings is None else _of_strings(strings))
        whole, run = None, {""}

    for op, arg in nodes:
        if op is sre.SUBPATTERN:
            join(*_analyse(arg[3]))
        elif op is sre.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            exact = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
            join(exact, _either([p[1] if p[0] is None else _of_strings(p[0]) for p in parts]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            strings, q = _analyse(inner)
            if most == 1 and least == 0 and strings is not None:
                join(strings | {""})
            elif least == most == 1:
                join(strings, q)
            elif least:
                for _ in range(min(least, 3)):
                    join(strings, q)
                join(None)
            else:
                join(None)
        elif op is sre.AT:
            continue
        else:
            join(_literals(op, arg))
    return whole, query if whole is not None else _both(query, _of_strings(run))


def trigram_query(pattern: str) -> tuple:
    """A Boolean query over folded trigrams that every match of ``pattern`` satisfies."""
    strings, query = _analyse(_parser.parse(pattern, re.ASCII))
    return query if strings is None else _of_strings(strings)


def _named(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(_named(q) for q in query[1:])) if query[0] in ("and", "or") else set()


# Segments ------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def postings(texts: list[bytes], trigrams: list[str]) -> dict[str, np.ndarray]:
    """For each trigram the sorted numbers of the texts that hold it, lower-cased."""
    codes = {(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]): t for t in trigrams}
    found: dict[str, np.ndarray] = {t: np.empty(0, np.int64) for t in trigrams}
    data = _FOLD[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    if len(data) < 3 or not codes:
        return found
    ends = np.cumsum([len(t) for t in texts])
    wide = data.astype(np.uint32)
    grams = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    wanted = np.zeros(1 << 24, dtype=bool)
    wanted[list(codes)] = True
    at = np.flatnonzero(wanted[grams])
    doc = np.searchsorted(ends, at, side="right")
    inside = at + 3 <= ends[doc]
    at, doc = at[inside], doc[inside]
    pairs = np.unique((grams[at].astype(np.int64) << 32) | doc)
    for code, trigram in codes.items():
        low, high = np.searchsorted(pairs, [code << 32, (code + 1) << 32])
        found[trigram] = pairs[low:high] & 0xFFFFFFFF
    return found


def candidates(query: tuple, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the texts of a segment that satisfy the query."""
    if query[0] == "tri":
        return index[query[1]]
    if query[0] == "and":
        return np.intersect1d(*(candidates(q, index, n) for q in query[1:]), assume_unique=True)
    if query[0] == "or":
        return np.unique(np.concatenate([candidates(q, index, n) for q in query[1:]]))
    return np.arange(n)


def _segments(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SEGMENT_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _scanner(rules: tuple[Rule, ...]) -> Callable[[list[bytes]], list[list[tuple]]]:
    compiled = [(i, r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for i, r in enumerate(rules)]
    trigrams = sorted(set().union(*(_named(q) for *_, q in compiled)))

    def scan(texts: list[bytes]) -> list[list[tuple]]:
        spans: list[list[tuple]] = [[] for _ in texts]
        for low, high in _segments(texts):
            segment = texts[low:high]
            index = postings(segment, trigrams)
            for number, rule, regex, query in compiled:
                for k in candidates(query, index, len(segment)):
                    text = segment[k].decode()
                    for m in regex.finditer(text):
                        if len(m[rule.group]) >= rule.least:
                            spans[low + int(k)].append((m.start(rule.span), number, rule.kind, m.end(rule.span), m[rule.span]))
        return [sorted(s) for s in spans]

    return scan


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and an array of spans (kind, start, end in code points, value), in order."""
    import itertools

    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, value: string>>"

    def per_batch(batch: pa.RecordBatch) -> dict:
        spans = scan(binary_list(batch.column("text")))
        return {"doc_id": batch.column("doc_id"),
                "spans": [[{"kind": k, "start": s, "end": e, "value": v} for s, _, k, e, v in x] for x in spans]}

    scan = _scanner(tuple(itertools.chain(rules)))
    return map_batches(docs.select("doc_id", whole_text().alias("text")), per_batch, schema)


# Digest of the query -----------------------------------------------------------

def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of the base kinds, and all spans."""
    spans = F.col("spans")

    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return scan_secrets(docs).select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))
