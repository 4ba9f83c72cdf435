"""Benchmark decontamination by greedy string tiling.

A benchmark item is covered by a document as far as disjoint runs of its tokens,
each at least ``LEAST`` long, also stand in the document, in any order. The runs
(tiles) are found greedily: of all maximal matches of unmarked tokens the longest
is marked first, until none is left. Items are found by shared seeds: a rolling
Karp-Rabin value of every ``LEAST`` tokens, looked up in the seeds of a block of
the benchmark. Their matches are found by Karp-Rabin values of falling lengths and compared token by token. An item with at least ``COVERAGE`` of its
tokens in tiles is a leak, also if its passages were put in another order.

The benchmark goes to the tasks in blocks of at most ``BLOCK_TOKENS`` tokens, and
the documents are read once per block, so what is sent is bounded whatever the
benchmark's size. Documents are never shuffled. A task holds the tokens of one document and of one item, also where
a token repeats without end, as no pairs of places are listed.

Tokens are runs of letters and digits, lower-cased.

Cases: null texts count as empty; items with fewer than ``LEAST`` tokens are
matched whole; items without tokens match nothing; ties of tiles go to the
earlier place in the item, then in the document; equal items each match; repeated
documents and null ids are kept row by row; empty tables give an empty result;
other columns of the inputs do not matter.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import map_batches, string_list, whole_text

LEAST, COVERAGE = 5, 0.8
#: Tokens of the benchmark that are sent to the tasks at once; a longer item is a block of its own.
BLOCK_TOKENS = 2_000_000

_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def rolling(ids: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin value of each window of ``least`` token ids, modulo 2**64."""
    value = np.zeros(max(0, len(ids) - least + 1), dtype=np.uint64)
    for k in range(least):
        value = value * _BASE + ids[k:k + len(value)].astype(np.uint64)
    return value ^ (value >> np.uint64(29))


class _Side:
    """One of the two token sequences: window values of any length, and which tokens are in a tile."""

    def __init__(self, ids: np.ndarray, used: np.ndarray):
        self.ids, self.used = ids, used
        up = np.cumprod(np.full(len(ids), _BASE, dtype=np.uint64))
        self.down = np.cumprod(np.full(len(ids), _INVERSE, dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * up, dtype=np.uint64)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of the windows without a used token."""
        if size > len(self.ids):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        gone = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.used)])
        places = np.flatnonzero(gone[size:] == gone[:-size])
        return places, (self.sums[places + size] - self.sums[places]) * self.down[places]

    def longest(self) -> int:
        """Length of the longest run of unused tokens."""
        edges = np.flatnonzero(np.concatenate([[True], self.used, [True]]))
        return int(np.diff(edges).max()) - 1


def _meet(a: _Side, b: _Side, size: int) -> bool:
    return bool(np.isin(a.windows(size)[1], b.windows(size)[1]).any())


def tiles(item: np.ndarray, document: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item: (place in item, place in document, length), by place.

    Each round finds the greatest length of which unused windows of both sides have equal
    Karp-Rabin values (halving, as a match holds shorter ones), and marks all matches
    of that length that are equal token by token, by place in the item and in the document. Only
    the two sequences are held, never the pairs of their places; there are no more rounds than different lengths
    of tiles.
    """
    if min(len(item), len(document)) < least:
        return []
    # tokens outside of every shared window of the least length are in no tile
    own, other = rolling(item, least), rolling(document, least)
    a = _Side(item, ~_spread(np.isin(own, other), least))
    b = _Side(document, ~_spread(np.isin(other, own), least))
    found = []
    most = min(a.longest(), b.longest())
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if _meet(a, b, middle) else (low, middle - 1)
        if low < least:
            break
        found += _mark(a, b, low)
        most = min(low - 1, a.longest(), b.longest())
    return sorted(found)


def _spread(starts: np.ndarray, least: int) -> np.ndarray:
    """Tokens that lie in a window whose start is set."""
    change = np.zeros(len(starts) + least, dtype=np.int64)
    change[:len(starts)] += starts
    change[least:] -= starts
    return np.cumsum(change)[:len(starts) + least - 1] > 0


def _mark(a: _Side, b: _Side, size: int) -> list[tuple[int, int, int]]:
    """Mark the matches of this length, the earliest first. A place of the document that was
    passed over stays used, so each value's places are walked once."""
    places, values = a.windows(size)
    others, theirs = b.windows(size)
    order = np.argsort(theirs, kind="stable")
    others, theirs = others[order], theirs[order]
    low, high = np.searchsorted(theirs, values), np.searchsorted(theirs, values, side="right")
    reached: dict[int, int] = {}
    found = []
    for p, first, end in zip(places.tolist(), low.tolist(), high.tolist(), strict=True):
        if first == end or a.used[p:p + size].any():
            continue
        at = reached.get(first, first)
        while at < end and b.used[others[at]:others[at] + size].any():
            at += 1
        reached[first] = at
        for q in others[at:end].tolist():  # the first one, unless values of different windows are equal
            if not b.used[q:q + size].any() and np.array_equal(a.ids[p:p + size], b.ids[q:q + size]):
                a.used[p:p + size] = b.used[q:q + size] = True
                found.append((p, q, size))
                break
    return found


class Block:
    """Seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.short: dict[int, list[int]] = defaultdict(list)  # by length
        seeds, owners, places = [], [], []
        for number, (item, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens_of(text)], dtype=np.int64)
            self.items.append((item, ids))
            if 0 < len(ids) < least:
                self.short[len(ids)].append(number)
            value = rolling(ids, least)
            seeds.append(value)
            owners.append(np.full(len(value), number))
            places.append(np.arange(len(value)))
        seed = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.owner = np.concatenate(owners)[order] if seeds else seed
        self.place = np.concatenate(places)[order] if seeds else seed

    def _candidates(self, ids: np.ndarray, coverage: float) -> list[int]:
        """Items of which the windows that also stand in the text cover enough tokens."""
        value = np.unique(rolling(ids, self.least))
        shared = np.flatnonzero(np.isin(self.seed, value)) if len(value) * 8 > len(self.seed) else self._shared(value)
        if not len(shared):
            return []
        order = np.lexsort((self.place[shared], self.owner[shared]))
        owner, place = self.owner[shared][order], self.place[shared][order]
        same = np.concatenate([[False], owner[1:] == owner[:-1]])
        # a window adds the tokens that the one before it in the item does not hold
        adds = np.where(same, np.minimum(np.diff(place, prepend=0), self.least), self.least)
        first = np.flatnonzero(~same)
        sums = np.add.reduceat(adds, first)
        return [n for n, k in zip(owner[first].tolist(), sums.tolist(), strict=True) if k >= coverage * len(self.items[n][1])]

    def _shared(self, value: np.ndarray) -> np.ndarray:
        """Places in the seed table that hold one of the sorted values."""
        low, high = np.searchsorted(self.seed, value), np.searchsorted(self.seed, value, side="right")
        counts = high - low
        return np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())

    def covered(self, text: str, coverage: float) -> list[tuple[int, int, int, int]]:
        """(item, its tokens, tokens covered, tiles) of the items that the text covers enough."""
        known = self.vocabulary.get
        ids = np.array([known(t, 0) for t in tokens_of(text)], dtype=np.int64)
        out = []
        for number in self._candidates(ids, coverage):
            item, own = self.items[number]
            found = tiles(own, ids, self.least)
            sum_of = sum(size for *_, size in found)
            if sum_of >= coverage * len(own):
                out.append((item, len(own), sum_of, len(found)))
        for length, numbers in self.short.items():
            windows = set(zip(*(ids[k:len(ids) - length + 1 + k].tolist() for k in range(length)))) if len(ids) >= length else set()
            out += [(self.items[n][0], length, length, 1) for n in numbers if tuple(self.items[n][1].tolist()) in windows]
        return out


def _blocks(benchmark: DataFrame, block_tokens: int):
    """Lists of (item number, text); an item's number stands for its row."""
    items, size = [], 0
    for row in benchmark.select("item_id", whole_text().alias("text")).toLocalIterator():
        count = len(tokens_of(row.text))
        if items and size + count > block_tokens:
            yield items
            items, size = [], 0
        items.append((row.item_id, row.text))
        size += count
    if items:
        yield items


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE,
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, text_hash, item_id, item_tokens, covered_tokens, tiles, coverage) of each leaked item."""
    spark = docs.sparkSession
    schema = ("doc_id long, text_hash long, item_id long, item_tokens int, covered_tokens int, tiles int, coverage double")
    rows = docs.select("doc_id", text_hash().alias("text_hash"), whole_text().alias("text"))
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, block_tokens):
        out = out.union(_search(rows, items, least, coverage, schema))
    return out


def _search(rows: DataFrame, items: list[tuple[int, str]], least: int, coverage: float, schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

    def per_batch(batch: pa.RecordBatch) -> dict:
        block = _block_of(sent, least)
        columns: list[list] = [[] for _ in range(7)]
        for doc, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(),
                                     string_list(batch.column("text")), strict=True):
            for item, size, covered, count in block.covered(text, coverage):
                for column, value in zip(columns, (doc, digest, item, size, covered, count, covered / size), strict=True):
                    column.append(value)
        return dict(zip((x.split()[0] for x in schema.split(", ")), columns, strict=True))

    return map_batches(rows, per_batch, schema)


_BLOCKS: dict = {}


def _block_of(sent, least: int) -> Block:
    """The index of a block, built once per Python worker."""
    name, items = sent.value
    if (name, least) not in _BLOCKS:
        if len(_BLOCKS) > 1:
            _BLOCKS.clear()
        _BLOCKS[name, least] = Block(items, least)
    return _BLOCKS[name, least]


def text_hash():
    return F.xxhash64(F.lit("tiling"), whole_text())


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return leaks(docs, benchmark).drop("text_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE,
                  block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    spark = docs.sparkSession
    kept = docs
    for items in _blocks(benchmark, block_tokens):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

        @F.pandas_udf("boolean")
        def clean(texts, sent=sent):
            block = _block_of(sent, least)
            return texts.map(lambda t: not block.covered(t or "", coverage))

        kept = kept.where(clean(whole_text()))
    return kept
