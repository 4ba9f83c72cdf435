"""Packing of tokenised documents into fixed-length sequences by patterns.

Documents become pieces of at most ``CAPACITY`` tokens. Only the histogram of piece
lengths, at most ``CAPACITY`` rows, comes to the driver. There, patterns of a few
documents whose lengths fill a sequence are enumerated, their repeat counts are fitted
to the histogram by non-negative least squares and rounded, and what is left of the
histogram is packed best fit, longest first, many equal pieces at a time. The plan
is a list of patterns with counts; its size depends on the number of lengths, not on the
number of documents. Spark then numbers the pieces by length over ranges, and each piece
finds its sequence and place from its number alone.

Texts are tokenised whole. White space separates the tokenizer's words for certain,
so the ids of a text are those of its parts, and a part is encoded once for
many places; a part of plain letters needs nothing but the tokenizer's model.

Cases: null text counts as empty, and an empty text is a piece of the end id alone; documents
with null or repeated ids are packed row by row; an empty table gives an empty
one; other columns of the input do not matter. A text's special-token strings are ordinary text.
A single word is never cut, so memory grows with the longest one.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions.ranking import range_ranked
from shelfscope.llm.common import binary_list, materialise, slices, whole_text

CAPACITY = 4096
#: Id behind every document.
END = 1
#: The vocabulary file is sent to the tasks whole; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20

#: Parts that are remembered with their ids in a Python worker, and their greatest length in bytes.
REMEMBERED, LONGEST = 1 << 19, 64
#: Bytes of a long text that are taken apart at once.
WINDOW = 1 << 20

# Behind a letter, a full stop or comma begins a word of its own to the tokenizer.
_MARK = re.compile(rb"[.,](?:(?<=[a-z][.,])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,]))")
_BLANK = re.compile(rb"[ \t-\r]")
# Letters that normalisation leaves as they are, but for their case.
_LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")

#: Lengths tried for the middle documents of a pattern, spread evenly over the documents.
SPREAD = 12
#: Steps of the least-squares fit.
STEPS = 300

_IDS = [struct.Struct(f"<{n}I") for n in range(64)]
_WORKER: dict = {}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


class _Worker:
    """A tokenizer with the ids of the parts that it remembers, as little-endian bytes."""

    def __init__(self, vocabulary: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {code: spell(chr(code))[0][0] for code in range(256) if _LETTERS.match(chr(code))}
        self.known: dict[bytes, bytes] = {}
        sample = "Abc déJÀ, éÇ. it's a.b !!, x1\x1cß"
        if self.encode([sample.encode()]) != [_packed(self.tokenizer.encode(sample, add_special_tokens=False).ids)]:
            raise ValueError("the vocabulary must drop white space and case and take letters apart from marks")

    def _new(self, parts: set[bytes]) -> dict[bytes, bytes]:
        found, others, tokenize = {}, [], self.model.tokenize
        for part in parts:
            word = part.decode()
            if part.isalpha():  # ASCII
                found[part] = _packed([x.id for x in tokenize(word)])
            elif _LETTERS.fullmatch(word):
                found[part] = _packed([x.id for x in tokenize(word.lower().translate(self.spelling))])
            else:
                others.append(part)
        whole = self.tokenizer.encode_batch_fast([part.decode() for part in others], add_special_tokens=False)
        found.update((part, _packed(x.ids)) for part, x in zip(others, whole))
        return found

    def _append(self, taken: list[tuple[int, list[bytes]]], out: list[list[bytes]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = self._new(set().union(*(parts for _, parts in taken)).difference(self.known))
        self.known.update(new)
        for number, parts in taken:
            out[number].append(b"".join(map(self.known.__getitem__, parts)))
        for part in new:
            if len(part) > LONGEST:
                del self.known[part]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole UTF-8 texts, equal to those of the tokenizer."""
        out: list[list[bytes]] = [[] for _ in texts]
        taken, size = [], 0
        for number, text in enumerate(texts):
            for window in _windows(text):
                taken.append((number, _MARK.sub(rb" \g<0>", window.lower()).split()))
                size += len(window)
                if size >= WINDOW:
                    self._append(taken, out)
                    taken, size = [], 0
        self._append(taken, out)
        return [b"".join(ids) for ids in out]


def _packed(ids: list[int]) -> bytes:
    return _IDS[len(ids)].pack(*ids) if len(ids) < len(_IDS) else struct.pack(f"<{len(ids)}I", *ids)


def _worker(vocabulary: bytes) -> _Worker:
    """The tokenizer of a vocabulary, once per Python worker."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _WORKER:
        _WORKER[key] = _Worker(vocabulary)
    return _WORKER[key]


def _windows(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > WINDOW:
        blank = _BLANK.search(text, start + WINDOW)
        if blank is None:
            break
        yield text[start:blank.start()]
        start = blank.start()
    yield text[start:]


def pieces(documents: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's tokens and the end
    id, cut after each ``capacity`` tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    vocabulary = read_vocabulary(vocabulary_path)
    doc_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())]
                          + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(vocabulary)
        end = _packed([END])
        for batch in batches:
            for part in slices(batch):
                rows = []
                for number, ids in enumerate(worker.encode(binary_list(part.column(1)))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start:4 * (start + capacity)]
                        rows.append((number, piece, start, len(own) // 4, zlib.crc32(own), own))
                row, piece, start, length, crc, own = zip(*rows) if rows else [()] * 6
                columns = [part.column(0).take(pa.array(row, pa.int64())), piece, start, length, crc]
                if with_ids:
                    columns.append([np.frombuffer(x, "<u4").astype("i4") for x in own])
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return documents.select("doc_id", whole_text().alias("text")).mapInArrow(cut, schema)


def _enumerate(counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns of one to five lengths, falling within a pattern, that fill a sequence exactly.

    Every length leads patterns; those between are spread over the documents, and the
    last one is the room left, where that is a present length.
    """
    present = np.flatnonzero(counts)
    share = np.cumsum(counts[present]) / counts[present].sum()
    middle = np.unique(present[np.searchsorted(share, (np.arange(SPREAD) + 0.5) / SPREAD)])
    found = [np.array([[capacity]])] if counts[capacity] else []
    heads = present[present < capacity][:, None]
    for _ in range(4):
        left = capacity - heads.sum(1)
        fits = (left <= heads[:, -1]) & (counts[left] > 0)
        if fits.any():
            found.append(np.column_stack([heads[fits], left[fits]]))
        longer = np.column_stack([np.repeat(heads, len(middle), axis=0), np.tile(middle, len(heads))])
        heads = longer[(longer[:, -1] <= longer[:, -2]) & (longer.sum(1) < capacity)]
        if not len(heads):
            break
    return found


def _fit(patterns: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """Repeat counts x >= 0 that make the patterns' lengths come nearest to the histogram.

    Least squares by accelerated projected gradients over the patterns' own lengths.
    """
    goal = counts.astype(float)
    scale = max(goal.max(), 1.0)
    goal = goal / scale

    def lengths_of(x: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(goal))
        for p, v in zip(patterns, x):
            for column in p.T:
                total += np.bincount(column, v, len(goal))
        return total

    def back(error: np.ndarray) -> list[np.ndarray]:
        return [error[p].sum(1) for p in patterns]

    # the greatest eigenvalue of the normal matrix bounds the step
    rng = np.random.default_rng(1)
    x = [rng.random(len(p)) for p in patterns]
    top = 1.0
    for _ in range(20):
        x = back(lengths_of(x))
        top = np.sqrt(sum(float(v @ v) for v in x))
        x = [v / top for v in x]
    step = 1 / (1.05 * top)
    x = [np.zeros(len(p)) for p in patterns]
    ahead, pace = x, 1.0
    for _ in range(STEPS):
        slope = back(lengths_of(ahead) - goal)
        new = [np.maximum(a - step * s, 0) for a, s in zip(ahead, slope)]
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = [n + (pace - 1) / faster * (n - o) for n, o in zip(new, x)]
        x, pace = new, faster
    return [v * scale for v in x]


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of a histogram: equal sequences are filled together."""
    rooms: list[int] = []
    groups: dict[int, list] = {}
    done = []

    def put(lengths: tuple[int, ...], times: int, room: int) -> None:
        if not room:
            done.append((lengths, times))
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append([lengths, times])

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    put((length,) * per, full, capacity - per * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            room = rooms[at]
            group = groups[room][-1]
            times = min(left, group[1])
            group[1] -= times
            if not group[1]:
                groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            put(group[0] + (length,), times, room - length)
            left -= times
    return done + [(lengths, times) for group in groups.values() for lengths, times in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how often)], using each length exactly as often as it occurs."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    if not counts.any():
        return []
    left, chosen = counts.copy(), []
    patterns = _enumerate(counts, capacity)
    fitted = _fit(patterns, counts) if patterns else []
    order = sorted(((float(v), k, i) for k, x in enumerate(fitted) for i, v in enumerate(x) if v >= 0.5),
                   key=lambda item: (-item[0], item[1], item[2]))
    for value, k, i in order:
        lengths = tuple(patterns[k][i].tolist())
        times = min([round(value)] + [int(left[n]) // lengths.count(n) for n in set(lengths)])
        if times:
            chosen.append((lengths, times))
            for n in lengths:
                left[n] -= times
    return chosen + _best_fit(left, capacity)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset, gapless from 0 in every sequence.

    The rows are numbered by length over ranges. A pattern's place for a length
    serves a run of these numbers, one for every repeat.
    """
    own = cut.columns
    cut = materialise(cut, "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = []  # (length, first sequence, repeats, offset)
    sequence = 0
    for lengths, times in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            places.append((length, sequence, times, offset))
            offset += length
        sequence += times
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 4)
    begins = np.concatenate([[0], np.cumsum(table[:, 2])])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(begins, number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(table[at, 1] + number - begins[at]), pa.array(table[at, 3])],
                names=own + ["sequence_id", "offset"])

    # all columns are part of the key, so equal rows may change places without any effect
    key = F.struct("length", *[c for c in own if c != "length"]).alias("key")
    numbered = range_ranked(cut.select(key), "key").select("key", F.col("start").cast("long").alias("_number"))
    schema = T.StructType([f for f in cut.schema] + [T.StructField("sequence_id", T.LongType()),
                                                    T.StructField("offset", T.LongType())])
    return numbered.select(*[f"key.{c}" for c in own], "_number").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"))


def packing_report(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    return pack(pieces(documents, vocabulary_path))
