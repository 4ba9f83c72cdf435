"""Removal of long repeated byte strings with suffix arrays.

Every string of ``LENGTH`` bytes holds an anchor: the substring of ``ANCHOR``
bytes whose hash is least in it. Equal strings hold the same anchor at the same
offset, so a repeat is seen by comparing the surroundings of equal anchors.
Three steps do that:

1. Tasks that read the documents send, for each anchor, hashes of the anchor
   and of its surroundings (a segment), once per distinct segment of a few MB of
   text. Where a segment is met again, all strings in it repeat. Anchors met
   once are dropped.
2. For an anchor with different segments, the bytes around it are gathered, one
   copy of each distinct segment, with the anchor itself as one symbol. The
   suffix array of these segments is built by linear grouping: suffix groups of
   equal Lyndon prefix are processed in descending order, previous-smaller
   pointers split the lower groups, and one pass over the groups emits the order
   without renaming and recursion. Neighbours that agree over a string's length
   are repeats. An anchor with more than ``GROUP`` distinct segments is settled
   on Spark instead, by counting each of its possible strings.
3. Each document drops the union of its repeated strings.

Cases: null text counts as empty; texts under ``LENGTH`` bytes keep all; copies
of a text lose everything that is long enough; repeated rows are copies; null
ids are kept; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import binary_list, map_batches, materialise, whole_text

LENGTH, ANCHOR = 200, 128
#: Bytes of text whose anchors are found together.
CHUNK_BYTES = 4 << 20
#: Distinct segments of an anchor that one suffix array holds.
GROUP = 1024
#: What a requested anchor is for.
FULL, BYTES, HOT = 1, 2, 4
#: In an entry's ``again``, where 1 says that its segment is met again in its chunk: it is a further place of one.
SETTLED = 2

_ENTRY = np.dtype([("anchor", "<u8"), ("segment", "<u8"), ("text", "<i8"), ("at", "<i4"), ("again", "u1")])


# Anchors -----------------------------------------------------------------------

def _window_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed 32-bit hash of each substring of ``width`` bytes."""
    part, length, power = data.astype(np.uint32) + np.uint32(1), 1, 0x9E3779B1
    whole, done = None, 0
    while True:
        if width & length:
            if whole is None:
                whole = part
            else:
                n = len(data) - (done + length) + 1
                whole = whole[:n] * np.uint32(power) + part[done:done + n]
            done += length
        if done == width:
            break
        n = len(part) - length
        part = part[:n] * np.uint32(power) + part[length:length + n]
        power, length = power * power & 0xFFFFFFFF, length * 2
    whole = whole ^ (whole >> np.uint32(15))
    whole *= np.uint32(0x2C1B3C6D)
    whole ^= whole >> np.uint32(12)
    return whole


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    length = 1
    while length * 2 <= width:
        values = pick(values[:-length], values[length:])
        length *= 2
    rest = width - length
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Places of substrings that are least in some string of ``length`` bytes, ties included."""
    if len(data) < length:
        return np.empty(0, np.int64)
    width = length - anchor + 1
    value = _window_hash(data, anchor)
    least = _sliding(value, width, np.minimum)
    padded = np.zeros(len(value) + width - 1, dtype=np.uint32)
    padded[width - 1:width - 1 + len(least)] = least
    chosen = _sliding(padded, width, np.maximum) == value
    zero = value == 0  # the padding cannot tell these, so all count
    return np.flatnonzero(chosen | zero)


def _entries(texts: list[bytes], keys: np.ndarray) -> np.ndarray:
    """An entry for each anchor of each text."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    at = anchors(data)
    doc = np.searchsorted(ends, at, side="right")
    inside = (at + ANCHOR <= ends[doc]) & (sizes[doc] >= LENGTH) if len(at) else np.zeros(0, bool)
    at, doc = at[inside], doc[inside]
    begin = ends[doc] - sizes[doc]
    low = np.maximum(at - (LENGTH - ANCHOR), begin)
    high = np.minimum(at + LENGTH, ends[doc])
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    out = np.empty(len(at), dtype=_ENTRY)
    out["anchor"] = [digest(raw[a:a + ANCHOR]) for a in at.tolist()]
    # the place of the anchor in its segment counts too
    out["segment"] = [digest(raw[a:b], s) for a, b, s in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)]
    out["text"], out["at"], out["again"] = keys[doc], at - begin, 0
    return out


def _sorted(entries: np.ndarray) -> np.ndarray:
    return entries[np.lexsort((entries["at"], entries["text"], entries["segment"], entries["anchor"]))]


def _chunk_entries(texts: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Entries of a chunk, each distinct segment once.

    Of a segment that is met again in the chunk, further places are sent as
    settled, since they repeat in any case; a hash of their place stands for
    anchor and segment, so that they are dealt evenly.
    """
    found = _sorted(_entries(texts, keys))
    if not len(found):
        return found
    again = np.zeros(len(found), bool)  # rows of the same text count once
    again[1:] = ((found["anchor"][1:] == found["anchor"][:-1]) & (found["text"][1:] == found["text"][:-1])
                 & (found["at"][1:] == found["at"][:-1]))
    found = found[~again]
    same = np.zeros(len(found), bool)
    same[1:] = (found["anchor"][1:] == found["anchor"][:-1]) & (found["segment"][1:] == found["segment"][:-1])
    group = np.cumsum(~same) - 1
    repeats = np.bincount(group) > 1
    copies = np.unique(keys, return_counts=True)
    twice = copies[0][copies[1] > 1]
    if len(twice):  # rows of the same text in a chunk
        repeats |= np.bincount(group, weights=np.isin(found["text"], twice)).astype(bool)
    found["again"] = np.where(same, SETTLED, repeats[group])
    place = found["text"][same].astype(np.uint64)
    found["anchor"][same] = place ^ (found["at"][same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found["segment"][same] = place
    return found


def text_key() -> Column:
    return F.xxhash64(F.lit("suffixes"), whole_text())


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), whole_text().alias("text"))


def _anchor_rows(keyed: DataFrame, chunk: int) -> DataFrame:
    """A row for each entry of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_list(batch.column(0))
            keys = batch.column(1).to_numpy()
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= chunk or i == len(texts) - 1:
                    found = _chunk_entries(texts[start:i + 1], keys[start:i + 1])
                    for a in range(0, len(found), 1 << 16):
                        part = found[a:a + (1 << 16)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["anchor"].astype(np.int64)), pa.array(part["segment"].astype(np.int64)),
                             pa.array(part["text"]), pa.array(part["at"]), pa.array(part["again"].astype(np.int8))],
                            names=["anchor", "segment", "text_key", "at", "again"])
                    start, size = i + 1, 0

    return keyed.select("text", "text_key").mapInArrow(run, "anchor long, segment long, text_key long, at int, again tinyint")


def _requests(rows: DataFrame, most: int) -> DataFrame:
    """(text_key, at, use) of the anchors that repeat.

    Only entries of one segment, at most one a chunk, meet in a window; the
    distinct segments of an anchor are counted by partial aggregates.
    """
    segment = Window.partitionBy("anchor", "segment").orderBy("text_key", "at")
    whole = segment.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = materialise(rows.select(
        "anchor", "text_key", "at", ((F.count("*").over(whole) > 1) | (F.max("again").over(whole) > 0)).alias("full"),
        ((F.row_number().over(segment) == 1) & (F.col("again") != SETTLED)).alias("first")), "judged")
    first = judged.where("first")
    mixed = first.groupBy("anchor").agg(F.count("*").alias("distinct")).where(F.col("distinct") > 1)
    several = first.join(mixed, "anchor").select(
        "text_key", "at", F.when(F.col("distinct") > most, BYTES | HOT).otherwise(BYTES).alias("use"))
    return judged.where("full").select("text_key", "at", F.lit(FULL).alias("use")).union(several)


# Suffix arrays -----------------------------------------------------------------

def suffix_array(text: str) -> list[int]:
    """Order of the suffixes of ``text``; its last character must be the least and unique.

    Phase 1 processes groups of suffixes from the highest to the lowest. A
    suffix's pointer names the nearest one before it in a lower group; pointed-to
    suffixes move, by the number of pointers, to new groups just above their own,
    so that each group ends with one Lyndon prefix. Phase 2 walks the order and
    puts every suffix whose Lyndon prefix ends where the current one starts at the
    front of its group.
    """
    n = len(text)
    members: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        members.setdefault(c, []).append(i)
    lists = [members[c] for c in sorted(members)]
    lower = list(range(-1, len(lists) - 1))
    upper = list(range(1, len(lists) + 1))
    top = len(lists) - 1
    upper[top] = -1
    group = [0] * n
    for g, items in enumerate(lists):
        for i in items:
            group[i] = g
    before = list(range(-1, n))  # nearest unprocessed suffix before; one place beyond for the end
    after = list(range(1, n + 2))
    pointer = [-1] * n
    g = top
    while g >= 0:
        own = [i for i in lists[g] if group[i] == g]
        lists[g] = own
        counts: dict[int, int] = {}
        for i in own:
            p, q = before[i], after[i]
            before[q] = p
            if p >= 0:
                after[p] = q
                counts[p] = counts.get(p, 0) + 1
            pointer[i] = p
        if counts:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, c in counts.items():
                key = (c, group[p])
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                old, items, new = key[1], moved[key], len(lists)
                for p in items:
                    group[p] = new
                lists.append(items)
                above = upper[old]
                lower.append(old)
                upper.append(above)
                upper[old] = new
                if above >= 0:
                    lower[above] = new
        g = lower[g]
    # all groups are final: give each its place, from the lowest up
    g = 0
    while lower[g] >= 0:
        g = lower[g]
    front = [0] * len(lists)
    place = 0
    while g >= 0:
        front[g] = place
        place += len(lists[g])
        g = upper[g]
    order = [-1] * n
    order[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            order[front[g]] = i
            front[g] += 1
            done[i] = True
            i = pointer[i]
    return order


def _shared(sides: list[bytes]) -> list[int]:
    """For each text the longest beginning that it has in common with another one."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    found = [0] * len(sides)
    for i, j in zip(order[:-1], order[1:]):  # the longest is that with a neighbour in sorted order
        a, b = sides[i], sides[j]
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        common = n - (differ.bit_length() + 7) // 8
        found[i], found[j] = max(found[i], common), max(found[j], common)
    return found


def repeated_windows(segments: list[tuple[bytes, bytes]]) -> list[list[int]]:
    """For distinct (left, right) surroundings of one anchor, the offsets in left where a repeat starts.

    What no other segment has in common with one, on either side of the anchor, is
    cut off first, and segments left too short for a string are passed over.
    """
    lefts = _shared([left[::-1] for left, _ in segments])
    rights = _shared([right for _, right in segments])
    use = [k for k, (a, b) in enumerate(zip(lefts, rights, strict=True)) if a + b >= LENGTH - ANCHOR]
    out: list[list[int]] = [[] for _ in segments]
    if len(use) > 1:
        cut = [len(segments[k][0]) - lefts[k] for k in use]
        parts = [(segments[k][0][c:], segments[k][1][:rights[k]]) for k, c in zip(use, cut, strict=True)]
        for k, c, offsets in zip(use, cut, _windows_in_order(parts), strict=True):
            out[k] = [c + o for o in offsets]
    return out


def _windows_in_order(segments: list[tuple[bytes, bytes]]) -> list[list[int]]:
    """As ``repeated_windows``, from the order of all suffixes of the segments."""
    width = LENGTH - ANCHOR + 1  # symbols of a string that holds the anchor
    text, starts = [], []
    place = 0
    for left, right in segments:
        piece = left.decode("latin-1").translate(_SHIFT) + "Ȁ" + right.decode("latin-1").translate(_SHIFT) + "\x01"
        starts.append(place)
        text.append(piece)
        place += len(piece)
    whole = "".join(text) + "\x00"
    last = np.full(len(whole), -1)  # segment of a place where a whole string starts
    for number, (left, right) in enumerate(segments):
        count = min(len(left), len(left) + 1 + len(right) - width)
        last[starts[number]:starts[number] + max(0, count + 1)] = number
    owner = last.tolist()
    found: list[set[int]] = [set() for _ in segments]
    previous = -1
    for i in suffix_array(whole):
        if owner[i] < 0:
            continue
        if previous >= 0 and whole[i:i + width] == whole[previous:previous + width]:
            found[owner[i]].add(i - starts[owner[i]])
            found[owner[previous]].add(previous - starts[owner[previous]])
        previous = i
    return [sorted(x) for x in found]


#: Bytes move up by two: the separator and the end stay below them.
_SHIFT = {i: i + 2 for i in range(256)}


def _surroundings(text: bytes, at: int) -> tuple[bytes, bytes]:
    return text[max(0, at - (LENGTH - ANCHOR)):at], text[at + ANCHOR:at + LENGTH]


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """Bytes covered by strings that start at the sorted places."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + LENGTH
        else:
            out.append([s, s + LENGTH])
    return [(a, b) for a, b in out]


_SEGMENT_ROWS = "anchor long, text_key long, at int, start int, left binary, right binary, hot boolean"


def _wanted_texts(keyed: DataFrame, needs: DataFrame) -> DataFrame:
    """Each distinct text of ``needs`` once, however many rows hold it."""
    return keyed.select("text_key", "text").dropDuplicates(["text_key"]).join(needs, "text_key")


def _segment_rows(joined: DataFrame) -> DataFrame:
    """Surroundings of requested anchors; a hot anchor's strings as a row each (hash in ``anchor``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            keys = batch.column(1).to_pylist()
            for key, text, wanted in zip(keys, binary_list(batch.column(0)), batch.column(2).to_pylist(), strict=True):
                for packed in wanted or ():
                    at, use = packed >> 3, packed & 7
                    if not use & BYTES:
                        continue
                    left, right = _surroundings(text, at)
                    if use & HOT:
                        for start in range(at - len(left), min(at, len(text) - LENGTH) + 1):
                            digest = xxhash.xxh64_intdigest(text[start:start + LENGTH])
                            row = (digest, key, at, start, None, None, True)
                            for column, value in zip(columns, row, strict=True):
                                column.append(value)
                    else:
                        digest = xxhash.xxh64_intdigest(text[at:at + ANCHOR])
                        row = (digest, key, at, at - len(left), left, right, False)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
            columns[0] = np.array(columns[0], dtype=np.uint64).view(np.int64)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=[x.split()[0] for x in _SEGMENT_ROWS.split(", ")])

    return joined.select("text", "text_key", "wanted").mapInArrow(run, _SEGMENT_ROWS)


def _settled(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(text_key, begin, end) of the repeated strings around one anchor."""
    index: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    for key, start, left, right in group:
        index.setdefault((left, right), []).append((key, start))
    if len(index) < 2:
        return
    for places, offsets in zip(index.values(), repeated_windows(list(index)), strict=True):
        for key, start in places:
            for a, b in _runs([start + o for o in offsets]):
                yield key, a, b


def _by_suffix_array(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != current:
                    out.extend(_settled(group))
                    current, group = anchor, []
                group.append(row)
            yield _interval_batch(out)
        yield _interval_batch(list(_settled(group)))

    rows = segments.where("NOT hot").select("anchor", "text_key", "start", "left", "right")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "text_key long, begin int, end int")


def _interval_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))],
        names=["text_key", "begin", "end"])


def _by_counting(segments: DataFrame) -> DataFrame:
    hot = segments.where("hot").select(F.col("anchor").alias("string"), "text_key", "start").distinct()
    again = hot.groupBy("string").count().where("count > 1").select("string")
    return hot.join(again, "string").select(
        "text_key", F.col("start").alias("begin"), (F.col("start") + LENGTH).alias("end"))


# Operator ----------------------------------------------------------------------

def repeated_spans(docs: DataFrame, chunk: int = CHUNK_BYTES, group: int = GROUP) -> DataFrame:
    """(text_key, spans): packed ``begin << 32 | end`` of the repeated bytes of each text, not yet united."""
    keyed = _keyed(docs)
    packed = F.shiftleft(F.col("at").cast("long"), 3).bitwiseOR(F.col("use").cast("long"))
    requests = materialise(
        _requests(_anchor_rows(keyed, chunk), group).groupBy("text_key").agg(F.collect_set(packed).alias("wanted")), "requests")
    needs = requests.where(F.exists("wanted", lambda x: x.bitwiseAND(F.lit(BYTES).cast("long")) > 0)).select(
        "text_key", F.filter("wanted", lambda x: x.bitwiseAND(F.lit(BYTES).cast("long")) > 0).alias("wanted"))
    segments = materialise(_segment_rows(_wanted_texts(keyed, needs)), "segments")
    partly = _by_suffix_array(segments).union(_by_counting(segments))
    span = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    whole = requests.select("text_key", F.explode("wanted").alias("packed")).where(
        F.col("packed").bitwiseAND(F.lit(FULL).cast("long")) > 0).select("text_key", F.shiftright("packed", 3).alias("at"))
    spans = partly.select("text_key", span(F.col("begin"), F.col("end")).alias("span")).union(
        whole.select("text_key", span(F.greatest(F.col("at") - (LENGTH - ANCHOR), F.lit(0)), F.col("at") + LENGTH)))
    return spans.groupBy("text_key").agg(F.collect_set("span").alias("spans"))


def united(spans: list[int] | None, size: int) -> list[tuple[int, int]]:
    """Disjoint, non-adjacent (begin, end) of packed spans, cut at the text's end."""
    out: list[list[int]] = []
    for x in sorted(spans or ()):
        a, b = x >> 32, min(x & 0xFFFFFFFF, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _per_document(docs: DataFrame, per_text, schema: str, **sizes) -> DataFrame:
    """``per_text(text, removed runs)`` gives the columns after doc_id."""
    names = [x.split()[0] for x in schema.split(", ")]

    def per_batch(batch: pa.RecordBatch) -> dict:
        rows = [per_text(t, united(s, len(t))) for t, s in
                zip(binary_list(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
        return {"doc_id": batch.column("doc_id")} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    joined = _keyed(docs).join(repeated_spans(docs, **sizes), "text_key", "left").select("doc_id", "text", "spans")
    return map_batches(joined, per_batch, f"doc_id long, {schema}")


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id and the bytes of the text that are left."""
    return _per_document(docs, lambda t, runs: (_kept(t, runs),), "kept binary", **sizes)


def repeats_report(docs: DataFrame, **sizes) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of the bytes that are left."""
    def row(text, runs):
        return len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(text, runs)).hexdigest()

    return _per_document(docs, row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **sizes)
