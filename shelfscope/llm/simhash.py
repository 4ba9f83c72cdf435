"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint holds, bit by bit, the majority of the XXH64 values of a text's
word shingles. Distinct fingerprints are dealt to tasks by the values of two of
``distance + 2`` bit blocks: fingerprints within ``distance`` bits agree on at
least two blocks, so every link meets in some task. There they are sorted by
Gray rank and indexed: a node factors out the bits that all fingerprints below
it share, children hold only what they share beyond that, and a search adds up
differences on the way down and prunes a whole group once they exceed the
distance or once the group is already linked to the query. A task emits a
spanning forest of its links, never the pairs; components are joined on Spark.

A block value shared by more than ``TILE`` distinct fingerprints is dealt as
pairs of chunks of that size, each its own small task, so a large group of near
copies is neither capped nor gathered.

Cases: null text counts as empty; a text without words has fingerprint zero,
linked like any other; exact copies share a fingerprint and are one row of the
index; null doc_ids are linked but never name a component unless all are null;
repeated rows stay; an empty table gives an empty one; other columns of the
input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import binary_list, map_batches, materialise, whole_text
from shelfscope.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Children of an index node, queries searched together, rows indexed together.
FAN, BLOCK, ROWS = 8, 512, 1 << 18
#: Fingerprints of one block value that are compared in one task.
TILE = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included."""
    words = text.lower().split()  # bytes: folds A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)],
                      dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low:low + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, a hash of the whole text and its fingerprint as a signed long."""
    def per_batch(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(x, shingle) for x in binary_list(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                "fp": pa.array(np.array(found, dtype=np.uint64).view(np.int64))}

    texts = docs.select("doc_id", text_hash().alias("text_hash"), whole_text().alias("text"))
    return map_batches(texts, per_batch, "doc_id long, text_hash long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.lit("text"), whole_text())


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Index -------------------------------------------------------------------------

def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


class GrayIndex:
    """Hierarchical index over rows sorted by (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, code: np.ndarray):
        self.bucket, self.code = bucket, code
        self.own: list[np.ndarray] = [np.full(len(code), ~np.uint64(0))]  # bits that a node knows
        self.value: list[np.ndarray] = [code]
        self.low: list[np.ndarray] = [bucket]
        self.high: list[np.ndarray] = [bucket]
        lows, highs = code, code
        while len(lows) > FAN:
            cuts = np.arange(0, len(lows), FAN)
            lows, highs = np.bitwise_and.reduceat(lows, cuts), np.bitwise_or.reduceat(highs, cuts)
            shared = ~(lows ^ highs)
            self.own.append(shared)
            self.value.append(lows & shared)
            self.low.append(self.low[-1][cuts])
            self.high.append(self.high[-1][np.minimum(cuts + FAN, len(self.high[-1])) - 1])
        for level in range(len(self.own) - 1):  # children keep what their parent has not factored out
            parent = self.own[level + 1][np.arange(len(self.own[level])) // FAN]
            self.own[level] = self.own[level] & ~parent

    def links(self, first: int, last: int, distance: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j), i in [first, last), j > i, of one bucket within ``distance`` and not yet joined."""
        least, most = [root], [root]
        for nodes in self.own[1:]:
            cuts = np.arange(0, len(least[-1]), FAN)
            least.append(np.minimum.reduceat(least[-1], cuts))
            most.append(np.maximum.reduceat(most[-1], cuts))
        top = len(self.own) - 1
        n = len(self.own[top])
        query = np.repeat(np.arange(first, last), n)
        node = np.tile(np.arange(n), last - first)
        differ = np.zeros(len(query), dtype=np.uint8)
        width = FAN ** top
        for level in range(top, -1, -1):
            key = self.bucket[query]
            keep = (self.low[level][node] <= key) & (key <= self.high[level][node]) & ((node + 1) * width - 1 > query)
            joined = (least[level][node] == root[query]) & (most[level][node] == root[query])
            keep &= ~joined
            query, node, differ = query[keep], node[keep], differ[keep]
            differ = differ + np.bitwise_count((self.code[query] ^ self.value[level][node]) & self.own[level][node])
            keep = differ <= distance
            query, node, differ = query[keep], node[keep], differ[keep]
            if level:
                size = len(self.own[level - 1])
                query, differ = np.repeat(query, FAN), np.repeat(differ, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                keep = node < size
                query, node, differ = query[keep], node[keep], differ[keep]
                width //= FAN
        return query, node


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's component after adding the links."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def forest(bucket: np.ndarray, code: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the linked rows of each bucket; rows sorted by (bucket, Gray rank)."""
    index, root = GrayIndex(bucket, code), np.arange(len(code))
    for first in range(0, len(code), BLOCK):
        a, b = index.links(first, min(first + BLOCK, len(code)), distance, root)
        if len(a):
            root = _join(root, a, b)
    child = np.flatnonzero(root != np.arange(len(code)))
    return code[child], code[root[child]]


# Join --------------------------------------------------------------------------

def _block_keys(fp: Column, distance: int) -> Column:
    """One key for each pair of the distance + 2 bit blocks, holding their values."""
    count = distance + 2
    cuts = [64 * i // count for i in range(count + 1)]
    keys = []
    for number, (i, j) in enumerate(combinations(range(count), 2)):
        key = F.lit(number).cast("long")
        for block in (i, j):
            width = cuts[block + 1] - cuts[block]
            value = F.shiftrightunsigned(fp, cuts[block]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(value)
        keys.append(key)
    return F.array(*keys)


def near_edges(distinct: DataFrame, distance: int = DISTANCE, tile: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all links within ``distance`` bits."""
    tile = tile or TILE
    rows = distinct.select("fp", F.explode(_block_keys(F.col("fp"), distance)).alias("key"))
    sizes = rows.groupBy("key").count().where(F.col("count") > tile).select(
        "key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), F.col("fp")), F.col("parts").cast("long"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long")))
                      .otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    dealt = (rows.join(sizes, "key", "left").withColumn("chunk", F.coalesce(chunk, F.lit(0).cast("long")))
             .select("fp", "key", "chunk", other.alias("other"))
             .select("fp", F.struct("key", F.least("chunk", "other").alias("i"),
                                    F.greatest("chunk", "other").alias("j")).alias("tile")))
    dealt = dealt.select("fp", F.xxhash64("tile.key", "tile.i", "tile.j").alias("bucket"),
                         gray_rank(F.col("fp")).alias("rank"))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def edges(bucket, code):
            a, b = forest(bucket, code, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def gathered():
            return (np.concatenate([x[k] for x in held]) for k in (0, 1))

        count = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            count += batch.num_rows
            if count >= ROWS:  # whole buckets only; what may go on stays
                bucket, code = gathered()
                cut = int(np.searchsorted(bucket, bucket[-1]))
                if cut:
                    yield edges(bucket[:cut], code[:cut])
                held, count = [(bucket[cut:], code[cut:])], len(bucket) - cut
        if count:
            yield edges(*gathered())

    return ordered.select("bucket", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_hash, fp, component (its least fingerprint) and component_id of every document.

    component_id is the least doc_id reachable through links.
    """
    marks = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    groups = components(near_edges(distinct.select("fp"), distance), "a", "b")
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    names = named.join(least, "component").select("fp", "component", "component_id")
    return marks.join(names, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id.

    Texts that share this id, or texts of a component without ids, are told
    apart by their hash; of rows equal in both any one stays.
    """
    groups = materialise(near_duplicates(docs, shingle, distance), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    leaders = groups.groupBy("component").agg(first).select(
        F.col("first.doc_id").alias("_s_leader"), F.col("first.text_hash").alias("_s_hash"))
    repeated = groups.groupBy("doc_id", "text_hash").count().where("count > 1").select(
        "doc_id", "text_hash", F.lit(True).alias("repeated"))
    leaders = materialise(leaders.join(
        repeated, (F.col("_s_hash") == F.col("text_hash")) & F.col("_s_leader").eqNullSafe(F.col("doc_id")), "left")
        .select("_s_leader", "_s_hash", F.coalesce("repeated", F.lit(False)).alias("_s_repeated")), "leaders")
    rows = docs.join(leaders, (text_hash() == F.col("_s_hash")) & F.col("doc_id").eqNullSafe(F.col("_s_leader")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = rows.where(~F.col("_s_repeated")).select(columns)
    many = rows.where("_s_repeated").dropDuplicates(["_s_leader", "_s_hash"]).select(columns)
    return single.unionByName(many)
