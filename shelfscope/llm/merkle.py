"""Merkle manifest of documents in a van Emde Boas layout.

Every document is a leaf; the leaves of a language, in order of doc_id, form a
binary tree with a subroot, and the subroots, in order of language, form another one with the
root. A tree is cut into aligned blocks of ``HEIGHT`` levels. The roots of a
tree's blocks are the leaves of further blocks, and so on until a block holds a whole tree, so
no task ever holds more than one block of ``2 ** HEIGHT`` leaves, whatever
share of the rows a language has.

A block is one binary value, its nodes in van Emde Boas order: the tree is split at half
its height, the upper part is stored first and the lower parts follow, each in the same
order again. Reading a path of any length then touches few stretches of the value. Node
addresses come from arithmetic alone; construction fills the block level by level
through them, and proofs read siblings through them.

Blocks are built from the leaves to the root and written; proofs go the other
way, each block receiving the path above its root.

Cases: null fields hash as a mark of their own; null languages are a language, the first
one, and null doc_ids come first in their language; documents with equal doc_ids are ordered by their
leaves; equal rows are equal leaves next to each other; null texts differ from empty ones; the greatest
n_chars cannot be raised and stays; an empty table has no rows; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions.ranking import range_ranked
from shelfscope.llm.common import materialise

#: Levels of a block above its leaves.
HEIGHT = 12
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

DIGEST = 32
PATH = T.ArrayType(T.StructType([T.StructField("left", T.BooleanType()), T.StructField("sibling", T.BinaryType())]))


# ---- layout ----------------------------------------------------------------

@cache
def _split(levels: int) -> tuple[tuple[int, int, int], ...]:
    """For each depth below the top: (depth of its upper part's root, nodes of the
    upper part, nodes of each lower part) of the split at which the depth begins a lower part."""
    table: dict[int, tuple[int, int, int]] = {}

    def cut(first: int, count: int) -> None:
        if count == 1:
            return
        upper = count // 2
        lower = count - upper
        table[first + upper] = (first, (1 << upper) - 1, (1 << lower) - 1)
        cut(first, upper)
        cut(first + upper, lower)

    cut(0, levels)
    return tuple(table[d] for d in range(1, levels))


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """Place of every node of a tree, by depth and number within the depth, in van Emde Boas order."""
    at = [np.zeros(1, dtype=np.int64)]
    for depth, (top, upper, lower) in enumerate(_split(height + 1), start=1):
        number = np.arange(1 << depth)
        # a lower part's root comes behind the upper part and the lower parts before it
        at.append(at[top][number >> (depth - top)] + upper + (number & upper) * lower)
    return tuple(at)


def _parent(nodes: list[bytes]) -> bytes:
    return sha256(b"".join(x.hex().encode() for x in nodes)).digest()


def build(leaves: list[bytes], height: int) -> bytes:
    """A block's value. Levels shrink to half, rounded up, for ``height`` times; absent nodes are zero."""
    at = addresses(height)
    block = bytearray(DIGEST * ((2 << height) - 1))
    level = leaves
    for depth in range(height, -1, -1):
        for node, place in zip(level, (at[depth][:len(level)] * DIGEST).tolist()):
            block[place:place + DIGEST] = node
        level = [_parent(level[i:i + 2]) for i in range(0, len(level), 2)]
    return bytes(block)


def path_of(block: bytes, height: int, count: int, number: int) -> list[dict]:
    """The siblings of a leaf's path to the block's root; a lone node has none."""
    at = addresses(height)
    path = []
    for depth in range(height, 0, -1):
        other = number ^ 1
        sibling = None
        if other < count:
            place = int(at[depth][other]) * DIGEST
            sibling = block[place:place + DIGEST]
        path.append({"left": bool(number & 1), "sibling": sibling})
        number >>= 1
        count = (count + 1) >> 1
    return path


def root_of(block: bytes) -> bytes:
    return block[:DIGEST]


def fold(node: bytes, path: list[dict]) -> bytes:
    """The root that a node and the siblings of its path give."""
    for step in path:
        sibling = step["sibling"]
        node = _parent([node] if sibling is None else [sibling, node] if step["left"] else [node, sibling])
    return node


# ---- trees in Spark --------------------------------------------------------

def _blocks(leaves: DataFrame, name: str, bits: int) -> DataFrame:
    """Blocks (tree, block, members, height, value, digest) of the leaves (tree, number, total, member).

    ``member`` is a struct that holds the leaf as ``digest``. A tree of several blocks has
    full-height ones, since its levels go on above them; a tree of one block ends at its root.
    """
    grouped = leaves.groupBy("tree", F.shiftright("number", bits).alias("block"), "total").agg(
        F.sort_array(F.collect_list(F.struct("number", "member"))).alias("members"))
    schema = T.StructType([grouped.schema["tree"], grouped.schema["block"], T.StructField("height", T.IntegerType()),
                           T.StructField("value", T.BinaryType()), T.StructField("digest", T.BinaryType()),
                           grouped.schema["members"]])

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                digests = one.column(3).flatten().field("member").field("digest").to_pylist()
                total = one.column(2)[0].as_py()
                height = bits if total > 1 << bits else (len(digests) - 1).bit_length()
                value = build(digests, height)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(1), pa.array([height], pa.int32()), pa.array([value], pa.binary()),
                     pa.array([root_of(value)], pa.binary()), one.column(3)],
                    names=["tree", "block", "height", "value", "digest", "members"])

    return materialise(grouped.mapInArrow(construct, schema), f"merkle-{name}")


def _down(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """(tree, member, path) of all members, whose paths go on with that of their block (tree, number, path)."""
    if above is None:
        joined = blocks.withColumn("above", F.array().cast(PATH))
    else:
        joined = blocks.join(above.select(F.col("tree").alias("t"), F.col("number").alias("n"), F.col("path").alias("above")),
                             F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("n")))
    rows = joined.select("tree", "height", "value", "members", "above")
    schema = T.StructType([blocks.schema["tree"], *blocks.schema["members"].dataType.elementType, T.StructField("path", PATH)])

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                height, value = one.column(1)[0].as_py(), one.column(2)[0].as_py()
                inside = one.column(3).flatten()
                rest = one.column(4)[0].as_py()
                count = len(inside)
                # parts bound the paths that are Python objects at a time
                for first in range(0, count, 512):
                    part = inside.slice(first, 512)
                    paths = [path_of(value, height, count, first + i) + rest for i in range(len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([one.column(0)] * len(part)), part.field("number"), part.field("member"),
                         pa.array(paths, pa.list_(pa.struct([("left", pa.bool_()), ("sibling", pa.binary())])))],
                        names=["tree", "number", "member", "path"])

    return rows.mapInArrow(retrieve, schema)


def _tree(leaves: DataFrame, name: str, bits: int) -> list[DataFrame]:
    """The tables of blocks of all trees of ``leaves``, from the leaves up, until each tree is one block.

    Roots of trees that end earlier are handed on as the only leaf of the next block, whose height is 0.
    """
    tables = [_blocks(leaves, name, bits)]
    while True:
        sizes = tables[-1].groupBy("tree").agg(F.max("block").alias("last"))
        if not (sizes.agg(F.max("last")).first()[0] or 0):
            return tables
        totals = sizes.select(F.col("tree").alias("t"), (F.col("last") + 1).alias("total"))
        roots = tables[-1].join(totals, F.col("tree").eqNullSafe(F.col("t"))).select(
            "tree", F.col("block").alias("number"), "total", F.struct("digest").alias("member"))
        tables.append(_blocks(roots, name, bits))


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """(tree, number, total, member): rows numbered within their tree over ranges of all rows."""
    rest = [c for c in rows.columns if c != tree and c not in order]
    ranked = range_ranked(rows.select(F.struct(tree, *order, *rest).alias("key")), "key")
    ranked = ranked.select(F.col(f"key.{tree}").alias("tree"), F.struct(*[f"key.{c}" for c in order + rest]).alias("member"), "start")
    ranked = materialise(ranked, "merkle-numbers")
    sizes = ranked.groupBy("tree").agg(F.min("start").alias("first"), F.count("*").alias("total"))
    return ranked.join(sizes.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).select(
        "tree", (F.col("start") - F.col("first")).cast("long").alias("number"), "total", "member")


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**instead: Column) -> Column:
    """The digest of a document's fields, with some of them replaced."""
    return F.unhex(F.sha2(F.concat(*[_field(instead.get(name, F.col(name))) for name in FIELDS]), 256))


def proofs(documents: DataFrame, tampered: Column, bits: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, changed) of every document: ``changed`` is the digest of the
    document with ``tampered`` for its n_chars, where that differs, and ``path`` its
    siblings from the leaf to the root."""
    changed = F.when(tampered != F.col("n_chars"), leaf_digest(n_chars=tampered))
    leaves = materialise(documents.select("lang", "doc_id", leaf_digest().alias("digest"), changed.alias("changed")), "merkle-leaves")
    langs = _tree(_numbered(leaves, "lang", ["doc_id", "digest"]), "lang", bits)
    subroots = langs[-1].select(F.lit(0).alias("all"), F.col("tree").alias("lang"), "digest")
    whole = _tree(_numbered(subroots, "all", ["lang", "digest"]), "all", bits)

    path = None
    for blocks in reversed(whole):
        path = _down(blocks, path)
    top = whole[-1].select("digest").first()  # one value
    tops = materialise(path.select(F.col("member.lang").alias("tree"), F.lit(0).cast("long").alias("number"),
                                   F.col("member.digest").alias("subroot"), F.lit(top and bytes(top.digest)).cast("binary").alias("root"),
                                   "path"), "merkle-tops")
    path = tops
    for blocks in reversed(langs):
        path = _down(blocks, path)
    named = path.select("tree", "member.*", "path").join(
        tops.select(F.col("tree").alias("t"), "subroot", "root"), F.col("tree").eqNullSafe(F.col("t")))
    return named.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "changed")


def manifest_report(documents: DataFrame, bits: int = HEIGHT) -> DataFrame:
    """Every document's digests, proof, and the root that its tampered or own leaf gives."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(F.coalesce(hit, F.lit(False)), F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    proved = proofs(documents, tampered, bits).select(
        "doc_id", "leaf", "subroot", "root", "path", F.coalesce("changed", "leaf").alias("presented"))
    doc_type = documents.schema["doc_id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof, folded = [], []
            for row in range(batch.num_rows):
                path = batch.column(4)[row].as_py()
                proof.append(sha256(b"".join(s["sibling"].hex().encode() for s in path if s["sibling"])).digest())
                folded.append(fold(batch.column(5)[row].as_py(), path))
            hexed = [[x.hex() for x in column] for column in
                     (*(batch.column(i).to_pylist() for i in (1, 2, 3)), proof, folded)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(x, pa.string()) for x in hexed]
                + [pa.array([a == b for a, b in zip(hexed[2], hexed[4])], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return proved.mapInArrow(check, f"doc_id {doc_type}, leaf string, subroot string, root string, "
                                    "proof_sha256 string, folded_root string, verified boolean")
