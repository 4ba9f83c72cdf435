"""Byte-level BPE encoding and decoding with a local rank file.

Each text is encoded whole by the tiktoken library. Texts longer than
``CHUNK`` characters are cut where the pre-splitting pattern certainly ends a
match, so memory and the pattern's backtracking stay bounded and the ids equal
those of the uncut text. Decoding joins the raw bytes of the ids, so any id
sequence, also one that cuts a character, gives its exact bytes.

Cases: null text counts as empty; an empty text has no ids; repeated rows and
null ids of documents are kept row by row; an empty table gives an empty one;
other columns of the input do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.common import map_batches, slices, string_list, whole_text

#: Characters after which a long text is cut at the next safe place.
CHUNK = 1 << 16
#: The rank file is sent to the tasks whole; larger files are refused.
MAX_RANK_BYTES = 64 << 20

# A place between a character that is no white space and a blank or line break:
# no alternative of the pattern matches white space behind anything else.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
# White space as the pattern's library has it (fixed values).
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_BLANK = re.compile(f"[{_BLANK}]{{8192,}}")

_ENCODINGS: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return data


def encoding(rank_bytes: bytes, pattern: str):
    """The tiktoken encoding of a rank file, built once per Python worker."""
    import tiktoken

    key = hashlib.sha256(rank_bytes + pattern.encode()).digest()
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(token): int(rank)
                 for token, rank in (line.split() for line in rank_bytes.splitlines() if line.strip())}
        _ENCODINGS[key] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _chunks(text: str, size: int) -> Iterator[str]:
    """Parts of ``text`` between safe places, each about ``size`` long."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of a whole text, equal to ``enc.encode_ordinary(text)``.

    A very long run of white space, where the pattern's engine would overflow,
    is one match (less its last character if something follows), so its bytes
    are merged directly.
    """
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0

    def plain(part: str) -> None:
        for piece in _chunks(part, chunk):
            ids.extend(enc.encode_ordinary(piece))

    for run in _LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > start:
            plain(text[start:run.start()])
        ids.extend(enc._encode_single_piece(text[run.start():end]))
        start = end
    if start < len(text):
        plain(text[start:])
    return ids


def encode(docs: DataFrame, rank_path: str, pattern: str, column: str = "text",
           output: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``column`` in an array column ``output``."""
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        enc = encoding(data.value, pattern)
        # arrays, not lists: a batch of ids as Python numbers takes ten times the memory
        return pd.Series([np.asarray(encode_text(enc, x or ""), dtype=np.int32) for x in texts], dtype=object)

    return docs.withColumn(output, ids(whole_text(column)))


def decode(tokens: DataFrame, rank_path: str, pattern: str, column: str = "ids",
           output: str = "decoded") -> DataFrame:
    """``tokens`` with the raw bytes of the ids in a binary column ``output``."""
    data = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf("binary")
    def raw(rows):
        import pandas as pd

        enc = encoding(data.value, pattern)
        return pd.Series([enc.decode_bytes(np.asarray(x).tolist() if x is not None else []) for x in rows], dtype=object)

    return tokens.withColumn(output, raw(F.col(column)))


def encode_and_decode(docs: DataFrame, rank_path: str, pattern: str, column: str = "text",
                      ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``column`` and the raw bytes they decode to, by one Python step.

    Columns of these names are replaced. Batches are taken in small parts, so that few
    ids are Python numbers at a time.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (ids, decoded)))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())),
                           T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(data.value, pattern)
        for batch in batches:
            for part in slices(batch):
                found, raw = [], []
                for text in string_list(part.column(column)):
                    each = encode_text(enc, text)
                    found.append(np.asarray(each, dtype=np.int32))
                    raw.append(enc.decode_bytes(each))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.list_(pa.int32())), pa.array(raw, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids and digests of the ids and the decoded bytes.

    Encoding and decoding share a task, so the ids are never shuffled or kept.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def digests(batch: pa.RecordBatch) -> dict:
        enc = encoding(data.value, pattern)
        counts, ids_sha, raw_sha = [], [], []
        for text in string_list(batch.column("text")):
            ids = encode_text(enc, text)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
            raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids_sha,
                "decoded_sha256": raw_sha}

    return map_batches(docs.select("doc_id", whole_text().alias("text")), digests,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
