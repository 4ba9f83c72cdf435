import hashlib
import struct

import public_tokenizers
import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENC = bpe.encoding(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.mark.parametrize("text", [
    "", "a", "It's we'll  two   blanks\n\n\tx 　y z", "naïve 日本語 ١٢٣ \U0001f600!! don't",
    "word " * 4000, "x" * 3000 + " " * 50 + "y", "a\x1c b\x85 c", " \n" * 900 + "end"])
def test_cut_text_equals_the_library(text):
    assert bpe.encode_text(ENC, text, chunk=64) == ENC.encode_ordinary(text)


def test_long_blanks_equal_the_library():
    for text in ("ab " + " " * 20000 + "cd", "ab" + "\n" * 20000, " " * 9000 + "\tx " + "y " * 9000):
        assert bpe.encode_text(ENC, text, chunk=64) == ENC.encode_ordinary(text)


def test_very_long_blanks_do_not_overflow():
    text = "a" + " " * 1_500_000 + "b"
    assert ENC.decode_bytes(bpe.encode_text(ENC, text)) == text.encode()


def test_round_trip_rows(make_docs):
    rows = [(1, "Hello world, it's é"), (1, "Hello world, it's é"), (2, None), (None, ""), (3, "z " * 70000)]
    got = sorted((tuple(r) for r in bpe.round_trip(make_docs(rows), RANKS, public_tokenizers.PATTERN).collect()),
                 key=str)
    want = []
    for doc_id, text in rows:
        ids = ENC.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_decode_columns_and_empty_table(make_docs):
    docs = make_docs([(1, "é\n x"), (2, None)]).withColumnRenamed("source", "ids_sha256")
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: "é\n x".encode(), 2: b""}
    assert bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
