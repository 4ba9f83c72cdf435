import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from shelfscope.llm import packing as p

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start string, length string, key string, sequence_id string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(VOCABULARY)
    found.encode_special_tokens = True
    return found


def texts():
    rng = random.Random(4)
    words = ["The", "cat's", "don't.", "été,", "ΑΣ", "x1.5,", "!!,", "a.b", "u.s.", "\x1cz", "é", "́q", "ﬁ", "<|endoftext|>", "　w", "A,B",
             "we'll,", "...", "漢字", "\U0001f600"]
    return ["", None, " \n ", "word"] + [
        "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", ""]) for _ in range(rng.choice([3, 40, 400, 3000]))) for _ in range(60)]


def test_ids_equal_the_tokenizers(tokenizer, monkeypatch):
    worker = p._Worker(p.read_vocabulary(VOCABULARY))
    monkeypatch.setattr(p, "WINDOW", 500)
    monkeypatch.setattr(p, "REMEMBERED", 40)
    found = worker.encode([(text or "").encode() for text in texts()])
    assert found == [p._packed(tokenizer.encode(text or "", add_special_tokens=False).ids) for text in texts()]
    letters = [chr(c) for c in range(32, 0x250)] + ["́", ".", ",", "ά", "ς", "İ"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        assert worker.encode([text.encode()]) == [p._packed(tokenizer.encode(text, add_special_tokens=False).ids)], text


def test_report(spark, tokenizer):
    rows = [(i % 50 if i % 9 else None, t) for i, t in enumerate(texts())] + [(7, "same text."), (7, "same text."), (None, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)
    got = p.packing_report(df, VOCABULARY)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = got.collect()
    want = Counter()
    total = 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start:start + 4096], "<u4")
            want[doc_id, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 1
    assert p.packing_report(df.limit(0), VOCABULARY).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    packed = p.pack(p.pieces(df, VOCABULARY, 1000, with_ids=True), 1000)
    found = {r.sequence_id: r.ids for r in p.sequences(packed).collect()}
    whole = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts())}
    for r in packed.collect():
        assert found[r.sequence_id][r.offset:r.offset + r.length] == whole[r.doc_id][r.start:r.start + r.length]
    assert max(map(len, found.values())) <= 1000


def test_plan_uses_every_piece_and_few_sequences():
    rng = random.Random(1)
    for capacity, lengths in ((4096, [min(4096, int(rng.lognormvariate(6.3, 1))+1) for _ in range(20000)]),
                              (100, [rng.randint(1, 100) for _ in range(5000)]), (100, [51] * 70), (100, [100] * 9 + [1]), (10, [4] * 1000 + [3] * 10)):
        histogram = Counter(lengths)
        plan = p.plan(histogram, capacity)
        used = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= capacity
            for length in pattern:
                used[length] += times
        assert used == histogram
        counts = np.zeros(capacity + 1, dtype=int)
        for length, n in histogram.items():
            counts[length] = n
        plainly = sum(times for _, times in p._best_fit(counts, capacity))
        assert sum(times for _, times in plan) <= plainly * 1.004 + 1
    assert p.plan({}) == []


def test_plan_does_not_grow_with_the_number_of_documents():
    rng = random.Random(3)
    histogram = Counter(min(4096, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(5000))
    many = p.plan({k: v * 10 ** 9 for k, v in histogram.items()})
    assert len(many) < 10 * len(histogram)
    total = sum(k * v for k, v in histogram.items()) * 10 ** 9
    assert sum(times for _, times in many) < 1.01 * total / 4096
