import random
import time
import tracemalloc

import numpy as np
import pytest

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import tiling


def plain_tiles(item, doc, least):
    """Greedy string tiling by its definition."""
    used_i, used_d, found = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for p in range(len(item)):
            for q in range(len(doc)):
                k = 0
                while p + k < len(item) and q + k < len(doc) and item[p + k] == doc[q + k] and not used_i[p + k] and not used_d[q + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (p, q, k)
        if best is None:
            return sorted(found)
        found.append(best)
        for k in range(best[2]):
            used_i[best[0] + k] = used_d[best[1] + k] = True


@pytest.mark.parametrize("seed", range(25))
def test_tiles_equal_the_definition(seed):
    rng = random.Random(seed)
    letters = "abcd" if seed % 2 else "abcdefghij"
    doc = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
    item = []
    while len(item) < 25 and doc:
        a = rng.randrange(len(doc))
        item += doc[a:a + rng.randint(2, 12)]
        item.append(rng.choice(letters))
    least = rng.choice([2, 3, 5])
    number = {t: k for k, t in enumerate("abcdefghij", 1)}
    ids = [np.array([number[t] for t in side], dtype=np.int64) for side in (item, doc)]
    assert tiling.tiles(*ids, least) == plain_tiles(item, doc, least)


def test_a_repeated_word_needs_no_pairs():
    # 400,000 equal words against an item of 2,000: 8 * 10**8 pairs of places, if they were listed
    block = tiling.Block([(1, "la " * 2000), (2, "la lu " * 300)])
    tracemalloc.start()
    start = time.perf_counter()
    assert block.covered("la " * 400_000, 0.8) == [(1, 2000, 2000, 1)]
    assert block.covered("lu la " * 100_000 + "end", 0.8) == [(2, 600, 600, 1)]
    spent, (_, peak) = time.perf_counter() - start, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert spent < 30 and peak < 500_000_000


def test_rolling_windows():
    ids = np.array([1, 2, 3, 1, 2, 3, 4])
    value = tiling.rolling(ids, 3)
    assert len(value) == 5 and value[0] == value[3] and len(set(value.tolist())) == 4
    assert len(tiling.rolling(ids[:2], 3)) == 0


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    items = [(i, " ".join(prose(rng.randint(20, 60)))) for i in range(12)] + [
        (20, None), (21, ""), (22, "Two words"), (23, "!!"), (None, "an item that has no number at all here")]
    rows = []
    for i in range(60):
        body = prose(rng.randint(0, 200))
        if i % 2:
            passage = items[rng.randrange(12)][1].split()
            way = rng.randrange(4)
            if way == 1:
                cut = rng.randrange(len(passage))
                passage = passage[cut:] + prose(9) + passage[:cut]
            elif way == 2:
                for _ in range(rng.randint(1, 6)):
                    passage[rng.randrange(len(passage))] = "changed"
            elif way == 3:
                passage = passage[:len(passage) // 2]
            body = body + [w.upper() if way == 0 else w for w in passage] + prose(20)
        rows.append((i, rng.choice([" ", "\n", ", "]).join(body)))
    return rows + [rows[1], (100, None), (101, ""), (102, "two WORDS!"), (None, "x an item that has no number at all here"),
                   (103, "w1 " * 30000)], items


def plain(rows, items):
    out = []
    for doc_id, text in rows:
        doc = tiling.tokens_of(text or "")
        for item_id, body in items:
            item = tiling.tokens_of(body or "")
            if not item or len(doc) > 5000:
                continue
            found = plain_tiles(item, doc, min(5, len(item)))
            covered = sum(k for *_, k in found)
            if covered >= 0.8 * len(item):
                out.append((doc_id, item_id, len(item), covered, 1 if len(item) < 5 else len(found), covered / len(item)))
    return sorted(out, key=str)


def test_report_and_stage(spark, make_docs):
    rows, items = corpus()
    docs = make_docs(rows).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "tiles")
    benchmark = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in tiling.leak_report(docs, benchmark).collect()), key=str)
    want = plain(rows, items)
    assert got == want and len(want) > 15
    blocks = tiling.leaks(docs, benchmark, block_tokens=60).drop("text_hash")
    assert sorted((tuple(r) for r in blocks.collect()), key=str) == want
    kept = tiling.decontaminate(docs, benchmark, block_tokens=200)
    leaked = {w[0] for w in want}
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in leaked)


def test_empty_tables(spark, make_docs):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert tiling.leak_report(make_docs(rows).limit(0), benchmark).count() == 0
    assert tiling.leak_report(make_docs(rows), benchmark.limit(0)).count() == 0
    assert tiling.decontaminate(make_docs(rows), benchmark.limit(0)).count() == len(rows)
