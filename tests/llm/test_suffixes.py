import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import suffixes


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab", max_size=60), st.text("abc\x01", max_size=40), st.text("a", max_size=30)))
def test_suffix_array(text):
    text += "\x00"
    assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_every_string_holds_an_anchor():
    rng = random.Random(1)
    for data in (bytes(rng.randrange(97, 100) for _ in range(3000)), b"a" * 700, b"ab" * 400, b"x" * 199):
        found = set(suffixes.anchors(np.frombuffer(data, np.uint8)).tolist())
        for i in range(len(data) - 199):
            assert any(j in found for j in range(i, i + 73))


def test_repeated_windows_equal_plain_search():
    rng = random.Random(2)
    base = [bytes(rng.randrange(97, 100) for _ in range(72)) for _ in range(4)]
    segments = set()
    for _ in range(40):
        left, right = rng.choice(base), rng.choice(base)
        left, right = bytearray(left[rng.choice([0, 0, 20]):]), bytearray(right[:rng.choice([72, 72, 50])])
        left[rng.randrange(len(left))] = 0
        right[rng.randrange(len(right))] = 255
        segments.add((bytes(left), bytes(right)))
    segments = sorted(segments)
    strings = Counter()
    for left, right in segments:
        for x in range(len(left) + 1):
            if len(left) - x + len(right) >= 72:
                strings[(left[x:], right[:72 - (len(left) - x)])] += 1
    want = [[x for x in range(len(left) + 1) if len(left) - x + len(right) >= 72
             and strings[(left[x:], right[:72 - (len(left) - x)])] > 1] for left, right in segments]
    assert suffixes.repeated_windows(segments) == want


def plain(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixture(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(20, 120)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(5, 80))]
        for _ in range(rng.randint(0, 4)):
            passage = rng.choice(shared).split(" ")
            if rng.random() < 0.6:
                passage[rng.randrange(len(passage))] = word()
            a = rng.randrange(max(1, len(passage) // 2))
            parts += [" ".join(passage[a:]), prose(rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(n, rows[0][1]), (n, rows[0][1]), (None, rows[1][1]), (n + 1, None), (n + 2, ""), (n + 3, "q" * 199),
             (n + 4, "q" * 200), (n + 5, "a" * 3000), (n + 6, "ab" * 1000 + "c"), (n + 7, prose(5000)), (n + 8, "z" * 201)]
    return rows


@pytest.mark.parametrize("seed,group", [(1, 1024), (2, 3), (3, 1)])
def test_report_equals_plain_search(make_docs, seed, group):
    rows = mixture(seed, 60)
    docs = make_docs(rows).withColumnRenamed("source", "text_key").withColumnRenamed("lang", "spans")
    assert sorted((tuple(r) for r in suffixes.repeats_report(docs, group=group).collect()), key=str) == plain(rows)


def test_small_chunks_and_empty_table(make_docs):
    rows = mixture(4, 30)
    docs = make_docs(rows)
    assert sorted((tuple(r) for r in suffixes.repeats_report(docs, chunk=500).collect()), key=str) == plain(rows)
    assert suffixes.repeats_report(docs.limit(0)).count() == 0
    assert {r.doc_id for r in suffixes.remove_repeats(docs).collect()} == {r[0] for r in rows}


def test_copies_of_a_text_send_their_segments_once(make_docs, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    near = text[:450] + "#" + text[451:]
    rows = [(i, text) for i in range(40)] + [(40, near)] + [(41 + i, "".join(rng.choice("abcdefgh") for _ in range(500))) for i in range(9)]
    written = {}
    plain_materialise = suffixes.materialise
    monkeypatch.setattr(suffixes, "materialise", lambda df, name: written.setdefault(name, plain_materialise(df, name)))
    assert sorted((tuple(r) for r in suffixes.repeats_report(make_docs(rows)).collect()), key=str) == plain(rows)
    segments = [tuple(r) for r in written["segments"].collect()]
    assert segments and len(segments) == len(set(segments))


def test_entries_of_a_hot_anchor_are_not_gathered_in_python(make_docs):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    line = word(150)
    rows = [(i, word(100) + line + word(100)) for i in range(60)] + [(60, word(300)), (61, word(20) + line + word(100))]
    docs = make_docs(rows)
    requests = suffixes._requests(suffixes._anchor_rows(suffixes._keyed(docs), 1000), 4)
    uses = Counter(r.use for r in requests.collect())
    assert uses[suffixes.BYTES | suffixes.HOT] >= 61
    plan = requests._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "PythonMapInArrow" not in plan
    assert sorted((tuple(r) for r in suffixes.repeats_report(docs, chunk=1000, group=4).collect()), key=str) == plain(rows)
