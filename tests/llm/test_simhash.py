import random

import numpy as np
import pytest
import xxhash

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import simhash
from shelfscope.llm.components import components


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, distance=4):
    """pairs: (doc_id, fingerprint); the least id reachable, by brute force."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(pairs):
        ids.setdefault(find(i), []).append(doc)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(pairs))]


TEXTS = ["", None, " \t\x0b", "one", "One two  three", "a b c d e", "A\x1cb É é\x85 c d", "w " * 30000,
         "the same words again and again " * 3, "z" * 50000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def clustered(seed, n, flips):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(max(2, n // 20))] + [0, 2**64 - 1]
    out = []
    for _ in range(n):
        x = rng.choice(bases)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


def edges_of(spark, codes, **options):
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long").repartition(3)
    return [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in simhash.near_edges(df, **options).collect()]


@pytest.mark.parametrize("seed,tile", [(1, None), (2, 8), (3, 40)])
def test_links_equal_brute_force(spark, seed, tile):
    codes = clustered(seed, 500, 6)
    want = plain_components(list(enumerate(codes)))
    at = {c: i for i, c in enumerate(codes)}
    root = list(range(len(codes)))
    for a, b in edges_of(spark, codes, tile=tile):
        ra, rb = root[at[a]], root[at[b]]
        root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    assert root == want


def test_index_over_many_levels():
    codes = np.array(clustered(5, 3000, 5), dtype=np.uint64)
    bucket = (codes >> np.uint64(60)).astype(np.int64)
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    order = np.lexsort((rank, bucket))
    bucket, codes = bucket[order], codes[order]
    index = simhash.GrayIndex(bucket, codes)
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4) & (bucket[:, None] == bucket[None, :])
    a, b = index.links(0, len(codes), 4, np.arange(len(codes)))
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i, j in np.argwhere(near).tolist() if i < j]


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def sample_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(50 + i, " ".join(base)) for i in range(5)]
    for i in range(25):
        near = list(base)
        near[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    return rows + [(300, ""), (301, None), (50, rows[0][1]), (None, rows[0][1]), (None, "lonely words of no id here")]


def test_report_equals_brute_force(make_docs):
    rows = sample_rows()
    pairs = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(pairs, plain_components(pairs))), key=str)
    docs = make_docs(rows).withColumnRenamed("source", "component_id").withColumnRenamed("lang", "fp")
    assert sorted((tuple(r) for r in simhash.near_duplicate_report(docs).collect()), key=str) == want
    assert simhash.near_duplicate_report(docs.limit(0)).count() == 0


def test_keep_one_of_each_group(make_docs):
    rows = sample_rows()
    pairs = [(d, plain_fingerprint(t)) for d, t in rows]
    docs = make_docs(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted([r.doc_id for r in kept.collect()], key=str)
    assert got == sorted(set(plain_components(pairs)), key=str)
