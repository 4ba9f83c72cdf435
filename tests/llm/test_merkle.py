import hashlib
import zlib

import pytest

from shelfscope.llm import merkle as m

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, number long, "
          "key string, path string")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root of hex digests, and for each of them its (is right, sibling) pairs."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, at in enumerate(where):
            paths[i].append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else None))
            where[i] = at // 2
        level = [digest("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    langs = {}
    for row in rows:
        doc_id, text, lang, source, n_chars = row
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = leaf(*row)
        langs.setdefault(lang, []).append((doc_id, own, leaf(doc_id, text, lang, source, n_chars + 1) if hit else own))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for found in langs.values():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in langs[name]]) for name in names]
    root, above = tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for name, (subroot, paths), rest in zip(names, trees, above):
        for (doc_id, own, shown), path in zip(langs[name], paths):
            for right, other in path + rest:
                shown = digest(shown if other is None else other + shown if right else shown + other)
            proof = digest("".join(other or "" for _, other in path + rest))
            out.append((doc_id, own, subroot, root, proof, shown, shown == root))
    return sorted(out, key=str)


def documents():
    rows = [(i, f"text {i} é" * (i % 5), ("en", "de", "fr")[min(i % 7, 2)], "s", i) for i in range(150)]
    rows += [(200, "alone", "zz", None, 5), (201, None, None, None, None), (None, "x", "en", "", 3), (None, "x", "en", "", 3),
             (3, "another", "en", "s", 1), (4, "", "", "s", 0), (5, "long " * 50000, "é", "s", 250000), (14, "n", "en", "s", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, "c", "d") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [m.HEIGHT, 2])
def test_report_equals_plain(spark, bits):
    got = m.manifest_report(frame(spark, documents()), bits)
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == plain(documents())
    assert {r[-1] for r in found} == {True, False}


def test_few_rows(spark):
    for rows in ([], [(1, "x", "en", "s", 1)], [(1, None, None, None, None)] * 3):
        assert sorted((tuple(r) for r in m.manifest_report(frame(spark, documents()[:1] + rows).where("doc_id != 0"), 1).collect()),
                      key=str) == plain(rows)


def test_addresses_are_those_of_the_recursive_layout():
    def lay(depth, number, levels):
        if levels == 1:
            return [(depth, number)]
        upper = levels // 2
        out = lay(depth, number, upper)
        for k in range(1 << upper):
            out += lay(depth + upper, (number << upper) + k, levels - upper)
        return out

    for height in range(10):
        at = m.addresses(height)
        for place, (depth, number) in enumerate(lay(0, 0, height + 1)):
            assert at[depth][number] == place
