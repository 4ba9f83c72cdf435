import random
import re
from collections import Counter

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import quality


def plain(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    dup, rep = len(lines) - len(set(lines)), len(covered)
    failed = n < 10 or 100 * rep > 20 * n
    kept = not (failed or 10 * symbols > 3 * n or 2 * len(re.findall("[!?]", text)) > n or 2 * dup > len(lines)
                or chars > 20 * n or chars < 2 * n)
    return doc_id, n, chars, symbols, dup, rep, failed, kept


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 4)))
    out = [(1, None), (2, ""), (3, " \t\x0b\x0c\r\n"), (4, "one"), (5, "a b c d e"), (6, "a b c d e " * 2), (7, "x " * 30),
           (8, "A\x1cb c\x85d e\xa0f"), (9, "w" * 5000), (10, "l one\nl two\nl one\n\n \nl one"), (None, "n " * 12)]
    for i in range(60):
        few = [word() for _ in range(rng.choice([3, 30, 300]))]
        out.append((20 + i, rng.choice([" ", "\n", "\t ", "!! ", "### "]).join(rng.choice(few) for _ in range(rng.randint(5, 200)))))
    return out + [out[25], (99, " ".join(str(i) for i in range(6000)) + " 1 2 3 4 5 6")]


def test_report_equals_plain(make_docs):
    docs = make_docs(rows()).withColumnRenamed("source", "kept").withColumnRenamed("lang", "n_words")
    got = sorted((tuple(r) for r in quality.quality_report(docs, sample_rows=20).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows()), key=str)
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_cascade_keeps_the_same_in_any_order(make_docs):
    docs = make_docs(rows())
    want = sorted((r[0] for r in rows() if plain(*r)[-1]), key=str)
    for rules in (quality.RULES, quality.RULES[::-1]):
        kept = quality.cascade(docs, rules, 30)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_order_is_by_rejections_for_the_cost(make_docs):
    a, b, c = quality.RULES[:3]
    assert quality.ordered([(a, 1.0, 0.1), (b, 0.1, 0.05), (c, 5.0, 0.0)]) == [b, a, c]
    found = quality.estimate(make_docs(rows()), rows=10_000)
    assert [f[0] for f in found] == list(quality.RULES) and all(f[1] > 0 and 0 <= f[2] <= 1 for f in found)
    assert found[0][2] == sum(plain(*r)[1] < 10 for r in rows()) / len(rows())


def test_no_python_in_the_plan(make_docs):
    plan = quality.quality_report(make_docs(rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1] and "Arrow" not in plan.split("== Physical Plan ==")[1]
