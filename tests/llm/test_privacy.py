import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import privacy

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                key = m[0].lower() if kind == "email" else m[0] if kind == "ip" else digits
                out.append((m.start(), rank, kind, m.end(), f"{kind}:{key}"))
    return sorted(out)


def words(text):
    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]{4,}", text)]


def beside(text):
    """(entity, term, start, end) of whole words at most REACH characters from an identifier."""
    out, reach = [], privacy.REACH
    for start, _, kind, end, entity in base(text):
        others = [m.span() for m in re.finditer(dict(email=EMAIL, ip=IP, card=CARD, phone=PHONE)[kind], text)]
        low = max((b for _, b in others if b <= start), default=0)
        high = min((a for a, _ in others if a >= end), default=len(text))
        before, after = text[max(low, start - reach - 1):start], text[end:min(high, end + reach + 1)]
        if len(before) > reach:
            before = regex.sub(r"^[\p{L}\p{N}]+", "", before)
        if len(after) > reach:
            after = regex.sub(r"[\p{L}\p{N}]+$", "", after)
        out += [(entity, w, start - len(before) + x, start - len(before) + y) for x, y, w in words(before)]
        out += [(entity, w, end + x, end + y) for x, y, w in words(after)]
    return out


def plain(rows, support=3, disclosure=0.9):
    texts = {t or "" for _, t in rows}
    entity_texts, pair_texts, term_texts = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for *_, e in base(t):
            entity_texts[e].add(t)
        for e, w, _, _ in beside(t):
            pair_texts[e, w].add(t)
        for _, _, w in words(t.lower()):
            term_texts[w].add(t)
    n = len(texts)
    reveals = set()
    for (e, w), both in pair_texts.items():
        information = math.log(n / len(entity_texts[e]))
        if len(both) >= support and information > 0 and math.log(
                n * len(both) / (len(term_texts[w]) * len(entity_texts[e]))) >= disclosure * information:
            reveals.add((e, w))
    out = []
    for doc_id, t in rows:
        t = t or ""
        spans = [(s, r, k, e) for s, r, k, e, _ in base(t)]
        extra = {(s, 5, "term", e) for x, w, s, e in beside(t) if (x, w) in reveals}
        extra = [x for x in extra if not any(s < x[3] and x[0] < e for s, _, _, e in spans)]
        out.append((doc_id, spans, sorted(spans + extra)))
    return out


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    out = [(1, None), (2, ""), (3, "a.b@c.d e@f x@y.z_w@q.r %@a-b.c"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3"),
           (5, "4111 1111 1111 1111 and 4111-1111-1111-1112 4"), (6, "+1 (234) 567-8901 +12 +1234567890123456 +9.99.9999999"),
           (7, "x" * 3000 + "@" + "y" * 3000), (8, "7" * 20000), (9, "é +49 30 1234567 ü someone.else@mail.org"),
           (10, "1 2 3 " * 3000 + "@"), (11, "+" * 50 + "1((((" * 200)]
    for i in range(40):
        out.append((100 + i, prose(rng.randint(20, 60))))
    for i in range(6):
        out.append((200 + i, f"{prose(20)} doctor Quigley9 {word()} wrote q.{i % 2}@mail{i % 2}.example.com Zanzibar {prose(20)}"))
        out.append((300 + i, f"{prose(5)} call +1 555 123 4567 Hemlock{prose(3)} Xylophone. {prose(15)} Xylophone q.0@mail0.example.com"))
    return out + [out[-1], (None, out[-2][1]), (400, "Xylophone " + prose(10))]


def test_report_equals_plain(make_docs):
    docs = make_docs(rows()).withColumnRenamed("source", "spans").withColumnRenamed("lang", "hits")
    got = sorted((tuple(r) for r in privacy.privacy_report(docs).collect()), key=str)
    join = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, k, e in x)
    want = []
    for doc_id, spans, every in plain(rows()):
        n = [sum(s[2] == k for s in spans) for k in privacy.KINDS]
        want.append((doc_id, *n, hashlib.sha256(join(spans).encode()).hexdigest(), join(every)))
    assert got == sorted(want, key=str)
    assert any("term" in w[-1] for w in want)
    assert privacy.privacy_report(docs.limit(0)).count() == 0


def test_sanitise(make_docs):
    docs = make_docs(rows()).withColumnRenamed("lang", "d")
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns
    want = []
    for (doc_id, text), (_, _, every) in zip(rows(), plain(rows())):
        out, done = "", 0
        for s, _, k, e in every:
            if s >= done:
                out += text[done:s] + f"[{k.upper()}]"
            done = max(done, e)
        want.append((doc_id, text if not every else out + text[done:]))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind,pattern", [("email", EMAIL), ("ip", IP), ("card", CARD)])
def test_patterns_match_the_same(spark, kind, pattern):
    rng = random.Random(9)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 30))) for a in ("a@.b_- 1%", "1.2 -", "12.@a ") for _ in range(400)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.m for r in df.select("i", F.regexp_extract_all("text", F.lit(privacy.PATTERNS[kind]), F.lit(0)).alias("m")).collect()}
    assert got == {i: [m[0] for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}
