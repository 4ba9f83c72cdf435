"""Co-occurrence over whole texts, against a plain version without windows."""

import hashlib
import math
from collections import defaultdict

import regex

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import privacy
from test_privacy import base, rows


def words(text):
    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]


def plain(rows, support=3, disclosure=0.9):
    texts = {t or "" for _, t in rows}
    entity_texts, term_texts = defaultdict(set), defaultdict(set)
    for t in texts:
        for *_, e in base(t):
            entity_texts[e].add(t)
        for _, _, w in words(t):
            term_texts[w].add(t)
    reveals = defaultdict(set)
    for e, held in entity_texts.items():
        information = math.log(len(texts) / len(held))
        for w in {w for t in held for _, _, w in words(t)}:
            both = len(held & term_texts[w])
            if both >= support and information > 0 and math.log(
                    len(texts) * both / (len(term_texts[w]) * len(held))) >= disclosure * information:
                reveals[e].add(w)
    out = []
    for doc_id, t in rows:
        t = t or ""
        spans = [(s, r, k, e) for s, r, k, e, _ in base(t)]
        marked = set().union(*(reveals[e] for *_, e in base(t)))
        extra = [(s, 5, "term", e) for s, e, w in words(t) if w in marked]
        out.append((doc_id, spans, sorted(spans + [x for x in extra if not any(s < x[3] and x[0] < e for s, _, _, e in spans)])))
    return out


def report(rows):
    join = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, k, e in x)
    return sorted(((i, *(sum(s[2] == k for s in spans) for k in privacy.KINDS), hashlib.sha256(join(spans).encode()).hexdigest(),
                    join(every)) for i, spans, every in plain(rows)), key=str)


def cleaned(docs):
    return {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}


FILL = "the quick report about nothing much that everyone reads on most days of the year in town "


def others(n=40):
    return [(i, f"{FILL} number{i} of the list") for i in range(n)]


def test_report_equals_plain_without_window(make_docs):
    every = rows() + [(500 + i, f"Lee {FILL}{FILL} note{i} lee.{i}@post.example.net 李明 {FILL * 2}İstanbul Lee pay 20 k.lee@post.example.net")
                      for i in range(5)]
    got = sorted((tuple(r) for r in privacy.privacy_report(make_docs(every)).collect()), key=str)
    assert got == report(every)


def test_name_far_from_the_identifier(make_docs):
    letters = [(100 + i, f"Zorblatt {FILL}{FILL} text{i} z@post.example.net") for i in range(4)]
    got = cleaned(make_docs(others() + letters))
    assert all("Zorblatt" not in got[i] and got[i].startswith("[TERM] the quick") for i, _ in letters)
    assert all(got[i] == t for i, t in others())


def test_every_place_of_a_revealing_term(make_docs):
    letters = [(100 + i, f"the Zorblatt z@post.example.net {FILL}{FILL} text{i} most Zorblatt") for i in range(4)]
    got = cleaned(make_docs(others() + letters))
    assert all(got[i].count("[TERM]") == 2 and "Zorblatt" not in got[i] for i, _ in letters)


def test_short_names(make_docs):
    letters = [(100 + i, f"Lee 李明 z@post.example.net {FILL} text{i}") for i in range(4)]
    got = cleaned(make_docs(others() + letters))
    assert all(got[i].startswith("[TERM] [TERM] [EMAIL] the") for i, _ in letters)


def test_numbers_do_not_end_the_surroundings(make_docs):
    letters = [(100 + i, f"Zorblatt paid 20 with 4111 1111 1111 1111 or 30 to Quixley text{i}") for i in range(4)]
    every = others() + letters
    assert sorted((tuple(r) for r in privacy.privacy_report(make_docs(every)).collect()), key=str) == report(every)
    got = cleaned(make_docs(every))
    assert all("Zorblatt" not in got[i] and "Quixley" not in got[i] and "[CARD]" in got[i] for i, _ in letters)


def test_long_text_of_many_identifiers(make_docs):
    import time
    words = "é nam{0} wrote to a{0}@b.org and 10.{1}.{2}.9, "
    text = "".join(words.format(i, i % 250, i // 250 % 250) for i in range(50000)) + "end é"
    assert len(text) > 1 << 21
    began = time.perf_counter()
    docs = make_docs([(1, text), (2, "nothing here"), (3, "x a7@b.org é c8@d.org")])
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert time.perf_counter() - began < 60
    assert clean[1] == "".join(f"é nam{i} wrote to [EMAIL] and [IP], " for i in range(50000)) + "end é"
    assert clean[2] == "nothing here" and clean[3] == "x [EMAIL] é [EMAIL]"
