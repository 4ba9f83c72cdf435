import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import secrets

CASES = [
    "", None, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b9"', "PassWord: 'short' api_key=abcdefghijkl APIKEY:==abcdefghijklm",
    "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "AKIA" + "A" * 13 + " AKIA" + "Z9" * 7, "é" * 5 + "0123456789abcdef0" + "x",
    "secret=secret=abcdefghijkl", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-1234567890-abc",
    "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "passwd" + "a" * 100000, "0" * 100000, "pass", "wordtoken"]


def brute(text):
    spans = []
    for number, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), number, rule.kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(spans)]


def test_rows_equal_plain_search(make_docs):
    docs = make_docs(list(enumerate(CASES)) + [(3, CASES[3]), (None, "AKIA" + "B" * 20)]).withColumnRenamed("lang", "spans")
    got = sorted((tuple(r) for r in secrets.secrets_report(docs).collect()), key=str)
    want = []
    for doc_id, text in [*enumerate(CASES), (3, CASES[3]), (None, "AKIA" + "B" * 20)]:
        spans = brute(text)
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        join = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
        n = lambda kind: sum(s[0] == kind for s in spans)
        want.append((doc_id, n("assign"), n("access"), n("hex"), hashlib.sha256(join(base).encode()).hexdigest(), join(spans)))
    assert got == sorted(want, key=str)
    assert secrets.secrets_report(docs.limit(0)).count() == 0


def test_queries_of_the_rules():
    assert secrets.trigram_query("[0-9a-f]+") == ("all",)
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("tri", "aki"), ("tri", "kia"))
    assert secrets._named(secrets.trigram_query(secrets.BASE_RULES[0].pattern)) >= {"pas", "tok", "pik", "i_k"}
    assert secrets.trigram_query("ab|abcd") == ("all",)
    assert secrets.trigram_query("(abc)?x") == ("all",)


@pytest.mark.parametrize("pattern", ["abc|bcd+e", "a(bc|cb)?de", "(ab){2,}c", "x[yz]w.*abc", "(?i:AbC)d", "a?b?c?abc$", "[ab][bc][cd]"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcdexyzwABC", max_size=12), max_size=8))
def test_candidates_hold_every_match(pattern, texts):
    raw = [t.encode() for t in texts]
    query = secrets.trigram_query(pattern)
    index = secrets.postings(raw, sorted(secrets._named(query)))
    found = set(secrets.candidates(query, index, len(raw)).tolist())
    assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= found
    for trigram, numbers in index.items():
        assert numbers.tolist() == [i for i, t in enumerate(texts) if trigram in t.lower()]


def test_long_runs_are_read_once():
    import time
    from shelfscope.llm import secrets
    scan = secrets._scanner(secrets.RULES)
    token = "eyJabcdefghij.klmnopqrstuv.wxyz0123456789"
    began = time.perf_counter()
    found = scan([b"eyJ" * 700000, b"eyJ" * 300000 + b"." + b"eyJ" * 300000, (f"xx{token} -{token}").encode(), b"eyJabc.d"])
    assert time.perf_counter() - began < 10
    assert found[0] == found[1] == found[3] == []
    assert [(k, s, e) for s, _, k, e, _ in found[2]] == [("jwt", 2, 2 + len(token)), ("jwt", 4 + len(token), 4 + 2 * len(token))]
