"""Oracle SQL of the manifest and of conversation repair, put together from small expressions."""

from __future__ import annotations

from collections.abc import Iterable


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}))"


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


def _leaf(**instead: str) -> str:
    return f"sha256({' || '.join(_field(instead.get(n, n)) for n in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})"


_HALVE = "i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2"
_STEP = """pos // 2, p.k + 1, sha256(CASE WHEN o.h IS NULL THEN p.h WHEN pos % 2 = 1 THEN o.h || p.h ELSE p.h || o.h END),
  proof || coalesce(o.h, '')"""

MANIFEST = f"""
WITH RECURSIVE d AS (SELECT *, {_leaf()} AS leaf,
    CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf(n_chars='(n_chars + 1)')} ELSE {_leaf()} END AS shown FROM documents),
l AS (SELECT doc_id, lang, leaf, shown, row_number() OVER (ORDER BY doc_id) AS id,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
v(lang, k, i, h, n) AS (SELECT lang, 0, i, leaf, n FROM l
  UNION ALL SELECT lang, k + 1, {_HALVE} FROM v WHERE n > 1 GROUP BY lang, k, i // 2, n),
s AS (SELECT lang, k AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM v WHERE n = 1),
w(k, i, h, n) AS (SELECT 0, i, subroot, n FROM s UNION ALL SELECT k + 1, {_HALVE} FROM w WHERE n > 1 GROUP BY k, i // 2, n),
p(id, lang, height, pos, k, h, proof) AS (SELECT id, l.lang, height, l.i, 0, shown, '' FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL SELECT id, p.lang, height, {_STEP} FROM p
    LEFT JOIN v o ON o.lang IS NOT DISTINCT FROM p.lang AND o.k = p.k AND o.i = xor(pos, 1) WHERE p.k < height),
q(id, pos, k, h, proof) AS (SELECT id, s.i, 0, h, proof FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang WHERE p.k = p.height
  UNION ALL SELECT id, {_STEP} FROM q p LEFT JOIN w o ON o.k = p.k AND o.i = xor(pos, 1) WHERE p.k < (SELECT max(k) FROM w))
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, q.h AS folded_root, q.h = r.h AS verified
FROM q JOIN l USING (id) JOIN s ON l.lang IS NOT DISTINCT FROM s.lang, (SELECT h FROM w WHERE n = 1) r
WHERE q.k = (SELECT max(k) FROM w)
"""


# A state of the repair is (cost, audit, out); an absent one is null.
def _edit(state: str, initial: str, cost: str, line: str | None = None) -> str:
    out = f"list_append({state}.o, {line})" if line else f"{state}.o"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'o': {out}}} END"


def _least(options: Iterable[str]) -> str:
    return f"list_min([{', '.join(options)}])"


def _row(state: str, fits: str, role: str) -> list[str]:
    """Keeping a row behind ``state`` where its initial fits, and giving it the role that is due."""
    keep = _edit(state, "K", "extra", "role || ':' || text") if fits else "NULL"
    give = _edit(state, "R", "3 + extra", f"'{role}:' || text") if role else "NULL"
    return [f"CASE WHEN usable AND initial = '{fits}' THEN {keep} END", f"CASE WHEN usable THEN {give} END"]


_USER = _least(["u", *[_edit(x, "I", "3", "'user:'") for x in ("n", "s", "a")]])
_ASSISTANT = _least(["a", _edit("u", "I", "3", "'assistant:'")])
_NEW = {
    "n": _edit("n", "D", "4"),
    "s": _least([_edit("s", "D", "4"), _row("n", "s", "")[0]]),
    "u": _least([_edit("u", "D", "4"), *[x for state in ("n", "s", "a") for x in _row(state, "u", "user")]]),
    "a": _least([_edit("a", "D", "4"), *_row("u", "a", "assistant")]),
}
_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]))"

STRUCTURE = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
e AS (SELECT key, turn, r, t, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, r, t, copy) AS no FROM e),
g AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY no) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY key ORDER BY no), 1) AS before FROM f),
h AS (SELECT *, NOT blank AND NOT again AS usable, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM g),
z(key, i, n, s, u, a) AS (SELECT DISTINCT key, 0, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}}, {_NONE}, {_NONE}, {_NONE} FROM c
  UNION ALL SELECT key, no, {', '.join(_NEW[x] for x in 'nsua')} FROM (
    SELECT key, i, n, s, u, {_ASSISTANT} AS a FROM (SELECT key, i, n, s, {_USER} AS u, a FROM z)) JOIN h USING (key) WHERE no = i + 1),
y AS (SELECT key, {_least(['n', 'a', _edit('u', 'I', '3', "'assistant:'")])} AS best, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS back FROM z),
m AS (SELECT key, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (usable AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM h GROUP BY key)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM c) JOIN y USING (key) LEFT JOIN m USING (key) WHERE back = 1
"""
