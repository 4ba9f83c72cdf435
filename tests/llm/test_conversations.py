import random

from shelfscope.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string, k string"


def plain(rows):
    key = lambda v: (v is not None, v or 0 if not isinstance(v, str) else 0, v if isinstance(v, str) else "")
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault((conv,) if conv is not None else (None, turn, role, text), []).append((turn, role, text))
    convs = []
    for name, turns in groups.items():
        if name[0] is None:
            turns = turns[:1]
        turns.sort(key=lambda t: (key(t[0]), key(t[1]), key(t[2])))
        convs.append((name[0], [(r, x) for _, r, x in turns]))
    out = []
    for i, (conv, turns) in enumerate(convs):
        longer = any(len(o) > len(turns) and o[:len(turns)] == turns for _, o in convs)
        rank = lambda j: (convs[j][0] is None, convs[j][0] or 0, j)
        equal = any(o == turns and rank(j) < rank(i) for j, (_, o) in enumerate(convs) if j != i)
        if not longer and not equal:
            text = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in turns)
            out.append((conv, len(turns), text))
    return sorted(out, key=str)


def rows():
    rng = random.Random(8)
    out = []
    for i in range(40):
        turns = [(("user", "assistant")[k % 2], f"t{rng.randrange(3)}") for k in range(rng.randint(1, 6))]
        out += [(i, k * 2, r, t) for k, (r, t) in enumerate(turns)]
    base = [("user", "hello é"), ("assistant", "hi " * 20000), ("user", None), ("assistant", "")]
    for i in range(5):
        out += [(100 + i, k, r, t) for k, (r, t) in enumerate(base[:i + 1][:4])]
    out += [(110, 0, "user", "hello é"), (110, 1, "assistant", "hi " * 20000), (110, 2, "user", "")]
    out += [(120, 0, "user", "x"), (120, 0, "user", "x"), (121, 0, "user", "x"), (122, None, None, None), (122, 5, "user", "y")]
    out += [(None, 0, "user", "t0"), (None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, None, None, None)]
    return out


def test_render_equals_plain(spark):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows()], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in c.render(df).collect()), key=str) == plain(rows())
    assert c.render(df.limit(0)).count() == 0


def test_prefix_hashes_tell_order_and_nulls(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "y"), (2, 0, "a", "y"), (2, 1, "a", "x"), (3, 0, None, "x"),
                                (3, 1, "a", "y"), (4, 0, "", "x"), (4, 1, "a", "y")], "conv_id long, turn long, role string, text string")
    ends = [(r.a, r.b) for r in c.prefix_hashes(df).where("last").collect()]
    assert len(set(ends)) == 4
