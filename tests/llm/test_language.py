import random
import zlib

from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import language

SYLLABLES = {"en": "the th er on an re he in ed nd ha", "de": "der ein sch ung en ch ie und ver ge", "fr": "le eau eux ou qu ai tion ent re",
             "es": "ción el os la ar ue ad ra ll ez", "xx": "zq kw jx vv qq"}


def rows(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80)))
        out.append((i, text, lang))
    return out


def test_held_out_accuracy_and_columns(make_docs):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "the " * 60000, None), (None, "der einung sch", "de"),
           (0, *rows()[0][1:])]
    docs = make_docs(rows() + odd).withColumnRenamed("source", "score").withColumn("class", F.lit(1))
    report = language.language_report(docs, 40)
    assert report.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = report.collect()
    assert len(got) == 306
    truth = {i: lang for i, _, lang in rows()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[1003] == "en" and by[None] == "de"


def test_labels_of_held_out_rows_do_not_matter(make_docs):
    changed = [(i, t, "en" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows(120)]
    a = language.language_report(make_docs(rows(120)), 10).select("doc_id", "lang_pred").collect()
    b = language.language_report(make_docs(changed), 10).select("doc_id", "lang_pred").collect()
    assert sorted(a) == sorted(b)


def test_few_languages_and_empty_table(make_docs):
    docs = make_docs([(i, "some words", "en") for i in range(9)])
    assert {(r.lang_pred, r.score) for r in language.language_report(docs).collect()} == {("en", 1.0)}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_report(none).collect()} == {"und"}
    assert language.language_report(docs.limit(0)).count() == 0


def test_families():
    assert language.family_of("en") == language.family_of("de-AT") == "germanic"
    assert language.family_of("es") == "romance" and language.family_of("tlh") == "tlh"


def test_sample_is_bounded(make_docs):
    sample = language._sample(make_docs(rows(200) + rows(200)), 7)
    counts = [r["count"] for r in sample.groupBy("lang").count().collect()]
    assert len(counts) == 5 and all(c == 7 for c in counts)  # every language, bounded rows


def test_levels_grow_with_the_number_of_languages(monkeypatch):
    names = [f"q{i:03d}" for i in range(700)] + ["en", "de", "fr", "es"]
    root, nodes, machines = language.grouping(names), [], 0
    nodes.append(root)
    for node in nodes:
        assert len(node.members) <= language.WIDTH
        machines += len(node.members) * (len(node.members) - 1) // 2
        nodes += node.members
    assert sorted(root.languages()) == sorted(names)
    assert machines <= language.WIDTH / 2 * len(names) * 1.2


def test_every_language_is_learned_over_nested_levels(make_docs, monkeypatch):
    import random
    monkeypatch.setattr(language, "WIDTH", 3)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzßàéèêöüñçåøæ"
    alphabets = {f"x{i}": letters[2 * i:2 * i + 9] for i in range(11)}
    rows = []
    for i in range(11 * 36):
        lang = f"x{i % 11}"
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(60)), lang))
    found = {r.doc_id: r for r in language.language_report(make_docs(rows)).collect()}
    assert {r.lang_pred for r in found.values()} == set(alphabets)
    right = sum(found[i].lang_pred == lang for i, _, lang in rows if found[i].held_out)
    assert right >= 0.95 * sum(r.held_out for r in found.values())
    model = language.fit(make_docs(rows))
    for i, text, _ in rows[:60]:  # a plain walk of the levels
        x, node = language.features(text), model.root
        while node.members:
            votes = [0] * len(node.members)
            margins = [0.0] * len(node.members)
            for (a, b), w, c in zip(node.level.pairs, node.level.weights, node.level.biases):
                m = float(w @ x + c)
                votes[b if m > 0 else a] += 1
                margins[a] -= m
                margins[b] += m
            node = node.members[max(range(len(votes)), key=lambda k: (votes[k], margins[k]))]
        assert found[i].lang_pred == node.name
