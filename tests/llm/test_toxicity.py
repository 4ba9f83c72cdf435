import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from shelfscope.llm import toxicity

RUDE, VILE = ["idiot", "clown", "stupid"], ["scum", "vermin", "filth"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, grades = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        grade = rng.choice([0, 0, 0, 1, 2])
        for _ in range(grade and rng.randint(2, 4)):
            text.insert(rng.randrange(len(text)), rng.choice(RUDE if grade == 1 else VILE).upper())
        rows.append((i, " ".join(text)))
        grades.append((i, grade))
    return rows, grades


def test_held_out_grades(spark, make_docs):
    rows, grades = corpus()
    model = toxicity.fit(make_docs(rows), spark.createDataFrame(grades[:400], "doc_id long, grade int"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.score(make_docs(rows[400:]), model).collect()}
    right = sum(got[i].grade == g for i, g in grades[400:])
    assert right / 200 > 0.9
    means = [sum(got[i].expected_severity for i, g in grades[400:] if g == k) / sum(g == k for _, g in grades[400:]) for k in range(3)]
    assert means[0] < 0.3 < means[1] < means[2]


def test_query_form_and_stage(spark, make_docs):
    rows, grades = corpus(300)
    labels = spark.createDataFrame([(i, 0 if g == 2 else 1, int(g > 0)) for i, g in grades] + [(9999, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (1002, "x " * 50000), (0, rows[0][1]), (None, "you scum vermin filth scum idiot")]
    docs = make_docs(rows + extra).withColumnRenamed("lang", "grade").withColumnRenamed("source", "words")
    report = toxicity.toxicity_report(docs, labels)
    assert report.columns == ["doc_id", "expected_severity", "grade", "rejected"]
    got = report.collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.expected_severity <= 2 and r.rejected == (r.grade >= 1) for r in got)
    assert [r.rejected for r in got if r.doc_id is None] == [True]
    assert not any(r.rejected for r in got if r.doc_id in (1000, 1001, 1002))
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.rejected)


def test_every_feature_counts_and_rows_equal_a_plain_score(spark, make_docs):
    # 5,000 words that each stand in many texts; the ones that tell the grades are a few of them
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(5000)]
    rows, grades = [], []
    for i in range(120):
        grade = i % 3
        text = rng.sample(words, 2500) + (RUDE if grade == 1 else VILE if grade == 2 else [])
        rows.append((i, " ".join(text)))
        grades.append((i, grade))
    model = toxicity.fit(make_docs(rows), spark.createDataFrame(grades, "doc_id long, grade int"))
    held = set.intersection(*[toxicity.words_of(t) for _, t in rows[1::3]]) | set.intersection(*[toxicity.words_of(t) for _, t in rows[2::3]])
    assert {*RUDE, *VILE} <= held & set(model.weights) and all(model.weights.values())
    got = {r.doc_id: r for r in toxicity.score(make_docs(rows), model).collect()}
    for i, text in rows:  # the scored rows by their definition
        known = set(re.findall(r"[^\W\d_]+", text.lower()))
        known |= {w[:n] + "-" for w in known for n in (5, 6, 7, 8) if len(w) > n}
        total = sum(c for w, c in model.weights.items() if w in known)
        above = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        assert abs(got[i].expected_severity - sum(above)) < 1e-9
        assert got[i].grade == sum(p >= 0.5 for p in above) == grades[i][1]


def test_no_labels_one_grade_and_no_documents(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.rejected for r in toxicity.toxicity_report(docs, none).collect()] == [False, False]
    all_toxic = spark.createDataFrame([(1, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in toxicity.toxicity_report(docs, all_toxic).collect()] == [1, 1]
    assert toxicity.toxicity_report(docs.limit(0), all_toxic).count() == 0


def test_sample_is_bounded(spark, make_docs):
    rows, grades = corpus(200)
    sample = toxicity._sample(make_docs(rows + rows), spark.createDataFrame(grades + grades, "doc_id long, grade int"), 50)
    assert sample.count() == 50
    assert sample.where(F.size("words") == 0).count() == 0


def test_gradient_and_likelihood():
    rng = np.random.default_rng(3)
    n, width = 800, 6
    x = rng.random((n, width)) < 0.4
    true_w, true_cuts = np.array([2.0, -1.0, 0.5, 0.0, 1.0, -2.0]), np.array([0.5, 2.0])
    latent = x @ true_w + rng.logistic(size=n)
    grades = (latent[:, None] > true_cuts).sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    w, cuts = toxicity.cumulative_link(starts, np.nonzero(x)[1], grades, width, 2)
    assert np.abs(w - true_w).max() < 0.5 and np.abs(cuts - true_cuts).max() < 0.5

    def loss(w, cuts):
        s, edge = x @ w, np.concatenate([[-np.inf], cuts, [np.inf]])
        p = toxicity._sigmoid(edge[grades + 1] - s) - toxicity._sigmoid(edge[grades] - s)
        return -np.log(p).mean() + toxicity.PENALTY * np.abs(w).sum()

    best = loss(w, cuts)
    for k in range(width):
        for d in (-0.05, 0.05):
            assert loss(w + d * (np.arange(width) == k), cuts) > best
    for k in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, cuts + d * (np.arange(2) == k)) > best
