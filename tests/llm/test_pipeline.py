"""The pipeline held against plain versions of its stages, each on its own input."""

import public_tokenizers
import pytest
import test_privacy
import test_simhash
import test_tiling

import corpus_pipeline as p
from shelfscope.llm import bpe, toxicity
from shelfscope.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in p.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        found.append((name, docs))
    return found


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_columns(stages):
    documents = stages[0][1].columns
    assert [name for name, _ in stages] == ["documents", "toxicity", "simhash", "decontamination", "pii", "bpe"]
    for _, df in stages[1:-1]:
        assert df.columns == documents
    assert stages[-1][1].columns == [*documents, "token_ids", "n_tokens"]


def test_toxicity(spark, stages):
    report = toxicity.toxicity_report(stages[0][1], spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in report.where("rejected").collect()}
    assert rows_of(stages[1][1]) == [r for r in rows_of(stages[0][1]) if r[0] not in rejected]


def test_near_copies(stages):
    rows = rows_of(stages[1][1])
    names = test_simhash.plain_components([(d, test_simhash.plain_fingerprint(t)) for d, t in rows])
    assert rows_of(stages[2][1]) == [r for r, name in zip(rows, names) if r[0] == name]


def test_leaks(spark, stages):
    items = [test_tiling.tiling.tokens_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(text):
        doc = test_tiling.tiling.tokens_of(text)
        grams = {tuple(doc[i:i + 5]) for i in range(len(doc) - 4)}
        for item in items:
            if sum(tuple(item[i:i + 5]) in grams for i in range(len(item) - 4)) > 0.3 * len(item):
                tiles = test_tiling.plain_tiles(item, doc, 5)
                if sum(k for *_, k in tiles) >= 0.8 * len(item):
                    return True
        return False

    assert rows_of(stages[3][1]) == [r for r in rows_of(stages[2][1]) if not leaked(r[1])]


def test_personal_data(stages):
    rows, want = rows_of(stages[3][1]), []
    for (doc_id, text), (_, _, every) in zip(rows, test_privacy.plain(rows)):
        out, done = "", 0
        for s, _, k, e in every:
            if s >= done:
                out += text[done:s] + f"[{k.upper()}]"
            done = max(done, e)
        want.append((doc_id, text if not every else out + text[done:]))
    assert rows_of(stages[4][1]) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in stages[4][1].collect())


def test_tokens(stages):
    enc = bpe.encoding(bpe.read_ranks(p.RANKS), public_tokenizers.PATTERN)
    assert rows_of(stages[5][1]) == rows_of(stages[4][1])
    for r in stages[5][1].collect():
        assert list(r.token_ids) == enc.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids)


def test_run_equals_the_stages(spark, stages):
    assert rows_of(p.run(spark, SF)) == rows_of(stages[-1][1])


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0, "x"), (1, None, "en", "s", 0, "x"), (None, "a b c", None, None, None, "y"), (2, "", "de", "s", 0, None),
         (3, "long " * 40000, "en", "s", 1, "z"), (3, "long " * 40000, "en", "s", 1, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, leader string")
    empty = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.leader) for r in got) == [("1", "x"), ("3", "z"), ("None", "y")]
    other = tmp_path / "none"
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{other}/{name}.parquet")
    docs.limit(0).write.parquet(f"{other}/documents.parquet")
    assert p.run(spark, str(other)).count() == 0
