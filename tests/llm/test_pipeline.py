"""The corpus pipeline: every stage on its own input against brute force, and the registry."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_ngram import shingles
from tests.llm.test_secrets import brute
from tests.llm.test_tokens import TIK, ids
import turnlens.llm.queries  # noqa: F401 - fills the registry
from turnlens.llm.registry import ORACLES, QUERIES
from turnlens.llm.toxicity import held_out, score_documents, train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Input and output of every stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]
    assert all(t.schema == tables[0].schema for t in tables[1:-1])


def test_toxicity(spark, tables):
    model = train(tables[0], spark.read.parquet(f"{SF}/labels.parquet"), ~held_out())
    want = {r["doc_id"] for r in score_documents(tables[0], model).collect() if r["score"] < 0.3}
    assert set(rows(tables[1])) == want and 0 < len(want) < tables[0].count()


def test_near_duplicates(tables):
    before, after = rows(tables[1]), rows(tables[2])
    sets = {i: shingles(r["text"], 5) for i, r in before.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(sets.items(), key=lambda kv: len(kv[1]))
    for k, (i, a) in enumerate(items):
        for j, b in items[k + 1:]:
            if 80 * len(b) > 100 * len(a):
                break
            if a and root(i) != root(j) and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert set(after) == {i for i in sets if root(i) == i}


def test_decontamination(spark, tables):
    before, after = rows(tables[2]), rows(tables[3])
    bench = [set(shingles(r["text"], 5)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, r in before.items():
        own = shingles(r["text"], 5)
        assert (i in after) == (max(len(own & b) / len(b) for b in bench) < 0.8)


def test_secrets(tables):
    before, after = rows(tables[3]), rows(tables[4])
    assert set(before) == set(after)
    assert any(brute(r["text"]) for r in before.values())
    for i, r in after.items():
        assert not brute(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute(before[i]["text"]):
            assert r["text"] == before[i]["text"]


def test_encoding(tables):
    before, after = rows(tables[4]), rows(tables[5])
    assert set(before) == set(after)
    for i, r in after.items():
        assert ids(bytes(r["ids"])) == TIK.encode_ordinary(before[i]["text"]) and r["n_tokens"] == len(r["ids"]) // 4


def test_registry():
    names = sorted(QUERIES, key=lambda k: int(re.match(r"op(\d+)_", k)[1]))
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in names] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_unusual_rows(spark, tables, edge_rows):
    """Null ids and texts, repeated rows and extra columns go through every stage."""
    from tests.llm.conftest import make_docs
    docs = make_docs(spark, edge_rows).selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert new.columns == docs.columns
            docs = spark.createDataFrame(new.collect(), docs.schema)
    got = docs.select("doc_id", "text").collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([1, 2, 3, 4, 5, 7, 8, 10, 11, None, None], key=str)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_rows_are_told_apart_exactly(spark):
    """Ids and texts that swap, null ids and texts, and a table without n_chars."""
    rows = [("5", None), (None, "5"), ("5", None), (None, None), (None, None), ("a:1", "b"), ("a", ":1b"), ("1:a", "b"), ("x", ""), ("x", ""),
            ("y", "one two three four five six seven"), ("y", "one two three four five six seven"), (None, "one two three four five six seven"),
            ("z", "secret = abcdefgh12345")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    keys = docs.select("doc_id", "text", corpus_pipeline.told_apart("doc_id", "text").alias("k")).collect()
    assert len({bytes(r["k"]) for r in keys}) == len({(r["doc_id"], r["text"]) for r in keys})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text"], name
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # texts without words stay in every row; of the seven words one row, the smallest id (nulls first)
    want = [("5", None)] * 2 + [(None, None)] * 2 + [("x", "")] * 2 + [(None, "5"), ("1:a", "b"), ("a", ":1b"), (None, rows[10][1]), ("z", None)]
    assert sorted(((i, None if i == "z" else t) for i, t in got), key=str) == sorted(want, key=str)
    assert corpus_pipeline.byte_bpe(spark, docs, SF).count() == len(want)


def test_n_chars_of_null_texts(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "token: abcdef123456", 99), (3, "plain", 77)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    assert got[1] == (None, 0) and got[3] == ("plain", 77) and got[2][1] == len(got[2][0]) != 99
