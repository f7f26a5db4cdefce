"""Every query against its SQL twin on the smallest tables; the rest must run and return rows."""

import math

import duckdb
import pandas as pd
import pytest

from weftline.plans import sentence_align, sequences
from weftline.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 6)
    return value if isinstance(value, (int, str, bool)) else plain(value.item()) if hasattr(value, "item") else str(value)


def table(frame):
    return sorted((tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(name, spark, sf_dir, db):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert table(ours) == table(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_flagship_pushes_columns(spark, sf_dir):
    plan = QUERIES["passage_regions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def words(spark, text, **columns):
    return spark.createDataFrame([("f", i, w, *(v[i] for v in columns.values())) for i, w in enumerate(text.split())], "file_id string, pos int, word string" + "".join(f", {k} {'int' if k == 'sent_idx' else 'double'}" for k in columns))


def test_golden_sentences(spark):
    refs = words(spark, "the cat sat on the mat", sent_idx=[0, 0, 0, 1, 1, 1])
    hyps = words(spark, "cat sat down", start=[0.0, 1.0, 2.0], end=[0.5, 1.5, 2.5], conf=[0.9] * 3)
    timed = sentence_align.edits(sentence_align.steps(refs, hyps), refs, hyps)
    assert [r.edit for r in timed.orderBy("step").collect()] == ["cor", "cor", "sub"]
    found = sentence_align.sentences(timed, refs).orderBy("sent_idx").collect()
    assert [(r.asr, r.score) for r in found] == [("cat sat", 1.0), ("down", 0.0)]
    assert [round(r.ref_coverage, 3) for r in found] == [0.667, 0.333]


def test_golden_phrases(spark):
    hyps = words(spark, "librivox dot org now", start=[0.0, 1.0, 2.0, 3.0], end=[0.5, 1.5, 2.5, 3.5], conf=[0.3, 0.6, 0.9, 1.0])
    phrases = spark.createDataFrame([("librivox.org", "librivox dot org")], "ref string, hyp string")
    found = sentence_align.collapse_phrases(hyps, phrases).orderBy("pos").collect()
    assert [(r.word, r.shown, r.start, r.end, round(r.conf, 6), r.fired) for r in found] == [("librivox.org", "librivox dot org", 0.0, 2.5, 0.6, True), ("now", "now", 3.0, 3.5, 1.0, False)]


def test_golden_chunks(spark):
    chunks = spark.createDataFrame([("d", 0, ["a", "b"]), ("d", 1, ["d"])], "doc string, chunk int, words array<string>")
    texts = spark.createDataFrame([("d", "a b c d".split())], "doc string, words array<string>")
    lost = {(r.chunk, r.op) for r in sequences.chunk_ops(chunks, texts, compat=True).collect()}
    kept = {(r.chunk, r.op) for r in sequences.chunk_ops(chunks, texts).collect()}
    assert lost == {(0, "equal"), (1, "equal")} and kept == lost | {(1, "delete")}


def test_decoding(spark):
    peak = lambda k: [6.0 if i == k else -6.0 for i in range(3)]
    frames = spark.createDataFrame([("u", t, peak(k)) for t, k in enumerate([0, 1, 0, 2])], "utt_id string, t int, logits array<double>")
    arcs = spark.createDataFrame([("u", 0, 1, "a", 0.0), ("u", 1, 2, "b", 0.0)], "utt_id string, src int, dst int, label string, weight double")
    found = sequences.decode(frames, arcs, {"<blk>": 0, "a": 1, "b": 2}).orderBy("t").collect()
    assert [r.label for r in found] == ["<blk>", "a", "<blk>", "b"]
    tokens = spark.createDataFrame([("u", [1, 2])], "utt_id string, tokens array<int>")
    assert [(r.token, r.start, r.end) for r in sequences.force_align(frames, tokens).orderBy("place").collect()] == [(1, 0.02, 0.04), (2, 0.06, 0.08)]
