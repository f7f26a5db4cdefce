import random

import brute
import pytest

from weftline.llm import near_dedup, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    spark.createDataFrame([(i, 1, 0) for i in ids[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    long = sorted(t for t, in docs.select("text").collect() if t and len(t.split()) > 60)
    spark.createDataFrame([(1, " ".join(long[3].split()[:40]))], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, now = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(folder)).write.parquet(f"{folder}/out{k}")
        now = spark.read.parquet(f"{folder}/out{k}")
        out.append(now)
    return str(folder), out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    _, out = stages
    assert len(corpus_pipeline.STAGES) == 5 and all(x.columns == out[0].columns for x in out[1:5])


def test_quality_stage(stages):
    folder, out = stages
    measured = {r.doc_id: r.kept for r in quality.verdicts(quality.measure(out[0], quality.DEFAULT_WEIGHTS)).collect()}
    assert sorted(i for i, _ in texts(out[1])) == sorted(i for i, k in measured.items() if k)


def test_near_stage(stages):
    _, out = stages
    expected = brute.components(texts(out[1]))
    assert sorted(i for i, _ in texts(out[2])) == sorted(i for i, x in expected.items() if x[2])


def test_near_stage_posts_few_texts_of_frequent_words(spark, monkeypatch):
    rng, posted, made = random.Random(5), [], near_dedup._postings
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 3) for k in range(500)], k=100))) for i in range(800)]
    rows += [(1000 + i, rows[i][1].replace(rows[i][1].split()[50], "other", 1)) for i in range(20)]

    def counted(scratch, classes):
        found = made(scratch, classes)
        posted.append(found.select("node").distinct().count())
        return found

    monkeypatch.setattr(near_dedup, "_postings", counted)
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, x in brute.components(rows).items() if x[2])
    assert 40 <= posted[0] < 120


def test_near_duplicates_shuffle_no_texts_in_vain(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(256):x}" for _ in range(1500))) for i in range(60)]
    rows += [(60, rows[0][1] + " end"), (61, rows[1][1] + " end"), (62, rows[2][1]), (3, rows[3][1]), (None, rows[4][1]), (5, rows[6][1]), (63, None), (63, None), (64, " "), (64, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()
    table.count()

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    left = near_dedup.survivors(table).collect()
    assert sorted((r.doc_id, (r.text or "").strip()) for r in left) == sorted([*rows[:6], *rows[7:60], (5, rows[6][1]), (63, ""), (63, ""), (64, ""), (64, "")])
    assert written() - before < 0.5 * sum(len(t or "") for _, t in rows)


def test_decontamination_stage(spark, stages):
    folder, out = stages
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    expected = brute.contamination(texts(out[2]), items)
    left = sorted(i for i, _ in texts(out[3]))
    assert left == sorted(i for i, x in expected.items() if not x[1]) and len(left) < out[2].count()


def test_mix_and_shards(stages):
    _, out = stages
    before, after = dict(texts(out[3])), texts(out[4])
    assert all(before[i] == t for i, t in after) and max(sum(j == i for j, _ in after) for i in before) <= 3
    assert out[5].count() == len(after) and set(out[5].columns) >= {"doc_id", "shard", "slot"}


def test_run_equals_stages(spark, stages):
    folder, out = stages
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, out[5].collect()))


def test_stages_of_an_empty_table(spark, stages, empty):
    folder, _ = stages
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_stages_keep_other_columns(spark, stages, clashing):
    folder, out = stages
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, clashing, folder)
        assert found.columns == clashing.columns and 0 < found.select("doc_id").distinct().count() <= clashing.count(), k
