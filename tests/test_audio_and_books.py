import numpy as np

from weftline.kernels import acoustics
from weftline.operators import acoustics as tracks
from weftline.operators import transcript_edits as edits
from weftline.plans import headings


def test_prediction_finds_a_resonance():
    rate, rng, pole = 8000, np.random.default_rng(1), 0.98 * np.exp(2j * np.pi * 1000 / 8000)
    y, noise = np.zeros(2000), rng.normal(size=2000)
    for t in range(2, 2000):
        y[t] = 2 * pole.real * y[t - 1] - abs(pole) ** 2 * y[t - 2] + noise[t]
    a = acoustics.prediction(y[500:], 2)
    assert abs(abs(np.angle(np.roots(a)[0])) * rate / (2 * np.pi) - 1000) < 30
    assert acoustics.nearest_vowel(np.array([300, 2300, 2990])) == "IY"


def test_tracks(spark):
    t = np.arange(3200) / 8000
    rows = [("s", 8000, np.sin(2 * np.pi * 3500 * t).tolist()), ("sh", 8000, np.sin(2 * np.pi * 2700 * t).tolist()), ("quiet", 8000, [0.0] * 3200)]
    signals = spark.createDataFrame(rows, "utt_id string, rate int, samples array<double>")
    found = {(r.utt_id, r["class"]) for r in tracks.fricative_track(signals).collect()}
    assert ("s", "S") in found and ("sh", "SH") in found and ("quiet", None) in found and ("quiet", "S") not in found
    assert tracks.vowel_track(signals).filter("utt_id = 'quiet'").count() == 0


def test_segment_summary(spark):
    frames = spark.createDataFrame([("u", k / 10, 100.0 + k, 1.0 * k, 2.0, 3.0, 60.0) for k in range(5)], "utt_id string, t double, f0 double, f1 double, f2 double, f3 double, intensity double")
    segments = spark.createDataFrame([("u", 0.0, 0.4), ("u", 5.0, 6.0)], "utt_id string, start double, end double")
    first, last = tracks.segment_summary(segments, frames).orderBy("start").collect()
    assert (first.f0_mean, first.f0_range, first.f1) == (101.5, 3.0, 2.0) and last.f0_mean is None
    assert tracks.grid(segments).filter("start = 0").count() == 80


def words(spark):
    return spark.createDataFrame([(0, 0, "hello", 0.0, 1.0, 0.9), (0, 1, "you", 1.0, 2.0, 0.5), (1, 0, "there", 2.0, 3.0, 0.7)], "segment int, pos int, word string, start double, end double, score double")


def test_transcript_edits(spark):
    at = lambda *rows: spark.createDataFrame(rows, "segment int, pos int")
    split = edits.split_words(words(spark), spark.createDataFrame([(0, 0, 2)], "segment int, pos int, at int"))
    assert [tuple(r)[1:5] for r in split.filter("segment = 0").orderBy("pos").collect()] == [(0, "he", 0.0, 0.4), (1, "llo", 0.4, 1.0), (2, "you", 1.0, 2.0)]
    merged = edits.merge_words(words(spark), at((0, 0)))
    assert [tuple(r) for r in merged.filter("segment = 0").collect()] == [(0, 0, "helloyou", 0.0, 2.0, 0.9)]
    cut = edits.split_segments(words(spark), at((0, 1)))
    assert [(r.segment, r.text) for r in edits.rebuild(cut).orderBy("segment").collect()] == [(0, "hello"), (1, "you"), (2, "there")]
    joined = edits.merge_segments(words(spark), spark.createDataFrame([(0,)], "segment int"))
    assert [(r.segment, r.start, r.end, r.text) for r in edits.rebuild(joined).collect()] == [(0, 0.0, 3.0, "hello you there")]


def test_headings(spark):
    links = spark.createDataFrame([("b", 1, "The Sea"), ("b", 5, "12")], "book string, idx int, text string")
    titles = spark.createDataFrame([("b", 0, "Contents"), ("b", 3, "2. The Land"), ("b", 1, "The Sea")], "book string, idx int, text string")
    found = headings.candidates(links, titles)
    assert sorted((r.idx, r.source) for r in found.collect()) == [(1, "toc"), (3, "heading")]
    chapters = spark.createDataFrame([("b", 0, "1: The Sea", None), ("b", 1, "The Land", 2), ("b", 2, "Nowhere at all", None)], "book string, chapter int, label string, number int")
    chosen = headings.choose(headings.scores(chapters, found))
    assert sorted((r.chapter, r.idx) for r in chosen.filter("idx is not null").collect()) == [(0, 1), (1, 3)]
    paragraphs = spark.createDataFrame([("b", k, f"p{k}") for k in range(5)], "book string, idx int, text string")
    assert sorted((r.chapter, r.text) for r in headings.cut(paragraphs, chosen).collect()) == [(0, "p1\n\np2"), (1, "p3\n\np4")]
