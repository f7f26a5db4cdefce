import math

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import islands, joins, regions, rules, trajectory


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_merge_contiguous(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 1.0005, 2.0, "b"), (1, 2.5, 3.0, "c")], "k int, start double, end double, text string")
    found = islands.merge_contiguous(df, ["k"], ["start"], "start", "end", "text").orderBy("start")
    assert rows(found, "start", "end", "text") == [(0.0, 2.0, "a b"), (2.5, 3.0, "c")]


def test_bridged_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 12, 15), (1, 35, 50), (1, 100, 120)], "k int, start int, end int")
    found = islands.bridge_intervals(df, ["k"])
    assert sorted(rows(found, "start", "end")) == [(0, 50), (100, 120)]
    assert rows(islands.longest_interval(found, ["k"]), "start", "end") == [(0, 50)]


def density(ref, hyp):
    total = np.zeros(len(ref))
    for n in range(1, 7):
        grams = {tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1)}
        match = np.array([tuple(ref[i : i + n]) in grams for i in range(len(ref) - n + 1)], float)
        smooth = np.convolve(match, np.ones(n + 2) * math.sqrt(math.log(n + 1)) / (n + 2), "same")
        at = (n - 1) // 2
        total[at : at + len(smooth)] += smooth
    return total / 3


def test_density(spark):
    ref = [f"w{i}" for i in range(40)]
    texts = spark.createDataFrame([(1, ref)], "text_id int, words array<string>")
    short = spark.createDataFrame([(7, ref[10:30])], "passage_id int, words array<string>")
    pairs = regions.candidates(texts, short)
    found = {r.pos: r.score for r in regions.density(texts, short, pairs).collect()}
    expected = density(ref, ref[10:30])
    assert all(abs(found.get(i, 0.0) - expected[i]) < 1e-9 for i in range(40))
    assert round(found[9], 3) == 0.451 and round(found[11], 3) == 1.352 and round(found[20], 3) == 2.353
    assert rows(regions.regions(regions.density(texts, short, pairs)), "start", "end") == [(11, 29)]


def test_label_runs(spark):
    frames = spark.createDataFrame([("u", t, x) for t, x in enumerate(["h", "h", "", "i", "SIL", "i"])], "u string, t int, label string")
    assert rows(trajectory.label_runs(frames, ["u"]).orderBy("start"), "label", "start", "end") == [("h", 0, 3), ("i", 3, 4), ("i", 5, 6)]


def walk(spark, steps):
    df = spark.createDataFrame([("u", i, i + 1, label, src, dst) for i, (label, src, dst) in enumerate(steps)], "u string, start int, end int, label string, src int, dst int")
    merged = trajectory.merge_markers(df, ["u"])
    return trajectory.variations(trajectory.states(merged, ["u"]).filter("dst is null"), ["u"]).orderBy("start", F.col("label").isNotNull())


def test_repetition(spark):
    found = walk(spark, [("a", None, None), ("b", None, None), (None, 2, 1), ("b", None, None), ("c", None, None)])
    assert rows(found, "label", "variation") == [("a", "normal"), ("b", "normal"), ("b", "repetition"), ("c", "normal")]


def test_deletion(spark):
    assert rows(walk(spark, [("a", None, None), (None, 1, 3), ("d", None, None)]), "label", "variation") == [("a", "normal"), (None, "deletion"), ("d", "normal")]
    assert rows(walk(spark, [("a", None, None), (None, 1, 2), ("c", None, None)]), "label", "variation") == [("a", "normal"), ("c", "normal")]


def test_greedy_words(spark):
    symbols = ["h", "h", "<blk>", "i", " ", "y", "o", "<blk>", "o"]
    frames = spark.createDataFrame([("u", t, s, 0.5) for t, s in enumerate(symbols)], "u string, t int, label string, prob double")
    assert rows(trajectory.greedy_words(frames, ["u"]).orderBy("word"), "text", "start", "end", "conf") == [("hi", 0.0, 0.08, 0.5), ("yoo", 0.1, 0.16, 0.5)]


def test_contained(spark):
    words = spark.createDataFrame([("f", 0, 100, "she"), ("f", 100, 200, "had"), ("f", 300, 310, "gap")], "f string, start int, end int, w string")
    phones = spark.createDataFrame([("f", 0, 50, "sh"), ("f", 50, 100, "iy"), ("f", 100, 120, "hv"), ("f", 120, 150, "ae"), ("f", 190, 210, "x")], "f string, i_start int, i_end int, p string")
    plain = joins.contained(words, phones, ["f"]).orderBy("start", "i_start")
    assert rows(plain, "w", "p") == [("she", "sh"), ("she", "iy"), ("had", "hv"), ("had", "ae"), ("gap", None)]
    assert rows(joins.contained(words, phones, ["f"], width=64).orderBy("start", "i_start"), "w", "p") == rows(plain, "w", "p")


def test_rules(spark):
    ops = [("t", "V_V", "match", None)] * 10 + [("t", "V_V", "substitution", "dx")] * 5 + [("t", "V_V", "deletion", None)]
    counts = rules.context_counts(spark.createDataFrame(ops, "phone string, ctx string, op string, target string"))
    found = rules.rules(counts).collect()
    assert [(r.target, r.n, r.total, r.rate) for r in found] == [("dx", 5, 16, 0.3125)]


def test_apply_rules(spark):
    words = spark.createDataFrame([("butter", ["B", "AH1", "T", "ER0"])], "word string, pron array<string>")
    found = spark.createDataFrame([("T", "V_V", "D", 0), ("AH", "C_C", None, 0)], "phone string, ctx string, target string, rank int")
    assert [r.pron for r in rules.apply_rules(words, found).orderBy("variant").collect()] == [["B", "AH1", "T", "ER0"], ["B", "T", "ER0"], ["B", "AH1", "D", "ER0"]]


def test_nearest(spark):
    words = spark.createDataFrame([("d", 5, "fox"), ("d", 6, "quikc")], "d string, pos int, word string")
    ref = spark.createDataFrame([("d", 4, "fox"), ("d", 9, "fox"), ("d", 2, "quick")], "d string, ref_pos int, ref_word string")
    assert rows(joins.nearest_in_window(words, ref, ["d"], edits=3).orderBy("pos"), "ref_pos", "distance") == [(9, 0), (2, 2)]


def test_exact_split(spark):
    found = joins.hash_split(spark.range(101).withColumnRenamed("id", "k"), "k")
    assert dict(rows(found.groupBy("split").count(), "split", "count")) == {"train": 90, "val": 5, "test": 6}


def test_annotations(spark):
    saved = spark.createDataFrame([(0, 0, "replace", "a", "b", "asr", False), (0, 1, "replace", "a", "b", None, False), (1, 0, "replace", "a", "b", None, True)], "segment_index int, diff_op_index int, op string, vv_text string, et_text string, classification string, boilerplate boolean")
    assert rows(joins.propagate(saved).orderBy("segment_index", "diff_op_index"), "classification") == [("asr",), ("asr",), (None,)]
    operations = saved.drop("classification", "boilerplate")
    versions = spark.createDataFrame([(0, "replace", "a", "b", "reading", 1), (0, "replace", "a", "b", "dialect", 2)], "segment_index int, op string, vv_text string, et_text string, classification string, saved_at int")
    assert rows(joins.reattach(operations, versions).orderBy("segment_index", "diff_op_index"), "classification") == [("dialect",), (None,), (None,)]


def test_reference_arcs(spark):
    ref = spark.createDataFrame([("u", i, p) for i, p in enumerate("abc")], "u string, pos int, label string")
    similar = spark.createDataFrame([("a", "a", 1.0), ("a", "x", 0.9), ("a", "y", 0.8), ("b", "SIL", 0.99), ("b", "y", 0.5), ("b", "z", 0.1)], "label string, other string, sim double")
    found = {(r.src, r.dst, r.label) for r in trajectory.reference_arcs(ref, similar, ["u"]).collect()}
    assert {(0, 1, "a"), (0, 1, "x"), (1, 2, "y"), (0, 3, "0<trans>3"), (2, 0, "2<trans>0")} <= found
    assert not found & {(0, 1, "y"), (1, 2, "z"), (1, 2, "SIL")}
