import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import markup, sinks, tables, transcripts


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_transcripts(spark, tmp_path):
    write(tmp_path, "a.json", json.dumps({"segments": [{"start": 0, "end": 1, "words": [{"word": " Hi "}, {"word": "you", "start": 0.5, "end": 0.9, "score": 0.3}, {"word": " "}]}]}))
    write(tmp_path, "b.json", json.dumps([{"Start": 0.0, "End": 2.0, "Speaker": 1, "Content": "[Silence] two"}, {"Start": 2.0, "End": 3.0, "Speaker": 1, "Content": ""}]))
    write(tmp_path, "c.json", json.dumps({"chunks": [{"text": " one chunk", "timestamp": [None, 1.5]}, {"text": "two", "timestamp": [2.0, None]}]}))
    files = transcripts.read_files(spark, str(tmp_path))
    found = [tuple(r) for r in transcripts.any_json(files).orderBy("file_id", "pos").collect()]
    assert found == [
        ("a", 0, "Hi", 0.0, 0.0, 1.0),
        ("a", 1, "you", 0.5, 0.9, 0.3),
        ("b", 0, "[Silence]", 0.0, 1.0, 1.0),
        ("b", 1, "two", 1.0, 2.0, 1.0),
        ("c", 0, "one chunk", 0.0, 1.5, 1.0),
        ("c", 1, "two", 2.0, 2.0, 1.0),
    ]
    with pytest.raises(FileNotFoundError):
        transcripts.read_files(spark, str(tmp_path), "*.nothing")


def test_unknown_shape(spark):
    files = spark.createDataFrame([("x", "{}")], "file_id string, json string")
    with pytest.raises(Exception, match="no known transcript shape"):
        transcripts.any_json(files).collect()


def test_line_files(spark, tmp_path):
    rows = lambda name, text: tables.lines(spark, write(tmp_path, name, text))
    assert {tuple(r) for r in tables.reference_tsv(rows("r.tsv", "a\tone\nb\ttwo\na\tthree\nbad\n")).collect()} == {("a", "three"), ("b", "two")}
    assert [tuple(r) for r in tables.kaldi_text(rows("k", "a x y\nb\n")).collect()] == [("a", ["x", "y"])]
    assert sorted((r.id, r.sent_idx, r.sentence) for r in tables.sentences_tsv(rows("s", "a\tone\nb\ttwo\na\tthree\n")).collect()) == [("a", 0, "one"), ("a", 1, "three"), ("b", 0, "two")]
    files = spark.createDataFrame([("f",), ("g",)], "file_id string")
    assert tables.numbered_tsv(rows("n", "01\tone\n02\ttwo\n"), files).count() == 4
    assert [tuple(r)[1:] for r in tables.interval_file(rows("w.WRD", "0 10 she\n10 20\n")).collect()] == [(0, 10, "she")]
    assert [tuple(r) for r in tables.slash_dictionary(rows("d", "; c\nshe /sh iy/\nshe /sh ih/\n")).collect()] == [("she", ["sh", "ih"])]
    lexicon = tables.lexicon_tsv(rows("l", "# c\nto\tt uw\nto\tt ax\n"))
    assert [(r.place, r.pron) for r in lexicon.orderBy("place").collect()] == [(0, ["t", "uw"]), (1, ["t", "ax"])]
    words = spark.createDataFrame([("u", 0, "to"), ("u", 1, "zz"), ("u", 2, "to")], "utt string, pos int, word string")
    prons, missing = tables.lexicon_pronunciation(words, lexicon)
    assert prons.first().pron == ["t", "uw", "t", "uw"] and [r[0] for r in missing.collect()] == ["zz"]
    assert [tuple(r) for r in tables.label_file(rows("lab", "a.png some text\nb.png\n")).orderBy("name").collect()] == [("a.png", "some text", False), ("b.png", None, True)]
    assert [(r.id, r.bad) for r in tables.manifest(rows("m", '{"audio_path": "x"}\nnope\n')).orderBy("id").collect()] == [("utt_000000", False), ("utt_000001", True)]
    assert sorted(r[0] for r in tables.url_list(rows("u", "#no\n #yes\nhttp://x\n")).collect()) == ["#yes", "http://x"]
    assert tables.normalisations(spark, str(tmp_path / "none.tsv")).count() == 0
    assert [tuple(r)[:3] for r in tables.normalisations(spark, write(tmp_path, "n.tsv", "a\tb\nc\td\tcase\n")).orderBy("ref").collect()] == [("a", "b", "normalization"), ("c", "d", "case")]


def test_playlists(spark, tmp_path):
    text = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=900,X=1\nhigh.m3u8\n#EXT-X-STREAM-INF:X=1,BANDWIDTH=100\nlow.m3u8\n"
    master = tables.lines(spark, write(tmp_path, "m.m3u8", text))
    assert tables.variants(master).first().uri == "high.m3u8" and tables.variants(master, compat=True).first().uri == "low.m3u8"
    media = tables.lines(spark, write(tmp_path, "s.m3u8", "#EXT-X-TARGETDURATION:6\na.ts\n\nb.ts\n"))
    assert [(r.uri, r.duration, r.poll_s) for r in tables.segments(media).orderBy("place").collect()] == [("a.ts", 6, 3), ("b.ts", 6, 3)]


def test_config_and_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    path = write(tmp_path, "b.yaml", "title: x\nchapters:\n- chapter: One\n  audio_file: a.mp3\n  text_url: u\n- chapter: Two\n  audio_file: FILL_IN\n")
    ready, missing = tables.book_config(spark, path, {"whisperx_json": "w.json"})
    assert [r.chapter for r in ready.collect()] == ["One"] and [r.chapter for r in missing.collect()] == ["Two"]
    assert tables.rewrite_rules(write(tmp_path, "r.yaml", "rules:\n- {segment: t, replacement: d}\n"))[0].replacement == "d"
    with pytest.raises(ValueError):
        tables.rewrite_rules(write(tmp_path, "q.yaml", "rules:\n- {replacement: d}\n"))


def test_hub_path(spark):
    row = spark.createDataFrame([("hf://me/data/a/b.txt",)], "u string").select(tables.hub_path(F.col("u"))).first()[0]
    assert tuple(row) == ("me", "data", "a/b.txt")


def test_markup(spark):
    html = "<div class='ocr_page'><span class='ocrx_word' id='w1' title='bbox 1 2 3 4; x_wconf 90'>Hi</span><span class='ocr_word' title='bbox 5 6 7 8'> </span></div><div class='ocr_page'><span class='ocr_word' title='bbox 1 1 2 2'><b>you</b></span></div>"
    files = spark.createDataFrame([("f", html)], "file_id string, html string")
    assert [tuple(r) for r in markup.read_ocr(files).collect()] == [("f", 0, 1, "w1", "Hi", 1, 2, 3, 4, 90), ("f", 1, 2, None, "you", 1, 1, 2, 2, None)]
    page = "<title>LibriVox</title><h1>The Book</h1><p class='book-page-author'>A. B.</p><table class='chapter-download'><tr><th>Section</th><th>Chapter</th><th>Reader</th><th>Time</th></tr><tr><td>1</td><td><a href='/c1'>One</a></td><td><a href='/reader/12'>R</a></td><td>0:10</td></tr><tr><td>2</td><td></td></tr></table>"
    found = markup.read_pages(spark.createDataFrame([("p", page, "https://x.org/b")], "file_id string, html string, base string")).first()
    assert (found.title, found.author, found.status) == ("The Book", "A. B.", "ok")
    assert [tuple(c) for c in found.chapters] == [("1", "One", "R", "12", "0:10", None)] and found.links[0].url == "https://x.org/c1"


def test_sinks(spark, tmp_path):
    timed = spark.createDataFrame([("f", 0.0, 0.5, "hi", 0.9, "hi", "cor"), ("f", 0.5, 0.5, None, 1.0, "you", "del")], "file_id string, start double, end double, hyp_word string, conf double, ref_word string, edit string")
    assert [r[0] for r in sinks.edit_lines(timed).collect()] == ["f 1 0.000 0.500 hi 0.90 hi cor", "f 1 0.500 0.000 <eps> 1.00 you del"]
    sinks.write_records(timed, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    mined = spark.createDataFrame([("A", "a", "case"), ("x-y", "xy", "hyphen-apostrophe"), ("k", "n", "normalization")], "ref string, hyp string, type string")
    known = spark.createDataFrame([("k", "n")], "ref string, hyp string")
    assert [r.ref for r in sinks.new_normalisations(mined, known).collect()] == ["x-y"]
    rules = spark.createDataFrame([("t", "V_V", "d", 5, 16, 0.3125), ("t", "V_V", "q", 9, 16, 0.5625)], "phone string, ctx string, target string, n int, total int, rate double")
    assert [tuple(x) for x in sinks.rule_export(rules, ["phone", "ctx"]).first().transforms] == [("q", 9, 56.25), ("d", 5, 31.25)]
    sinks.save_annotations(known, str(tmp_path / "s"))
    assert sinks.latest_annotations(spark.read.parquet(str(tmp_path / "s"))).count() == 1
