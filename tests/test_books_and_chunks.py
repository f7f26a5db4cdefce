import io
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry
from weftline.kernels import ctc
from weftline.kernels.rewrite import Rewrite
from weftline.operators import islands, rules
from weftline.operators import transcript_edits as edits
from weftline.plans import book_pages, chunk_pipeline, extend, sentence_align, sequences
from weftline.sources import markup, media, sinks, tables, transcripts

INDEX = """<html><head><title>LibriVox</title></head><body><h1>A Book</h1><p class="description">A story.<br><strong>Cast</strong><br> The King: <a href="/reader/12">Ann &amp; Bo</a><br>
a name that is far too long to be one of any cast: <a href="/reader/13">No</a><br>Fool : <a href="/reader/14"><b>Cy</b></a></p>
<a href="https://www.gutenberg.org/ebooks/77">Online text</a> <a href="https://www.gutenberg.org/ebooks/77">Read it</a> <a href="https://elsewhere.org/1">Online text</a>
<table class="chapter-download"><tr><td><a href="x/b_01_64kb.mp3">Play 01</a></td><td>The Sea</td><td><a href="/reader/12">Ann</a></td></tr>
<tr><td><a href="https://a.org/b_02.mp3">Play 02-03</a></td><td>Chapter 2: Land</td><td>Bo</td></tr></table></body></html>"""


def test_index_pages(spark):
    files = spark.createDataFrame([("b", INDEX, "https://l.org/b"), ("none", "<p>x", "")], "file_id string, html string, base string")
    pages = markup.read_pages(files)
    assert [(r.url, r.label) for r in book_pages.text_links(pages).collect()] == [("https://www.gutenberg.org/ebooks/77", "Online text")]
    found = {(r.file_id, r.place): tuple(r)[2:] for r in book_pages.chapter_records(pages).collect()}
    url = "https://www.gutenberg.org/ebooks/77"
    assert found["b", 0] == ("01: The Sea", "https://archive.org/x/b_01_64kb.mp3", "b_01_64kb.json", url)
    assert found["b", 1] == ("Chapter 2: Land", "https://a.org/b_02.mp3", "b_02.json", url)
    assert found["none", 0] == ("chapter_1", "FILL_IN.mp3", "FILL_IN.json", "FILL_IN")
    cast = [tuple(r)[2:] for r in book_pages.cast(files).orderBy("place").collect()]
    assert cast == [("The King", "Ann & Bo", "https://l.org/reader/12", "12"), ("Fool", "Cy", "https://l.org/reader/14", "14")]
    assert files.select(book_pages.plain_text(F.lit("a &lt;b&gt; <i>c</i>")).alias("t")).first().t == "a <b> c"


def test_main_texts_by_host(spark):
    pages = [
        ("g", "https://www.gutenberg.org/1", "<body><div id=pg-machine-header>Head</div><p>Text</p><div class=chapter>gone</div></body>"),
        ("w", "https://en.wikisource.org/x", "<body>Menu<div id=mw-content-text>Main <span class=mw-editsection>edit</span></div></body>"),
        ("o", "https://other.org", "<body><nav>Menu</nav><div class=content>Here<script>x</script></div>Foot</body>"),
        ("m", "https://mine.org", "<p>any</p>"),
    ]
    book_pages.add_cleaner("mine.org", str.upper)
    try:
        files = spark.createDataFrame(pages, "file_id string, url string, html string")
        assert {r.file_id: r.text for r in book_pages.main_texts(files).collect()} == {"g": "Text", "w": "Main", "o": "Here", "m": "<P>ANY</P>"}
    finally:
        del book_pages.CLEANERS["mine.org"]


def test_fetching(spark):
    def get(url):
        if "gone" in url:
            raise OSError("not there")
        return (b"plain\r\n\r\n\r\ntext", "text/plain; charset=utf-8") if url.endswith(".txt") else ("<main>caf\xe9</main>".encode("latin-1"), "text/html; charset=iso-8859-1")

    urls = spark.createDataFrame([("http://a/x.txt",), ("http://a/y",), ("http://a/gone",)], "url string")
    found = {r.url: (r.text, r.error) for r in book_pages.fetched_texts(urls, get=get, delay=0.0).collect()}
    assert found == {"http://a/x.txt": ("plain\n\ntext", None), "http://a/y": ("café", None), "http://a/gone": (None, "not there")}


def test_book_html():
    files = {"/d/text/b": ["/d/text/b/1.html", "/d/text/b/77-h.html"]}
    config = {"source_html": "/d/index/b/x.html", "text_source_links": [{"url": "https://g.org/ebooks/77"}]}
    assert book_pages.book_html(config, lambda d: files.get(d, []), lambda p: False) == "/d/text/b/77-h.html"
    assert book_pages.book_html({"text_html": "/t"}, lambda d: [], lambda p: True) == "/t"
    with pytest.raises(FileNotFoundError):
        book_pages.book_html({}, lambda d: [], lambda p: False)


def test_chunks(spark):
    rows = [("f", 0, 10.0, 12.0, "the quick fox", "the quick fox", False, "ngram"), ("f", 1, 12.0, 14.0, "jumped over", "jumps over", False, "fuzzy"), ("f", 2, 14.0, 15.0, "intro", "", True, "none")]
    segments = spark.createDataFrame(rows, "file_id string, chunk int, start double, end double, text string, passage string, is_boilerplate boolean, match_method string")
    assert [r.chunk for r in chunk_pipeline.mismatches(segments).collect()] == [1]
    assert [r.aligner for r in chunk_pipeline.routed(segments).orderBy("chunk").collect()] == ["forced", "forced", "decode"]
    schema = "file_id string, chunk int, pos int, word string, start double, end double, conf double"
    forced = spark.createDataFrame([("f", 0, 0, "the", 0.0, 0.12345, 0.9), ("f", 2, 0, "wrong", 0.0, 1.0, 0.9)], schema)
    decoded = spark.createDataFrame([("f", 2, 0, "intro", 0.5, 0.9, 0.4), ("f", 0, 0, "wrong", 0.0, 1.0, 0.4)], schema)
    words = chunk_pipeline.timed_words(segments, forced, decoded)
    assert sorted((r.chunk, r.word, r.start, r.end) for r in words.collect()) == [(0, "the", 10.0, 10.123), (2, "intro", 14.5, 14.9)]
    found = chunk_pipeline.results(segments, words)
    assert found.count() == 3 and chunk_pipeline.with_words(found).count() == 2 and "match_method" not in found.columns
    spans = spark.createDataFrame([("a  bc a", ["a", "bc", "a"], 1, 3)], "t string, w array<string>, i int, j int").withColumn("s", chunk_pipeline.word_spans("t", "w"))
    got = spans.select(chunk_pipeline.char_span("s", "i", "j", "t").alias("c")).first().c
    assert (got.start, got.end) == (3, 7)


def test_self_alignment(spark):
    best = [0, 1, 1, 0, 2, 0]
    frames = spark.createDataFrame([("u", t, [5.0 if k == b else -5.0 for k in range(3)]) for t, b in enumerate(best)], "utt_id string, t int, logits array<double>")
    assert [(r.token, r.start, r.end) for r in chunk_pipeline.self_align(frames, ["<b>", "a", "b"]).orderBy("place").collect()] == [("a", 0.02, 0.06), ("b", 0.08, 0.1)]


def sentence_tables(spark):
    refs = [("f", k, w, s) for k, (w, s) in enumerate([("The", 0), ("cat", 0), ("sat", 0), ("A", 1), ("colour", 1)])]
    hyps = [("f", k, w, k * 1.0, k + 0.5, 0.9) for k, w in enumerate(["the", "cat", "hat", "a", "color"])]
    second = [("f", k, w, k * 1.0, k + 0.5, 0.9) for k, w in enumerate(["the", "cat", "sat", "a", "x"])]
    schema = "file_id string, pos int, word string, start double, end double, conf double"
    return spark.createDataFrame(refs, "file_id string, pos int, word string, sent_idx int"), spark.createDataFrame(hyps, schema), spark.createDataFrame(second, schema)


def test_sentences_in_one_go(spark):
    refs, hyps, second = sentence_tables(spark)
    known = spark.createDataFrame([("The", "the", "ASR-error"), ("A", "a", "case")], "ref string, hyp string, type string")
    phrases = spark.createDataFrame([("x", "y z")], "ref string, hyp string")
    found = sentence_align.align_files(refs, hyps, second=second, known=known, phrases=phrases, validator="second")
    a, b = found.orderBy("sent_idx").collect()
    assert (a.reference, a.asr, a.start, a.end) == ("The cat sat", "the cat sat", 0.0, 2.5) and a.secondary_validation == "second"
    assert b.asr == "a color" and b.score == 0.5 and b.secondary_validation is None
    assert a.normalisations == [] and [(x.ref, x.type) for x in b.normalisations] == [("A", "case")] and a.new == []
    empty = refs.select(F.lit("g").alias("file_id"), "pos", "word", "sent_idx").unionByName(refs)
    with pytest.raises(Exception, match="no words in the hypothesis of g"):
        sentence_align.align_files(empty, hyps).collect()
    lax = sentence_align.align_files(empty, hyps, strict=False)
    assert {(r.file_id, r.status) for r in lax.collect()} == {("f", "ok"), ("g", "no hypothesis words")} and lax.count() == 4


def test_edit_kinds(spark):
    refs = spark.createDataFrame([("f", k, w, 0) for k, w in enumerate(["a", "b", "zyx"])], "file_id string, pos int, word string, sent_idx int")
    hyps = spark.createDataFrame([("f", 0, "a", 0.0, 1.0, 0.9), ("f", 1, "<eps>", 1.0, 1.5, 0.5), ("f", 2, "<unk>", 1.5, 2.0, 0.4)], "file_id string, pos int, word string, start double, end double, conf double")
    aligned = spark.createDataFrame([("f", 0, 0, 0, "ok"), ("f", 1, 1, 1, "ok"), ("f", 2, 2, 2, "ok"), ("f", 3, None, 1, "ok")], "file_id string, step int, ref_pos int, hyp_pos int, status string")
    vocabulary = spark.createDataFrame([("a",), ("b",)], "word string")
    found = sentence_align.timed_edits(aligned, refs, hyps, oov="<unk>", vocabulary=vocabulary).orderBy("step", "part").collect()
    assert [(r.start, r.duration, r.hyp_word, r.ref_word, r.edit) for r in found] == [
        (0.0, 1.0, "a", "a", "cor"), (1.0, 0.0, "<eps>", "b", "del"), (1.0, 0.5, "<eps>", "<eps>", "sil"), (1.5, 0.5, "<unk>", "zyx", "cor"), (1.0, 0.5, "<eps>", "<eps>", "sil")
    ]


def test_decoding_keeps_the_topology_and_the_best_candidate(spark):
    logits = np.full((3, 3), -5.0)
    for t, k in enumerate([1, 2, 2]):
        logits[t, k] = 5.0
    arcs = [(0, 1, 1, 0.0), (1, 2, 2, 0.0)]
    path, cost = ctc.best_path(ctc.log_softmax(logits), arcs, 2, beam=1e9)
    assert cost > 9 and (1, 0, 1) in path  # a blank has to stand between
    assert ctc.best_path(ctc.log_softmax(logits), arcs, 2, direct=True)[1] < 1
    frames = spark.createDataFrame([("u", t, x.tolist()) for t, x in enumerate(logits)], "utt_id string, t int, logits array<double>")
    graphs = spark.createDataFrame([("u", 0, 0, 1, "a", 0.0), ("u", 1, 0, 1, "b", 0.0)], "utt_id string, candidate int, src int, dst int, label string, weight double")
    labels = [r.label for r in sequences.decode(frames, graphs, {"<b>": 0, "a": 1, "b": 2}).orderBy("place").collect()]
    assert labels == ["<b>", "b", "b"]


def test_utterance_pronunciations(spark):
    words = spark.createDataFrame([("u", 0, "to"), ("u", 1, "zz"), ("u", 2, "at")], "utt string, pos int, word string")
    lexicon = spark.createDataFrame([("to", 0, ["t", "uw"]), ("to", 1, ["t", "ax"]), ("at", 0, ["ae", "t"])], "word string, place int, pron array<string>")
    found = sequences.utterance_pronunciations(words, lexicon, [Rewrite("uw", "ax")]).orderBy("candidate")
    assert [r.pron for r in found.collect()] == [["t", "uw", "ae", "t"], ["t", "ax", "ae", "t"]]
    table = sequences.similarity_table(spark, np.eye(41))
    assert table.count() == 41 * 41 and table.filter("sim = 1").filter("label <> other").count() == 0


def test_pronunciation_rules(spark):
    ops = [("w", 0, "match", "b", "b", "#_V"), ("w", 1, "deletion", "ax", None, "C_C"), ("w", 2, "substitution", "n", "en", "V_#"), ("v", 0, "match", "en", "en", "C_#"), ("v", 1, "insertion", None, "en", "C_#")]
    table = spark.createDataFrame(ops, "word string, idx int, op string, ref string, act string, ctx string")
    assert {(r.phone, tuple(r.pattern), r.n) for r in rules.syllabic_patterns(table, ["word"]).collect()} == {("en", ("n",), 1), ("en", ("en",), 2)}
    assert {(r.op, r.types, r.n) for r in rules.distinct_counts(table).collect()} == {("deletion", 1, 1), ("substitution", 1, 1), ("insertion", 1, 1)}
    words = spark.createDataFrame([("a", ["x"]), ("a", ["y"]), ("a", ["y"])], "word string, pron array<string>")
    assert [(r.prons, r.n) for r in rules.pronunciations(words).collect()] == [([["y"], ["x"]], 3)]
    found = spark.createDataFrame([("t", "V_V", "substitution", "dx", 6, 10, 0.6), ("t", "V_V", "deletion", None, 3, 10, 0.333), ("ix", "C_C", "substitution", "ax", 5, 9, 0.5), ("ih", "C_C", "substitution", "ix", 5, 9, 0.5), ("q", "#_V", "deletion", None, 5, 9, 0.5)], "phone string, ctx string, op string, target string, n int, total int, rate double")
    assert {(r.key, r.target, r.rate) for r in rules.target_rules(found).collect()} == {("T/V_V", "D", 0.6), ("T/V_V", None, 0.33), ("IH/C_C", "AH", 0.5)}
    counts = spark.createDataFrame([("DR1", "t", "V_V", "substitution", "dx", 6), ("DR1", "t", "V_V", "match", None, 6), ("DR2", "t", "V_V", "substitution", "dx", 9), ("DR2", "t", "V_V", "match", None, 1)], "dialect string, phone string, ctx string, op string, target string, n int")
    assert [(r.DR1, r.DR2) for r in rules.compared(counts, "dialect").collect()] == [(0.5, 0.9)]


def test_boxes(spark):
    box = spark.range(1).select(geometry.crop(*[F.lit(v) for v in (1.9, 2.9, 10.2, 5.9)]).alias("c"), geometry.from_bottom(*[F.lit(v) for v in (1.9, 2.9, 10.2, 5.9)], F.lit(100)).alias("b")).first()
    assert tuple(box.c) == (1, 2, 11, 7) and tuple(box.b) == (1, 92, 12, 98)
    words = spark.createDataFrame([("a", 1, 1, 1, 1), (" ", 1, 1, 1, 1), ("b", None, 1, 1, 1)], "word string, left int, top int, width int, height int")
    assert [r.word for r in geometry.words_with_boxes(words).collect()] == ["a"]
    pages = spark.createDataFrame([("d", 0), ("d", 1)], "doc string, page_index int")
    regions = spark.createDataFrame([("d", 1, 0, "old"), ("d", 1, 1, "new")], "doc string, page_index int, place int, rect string")
    assert [tuple(r) for r in geometry.pages_with_regions(pages, regions).collect()] == [("d", 1, "new")]


def test_recordings(spark, tmp_path):
    data = io.BytesIO()
    with wave.open(data, "wb") as file:
        file.setnchannels(2)
        file.setsampwidth(2)
        file.setframerate(8000)
        file.writeframes(struct.pack("<16000h", *[16384, 0] * 8000))
    (tmp_path / "a.wav").write_bytes(data.getvalue())
    files = media.read_media(spark, str(tmp_path), "*.wav")
    segments = files.select("path").withColumn("segment", F.lit(0)).withColumn("start", F.lit(0.25)).withColumn("end", F.lit(0.5))
    cuts = media.cut_segments(segments, files)
    first = cuts.first()
    assert len(first.samples) == 4000 and abs(first.samples[10] - 0.25) < 1e-9
    frames = media.posteriors(cuts, lambda x: np.ones((5, 2)))
    assert frames.count() == 5 and abs(frames.first().shift - 0.05) < 1e-9
    assert media.page_sizes(files, lambda data: [(1, 2)]).count() == 1
    assert media.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a.wav")]).endswith("a.wav")
    rows = spark.createDataFrame([(2, "x"), (1, "y")], "k int, id string")
    assert [r.utt_id for r in media.samples(rows, ["k"], 1).collect()] == ["utt_000000"] and {r.utt_id for r in media.samples(rows, ["k"], utt_id="id").collect()} == {"x", "y"}
    store = media.SparkStore(spark)
    store.write("some text é", f"{tmp_path}/sub/t.txt")
    assert store.read(f"{tmp_path}/sub/t.txt") == "some text é" and "t.txt" in store.listdir(f"{tmp_path}/sub")


def test_hub_and_archive(spark, tmp_path):
    import gzip

    spark.createDataFrame([(1,)], "k int").write.parquet(f"{tmp_path}/me/repo/out")
    assert media.read_hub(spark, "hf://me/repo/out", lambda owner, repo: f"{tmp_path}/{owner}/{repo}").count() == 1
    rows = spark.sql("SELECT 'http://x/1' AS url, CAST('HTTP/1.1 200 OK' AS BINARY) AS payload, TIMESTAMP '2024-01-02 03:04:05' AS fetched_at")
    text = gzip.decompress(bytes(media.warc_records(rows).first().record)).decode()
    assert text.startswith("WARC/1.0") and "WARC-Date: 2024-01-02T03:04:05Z" in text and text.endswith("HTTP/1.1 200 OK\r\n\r\n")


def test_symbols(spark):
    from weftline.operators import trajectory

    found = {r.symbol: r.id for r in trajectory.symbol_table(spark, ["<b>", "a"], 2).collect()}
    assert found["a"] == 1 and sorted(found.values()) == list(range(8)) and "0<trans>2" in found and "1<trans>1" not in found


def test_extension_points(spark):
    texts = spark.createDataFrame([(1, "One. Two! "), (2, "a;b")], "id int, text string")
    extend.add_splitter("semicolon", lambda c: F.split(c, ";"))
    assert [r.sentence for r in extend.split_sentences(texts, "text").orderBy("id", "sent_idx").collect()] == ["One.", "Two!", "a;b"]
    assert extend.split_sentences(texts, "text", "semicolon").filter("id = 2").count() == 2
    mapping = spark.createDataFrame([("iː", "IY")], "label string, other string")
    labels = spark.createDataFrame([("iː",), ("x",)], "label string")
    assert {r.label for r in extend.mapped_labels(labels, "label", mapping).collect()} == {"IY", "x"}
    rows = spark.createDataFrame([("u", {"f": "a.wav"}, "hi")], "utt_id string, file map<string,string>, said string")
    assert extend.with_fields(rows, F.col("file")["f"], "said").first().audio == "a.wav"
    extend.register(spark)
    assert spark.sql("SELECT * FROM edit_ops_table(array('a','b'), array('a'))").count() == 2
    assert spark.sql("SELECT * FROM align_words_table(array('a','b'), array('a','b'))").count() == 2
    assert [tuple(r) for r in spark.sql("SELECT * FROM align_band_table(array(array(0.9D, 0.1D), array(0.1D, 0.8D)))").collect()] == [(0, 0), (1, 1)]
    counted, seen = extend.counted(texts, F.col("id") == 1, "test")
    counted.collect()
    assert seen.get == {"succeeded": 1, "failed": 1}


def test_more_sinks(spark, tmp_path):
    sentences = spark.createDataFrame([("f", 0, "a b", 0.0, 1.0, ["a"])], "file_id string, sent_idx int, reference string, start double, end double, words array<string>")
    assert sinks.legacy_chunks(sentences).columns == ["file_id", "chunk_id", "text", "start", "end", "words"]
    config = spark.createDataFrame([("1", "old", None), ("2", "x", "y")], "chapter string, audio string, aligned string")
    produced = spark.createDataFrame([("1", "aligned", "new.json")], "chapter string, column string, path string")
    assert {tuple(r) for r in sinks.with_paths(config, produced).collect()} == {("1", "old", "new.json"), ("2", "x", "y")}
    pages = lambda *rows: spark.createDataFrame(rows, "page string, v int")
    sinks.write_pages(pages(("p", 1), ("q", 1)), f"{tmp_path}/pages")
    sinks.write_pages(pages(("p", 2), ("r", 2)), f"{tmp_path}/pages")
    assert {(r.page, r.v) for r in spark.read.json(f"{tmp_path}/pages").collect()} == {("p", 1), ("q", 1), ("r", 2)}
    sinks.write_pages(pages(("p", 3)), f"{tmp_path}/pages", overwrite=True)
    assert {(r.page, r.v) for r in spark.read.json(f"{tmp_path}/pages").collect()} == {("p", 3), ("q", 1), ("r", 2)}
    sinks.write_chapters(spark.createDataFrame([("b", "1: The Sea!", "text")], "book string, chapter string, text string"), f"{tmp_path}/chapters")
    assert (tmp_path / "chapters" / "book=b" / "name=1_The_Sea_").exists()
    aligned = spark.createDataFrame([(0, 1, 0, 0, 0), (0, 1, 1, 1, None)], "a int, b int, place int, i int, j int")
    texts = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 0, "z")], "edition int, idx int, sentence string")
    record = sinks.edition_records(aligned, texts, {"who": "me"}).first()
    assert record.meta == {"who": "me"} and [(r.edition_a.sentence, r.edition_b.sentence) for r in record.alignment] == [("x", "z"), ("y", None)]
    words = spark.createDataFrame([("d", 0, "w", "r", 0.12345, 1, 2, 3, 4, 90, "id", 1)], "doc string, pos int, word string, ref_word string, confidence double, x1 int, y1 int, x2 int, y2 int, conf int, word_id string, page int")
    assert sinks.ocr_records(words).first().bbox == [1, 2, 3, 4] and sinks.ocr_table(words).first().confidence == "0.123"
    one = spark.createDataFrame([("u", "a.wav", "t", 16000, 20.0, ["a"], ["b"], [("a", None, 0, 1, 0.0, 0.02, "normal", 0, None)])], sinks.ALIGNMENT)
    sinks.write_alignments(one, f"{tmp_path}/alignments")
    assert sinks.read_alignments(spark, f"{tmp_path}/alignments").collect() == one.collect()
    sinks.write_corrected(sentences, f"{tmp_path}/corrected")
    assert sinks.write_to_hub(sentences, "hf://me/repo/out/x", lambda owner, repo: f"{tmp_path}/{owner}/{repo}") == f"{tmp_path}/me/repo/out/x"


def test_annotation_classes(spark):
    table = lambda *rows: spark.createDataFrame(rows, "op string, classification string, normalised string")
    kept = sinks.checked_annotations(table(("equal", "reading", " x "), ("replace", "dialect", "y"), ("insert", None, None))).collect()
    assert [(r.classification, r.normalised) for r in kept] == [("reading", "x"), ("dialect", None), (None, None)]
    with pytest.raises(Exception, match="not a class"):
        sinks.checked_annotations(table(("equal", "asr", None))).collect()


def test_words_with_line_breaks_inside():
    page = "<div class=ocr_page><span class=ocrx_word title='bbox 1 2 3 4'>foo<br>bar</span> <span class=ocrx_word title='bbox 1 2 3 4'>baz<img/></span></div>"
    assert [w[2] for w in markup.ocr_words(page)] == ["foobar", "baz"]


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.HTM").write_text("<p>x")
    (tmp_path / "b.html").write_text("<p>y")
    assert [r.file_id for r in transcripts.read_html(spark, str(tmp_path)).collect()] == ["b", "a"]
    text = "\r\n".join(f"line {k}" for k in range(5000))
    (tmp_path / "long.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = tables.lines(spark, str(tmp_path / "long.txt"))
        assert rows.select("file").distinct().count() == 1 and {(r.line_no, r.line) for r in rows.collect()} == {(k, f"line {k}") for k in range(5000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    chunks = spark.createDataFrame([("x", '[{"Start": 0.0, "Content": "t"}]')], "file_id string, json string")
    assert transcripts.chunk_rows(chunks).count() == 1
    with pytest.raises(Exception, match="lacks a field"):
        transcripts.chunk_rows(chunks, strict=True).collect()


def test_interval_corpus(spark, tmp_path):
    for name, text in (("a/X.WRD", "0 9 she\n"), ("a/X.PHN", "0 4 sh\n4 9 iy\n"), ("b/y.wrd", "0 3 a\n"), ("b/z.txt", "0 1 no\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    words, phones = tables.interval_corpus(spark, str(tmp_path))
    assert {r.label for r in words.collect()} == {"she", "a"}
    assert {(r.label, p) for r, p in ((r, r.p) for r in words.select("key", "label").join(phones.select("key", F.col("label").alias("p")), "key").collect())} == {("she", "sh"), ("she", "iy")}


def test_many_transcripts(spark):
    rows = [(f, s, 0, f"{f}{s}", 0.0, 1.0, 0.5) for f in "ab" for s in range(3)]
    words = spark.createDataFrame(rows, "file_id string, segment int, pos int, word string, start double, end double, score double")
    merged = edits.merge_segments(words, spark.createDataFrame([("b", 0)], "file_id string, segment int"))
    assert {(r.file_id, r.segment, r.text) for r in edits.rebuild(merged).collect()} == {("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("b", 0, "b0 b1"), ("b", 1, "b2")}


def test_global_index_of_text_keys(spark):
    rows = spark.createDataFrame(pd.DataFrame({"k": ["hot"] * 500 + [f"k{i:03}" for i in range(300)], "v": range(800)})).repartition(7)
    found = islands.global_index(rows, "k").orderBy("index").collect()
    assert [r["index"] for r in found] == list(range(800)) and [r.k for r in found] == sorted(r.k for r in found)


def test_dictionary_table(spark):
    ocr = spark.createDataFrame([("d", ["the", "quikc", "fox"])], "doc string, words array<string>")
    reference = spark.createDataFrame([("d", ["the", "quick", "fox"])], "doc string, words array<string>")
    table = spark.createDataFrame([("The",), ("fox",)], "word string")
    by_table = sequences.align_ocr(ocr, reference, table).orderBy("pos").collect()
    assert by_table == sequences.align_ocr(ocr, reference, frozenset(["the", "fox"])).orderBy("pos").collect()
