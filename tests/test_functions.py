import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import numbers, phones, vectors
from weftline.functions import text as T
from weftline.plans import function_queries


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression("x")).collect()]


def test_normalize_word(spark):
    assert column(spark, ["To-night", "Hallowe'en", "'Tis,", None, ""], T.normalize_word) == ["tonight", "halloween", "tis", None, ""]


def test_normalization_type(spark):
    pairs = spark.createDataFrame([(1, "Cat", "cat"), (2, "Hallowe'en", "halloween"), (3, "cat,", "cat"), (4, "colour", "color")], "i int, r string, h string")
    assert [r[0] for r in pairs.orderBy("i").select(T.normalization_type("r", "h")).collect()] == ["case", "hyphen-apostrophe", "punctuation", "normalization"]


def test_numerals(spark):
    assert column(spark, ["XIV", "iv", "12", "abc", "", None], T.roman_or_decimal) == [14, 4, 12, None, None, None]


def test_labels(spark):
    assert [tuple(r) for r in column(spark, ["12-14: Title", "3. One", "Title"], T.section_numbers)] == [(12, 14), (3, 3), (None, None)]
    assert column(spark, ["Chapter 12b", "No number"], T.trailing_number) == ["12b", None]
    assert column(spark, ["3: Chapter IV. The Sea"], T.label_variants)[0] == ["3: Chapter IV. The Sea", "Chapter IV. The Sea", "The Sea"]
    assert column(spark, ["The “Big” — one!"], T.key_text) == ["the big one"]
    assert column(spark, ["A b/c: d"], T.slug) == ["A_b_c_d"]


def test_splits(spark):
    assert column(spark, ["One. Two!  Three"], T.sentences) == [["One.", "Two!", "Three"]]
    assert column(spark, ["café don't"], T.ocr_tokens) == [["caf", "don't"]]
    assert column(spark, [" Hello, World! "], T.decoder_tokens) == [["hello", "world"]]
    assert column(spark, ["a\r\nb \t c\n\n\n\nd"], T.clean_text) == ["a\nb c\n\nd"]
    grams = column(spark, ["a b c"], lambda x: T.ngrams(F.split(x, " "), 2))
    assert grams == [[["a", "b"], ["b", "c"]]]
    assert column(spark, ["a"], lambda x: T.ngrams(F.split(x, " "), 2)) == [[]]


def test_urls(spark):
    assert column(spark, ["https://x.org/reader/12", "https://x.org/?peopleid=7", "https://x.org"], T.reader_id) == ["12", "7", None]
    assert column(spark, ["https://Ex.org/a/b.mp3?x=1"], T.url_host) == ["ex.org"]
    assert column(spark, ["https://ex.org/a/b.mp3?x=1"], T.url_basename) == ["b.mp3"]
    seconds = spark.createDataFrame([(75.26,)], "s double").select(T.clock("s")).first()[0]
    assert seconds == "1:15.3"


def test_number_words():
    assert numbers.spell(0) == "zero" and numbers.spell(21) == "twenty-one"
    assert numbers.spell(1905) == "one thousand, nine hundred and five"
    assert numbers.normalize_for_matching(None) is None


@given(st.integers(0, numbers.LARGEST))
@settings(max_examples=200)
def test_number_words_are_words(n):
    assert numbers.spell(n).replace("-", "").replace(",", "").replace(" ", "").isalpha()


def test_context(spark):
    rows = spark.createDataFrame([("w", i, p) for i, p in enumerate("b ah t en".split())], "w string, i int, phone string")
    found = {r.phone: r.ctx for r in phones.with_context(rows, ["w"], "i").collect()}
    assert found == {"b": "#_V", "ah": "C_C", "t": "V_#", "en": "C_#"}


def test_phone_mapping(spark):
    assert column(spark, ["ax", "q", "aa", "zz"], lambda x: phones.to_target(F.col(x))) == ["AH", "", "AA", "ZZ"]
    kept = spark.createDataFrame([("dcl",), ("pau",), ("ae",)], "label string").filter(phones.spoken("label")).collect()
    assert [r[0] for r in kept] == ["ae"]
    assert column(spark, ["/x/DR3/y", "/x"], lambda x: phones.dialect(F.col(x))) == ["DR3", None]


def test_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    found = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.unit(F.col("a"))).first()
    assert abs(found[0] - 0.96) < 1e-12 and found[1] is None and found[2] == [0.6, 0.8]


def test_neighbours_are_typed_without_shuffling_pairs(spark):
    lines = ["a A a' 'a a, a- b", "  x", "", "ΑΣ-Β ας-β ΑΣ ασ", "... , '", "It's its, ITS re-do redo redo.", "İ i̇ ß SS ss", None, "word"]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    words = table.withColumn("w", F.split("line", " ")).filter("size(w) > 1")
    pairs = words.select(F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"), "w").select(F.get("w", F.col("i") - 1).alias("a"), F.get("w", "i").alias("b"))
    plain = pairs.groupBy(T.normalization_type("a", "b").alias("type")).count()
    found = function_queries._normalisation_types(table)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in plain.collect()}
    keys = re.findall(r"hashpartitioning\((.*?)#", found._jdf.queryExecution().executedPlan().toString())
    assert set(keys) == {"type"}
