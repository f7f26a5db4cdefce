import random

import pytest

#: A small corpus with every awkward case: nulls, empty and one-word texts, copies, near copies, repeats, long texts.
SYLLABLES = "the an er in re th ou st ion ed ha en ti al ng wh ly ble for ing".split()


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        size = rng.randint(5, 15)
        lines.append(" ".join(words[at : at + size]).capitalize() + ".")
        at += size
    return "\n".join(lines)


def near(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) rows."""
    rng = random.Random(7)
    passage = prose(rng, 40)
    texts = [prose(rng, rng.randint(55, 160)) for _ in range(40)]
    texts += [texts[0]] * 6 + [near(rng, texts[1], 2) for _ in range(6)] + [near(rng, texts[2], 9) for _ in range(4)]
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(5)]
    texts += [None, "", " \n\t ", "word", "Word", "two words", "... --- !!!", "é" * 120, "ab" * 300]
    texts += [" ".join(["same"] * 80), "A | b | c | " * 30, "THE!! END!! " * 40, prose(rng, 3000)]
    texts += ["Released under the MIT License. " + prose(rng, 60), "licensed under cc by-nc 4.0 " + texts[3], "Straße ÀÉ Ünï " * 20]
    sources = ["src0", "src0", "src1", "src2", None, "src10", ""]
    rows = [(i * 3, t, "ab"[i % 2] if i % 9 else None, sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns that have names that operators use."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("n_words", "KEPT", "th", "doc", "ranges", "hits", "size", "node", "n", "k", "label", "weftline_doc", "c0")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
