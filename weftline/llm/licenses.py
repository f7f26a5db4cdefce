"""License scans by diagonal voting, in DataFrame operations only.

Every rolling 3-gram of a document's words is hashed and joined to the hashes
of the 3-grams of fixed templates. A match votes for the diagonal (document
position less template position) of its template. Votes are summed by
diagonal, diagonals that differ by at most SLACK are merged, as words put in
or left out shift the rest, and a span is verified if its votes cover enough
distinct template positions. Places of base phrases are found in the same
pass; their labels always stay.

Templates are sentences and whole texts of licenses. Their table is fixed, of
under 1,500 rows, so it is broadcast. Only rows that vote, and one row of each
document, are shuffled, by document.

Edge cases: null and empty texts have no words, places or labels and a score
of 0; very long texts are scanned whole, their words as rows; an empty table
gives an empty result; repeated rows each get their own equal result; rows that
share a doc_id but not the text are kept apart; other columns of the input are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
SLACK = 2
COVERAGE = 0.7

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Template texts, as lower-case words, and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Whole license texts and notices, as lower-case words, and their labels.
WHOLE_TEXTS = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
        "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http "
        "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[str, str]]:
    """(label, text) of single sentences and of whole texts: a part of a license is seen by its sentences."""
    return [*TEMPLATES, *WHOLE_TEXTS]


def words(text: str) -> F.Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _SMALL), _BREAK), "")


def _base_label() -> F.Column:
    found = F.lit(None).cast("string")
    for phrase, label in PHRASES:
        same = F.lit(True)
        for i, word in enumerate(phrase.split()):
            same = same & F.coalesce(F.col(f"g.w{i}") == word, F.lit(False))
        found = F.when(same, label).otherwise(found)
    return found


def _template_grams(docs: DataFrame) -> DataFrame:
    """(hash, template, at, grams, label) of each template position."""
    rows = [(k, at, len(text.split()) - GRAM + 1, label, *text.split()[at : at + GRAM]) for k, (label, text) in enumerate(templates()) for at in range(len(text.split()) - GRAM + 1)]
    table = docs.sparkSession.createDataFrame(rows, "template int, at int, grams int, label string, w0 string, w1 string, w2 string")
    return table.select(F.xxhash64("w0", "w1", "w2").alias("hash"), "template", "at", "grams", F.col("label").alias("of"), *[F.col(f"w{i}").alias(f"t{i}") for i in range(GRAM)])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    split = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), words(text).alias("w"))
    n = F.size("w")
    shifted = [F.slice("w", i + 1, F.greatest(n, F.lit(1))).alias(f"w{i}") for i in range(1, GRAM)]
    zipped = split.select("doc_id", "th", n.alias("n"), F.col("w").alias("w0"), *shifted)
    grams = zipped.select("doc_id", "th", "n", F.posexplode_outer(F.arrays_zip(*[f"w{i}" for i in range(GRAM)])).alias("pos", "g"))
    first_words = sorted({t.split()[i] for _, t in templates() for i in range(len(t.split()) - GRAM + 1)} | {p.split()[0] for p, _ in PHRASES})
    seeds = grams.filter(F.col("pos").isNull() | (F.col("pos") == 0) | F.col("g.w0").isin(first_words)).withColumn("base", _base_label())
    table = F.broadcast(_template_grams(docs))  # a fixed table
    same = F.xxhash64("g.w0", "g.w1", "g.w2") == F.col("hash")
    for i in range(GRAM):
        same = same & (F.col(f"g.w{i}") == F.col(f"t{i}"))
    hits = seeds.join(table, same, "left").filter("pos is null or pos = 0 or base is not null or template is not null")
    rows = hits.select("doc_id", "th", "n", "pos", "base", "template", "of", "grams", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    key = ["doc_id", "th"]
    votes = rows.groupBy(*key, "template", "diagonal").agg(
        F.max("n").alias("n"),
        F.count_if(F.col("pos").isNull() | ((F.col("pos") == 0) & F.col("template").isNull())).alias("alone"),
        F.collect_set(F.when(F.col("base").isNotNull(), F.struct("pos", "base"))).alias("bases"),
        F.first("of").alias("of"),
        F.first("grams").alias("grams"),
        F.collect_set("at").alias("ats"),
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("heads"),
    )
    by = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > SLACK, F.lit(True)).cast("int")
    spans = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*key, "template", "span").agg(
        F.max("n").alias("n"),
        F.max("alone").alias("alone"),
        F.max("heads").alias("heads"),
        F.flatten(F.collect_list("bases")).alias("bases"),
        F.first("of").alias("of"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.first("grams")).alias("coverage"),
    )
    coverage = F.when(F.col("coverage") >= COVERAGE, F.col("coverage"))
    per = merged.groupBy(*key).agg(
        F.max("n").cast("long").alias("n_words"),
        F.max(F.greatest("alone", "heads")).alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("bases"))).alias("bases"),
        F.collect_set(F.when(coverage.isNotNull(), F.col("of"))).alias("found"),
        F.coalesce(F.max(coverage), F.lit(0.0)).alias("best"),
    )
    places, labels = F.col("bases.pos"), F.array_distinct("bases.base")
    out = per.select(
        "doc_id",
        "n_words",
        F.size("bases").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, "found")), ",").alias("labels"),
        F.when(F.size("bases") > 0, 1.0).otherwise(F.least(F.col("best"), F.lit(1.0))).alias("score"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))).alias("copy"),
    )
    return out.drop("copy")
