"""Counting edit operations by context, mining rules from the counts, applying rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.phones import TARGET_VOWELS, stress, to_target


def op_counts(ops: DataFrame) -> DataFrame:
    """(op, ref, act, n); matches are counted by ref only."""
    return ops.groupBy("op", "ref", F.when(F.col("op") != "match", F.col("act")).alias("act")).agg(F.count("*").alias("n"))


def context_counts(ops: DataFrame, by: str | None = None) -> DataFrame:
    """(phone, ctx, op, target, n) without insertions; with `by`, also (by, ...) from the same scan.

    The rows over all values of `by` have level `all`, the others level `by`.
    """
    kept = ops.filter("op <> 'insertion'")
    group = ["phone", "ctx", "op", "target"]
    if by is None:
        return kept.groupBy(*group).agg(F.count("*").alias("n"))
    level = F.when(F.grouping(by) == 1, "all").otherwise("by")
    return kept.groupingSets([[F.col(g) for g in group], [F.col(g) for g in (by, *group)]], by, *group).agg(F.count("*").alias("n"), level.alias("level"))


def rules(counts: DataFrame, keys: Sequence[str] = ("phone", "ctx"), min_total: int = 10, min_count: int = 5, min_rate: float = 0.02) -> DataFrame:
    """Transforms (keys, op, target, n, total, rate) frequent enough among all operations of their key."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    rated = counts.withColumn("total", total).withColumn("rate", F.col("n") / F.col("total"))
    return rated.filter((F.col("total") >= min_total) & (F.col("op") != "match") & (F.col("n") >= min_count) & (F.col("rate") >= min_rate))


def display_rates(counts: DataFrame, key: str = "phone") -> DataFrame:
    """Substitution rates over matches and substitutions, deletion rates over all operations."""
    by = Window.partitionBy(key)
    seen = F.sum(F.when(F.col("op").isin("match", "substitution"), F.col("n")).otherwise(0)).over(by)
    every = F.sum("n").over(by)
    return counts.withColumn("rate", F.when(F.col("op") == "substitution", F.col("n") / seen).when(F.col("op") == "deletion", F.col("n") / every))


def top_per_key(df: DataFrame, keys: Sequence[str], k: int, value: str, ties: Sequence[str]) -> DataFrame:
    """The k rows of highest value of each key; ties by the given columns."""
    by = Window.partitionBy(*keys).orderBy(F.desc(value), *ties)
    return df.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def apply_rules(words: DataFrame, found: DataFrame, most: int = 20, contexts: bool = True) -> DataFrame:
    """(word, variant, pron): the base (variant 0) and single-site variants, in order of site and rule, at most `most`.

    words: (word, pron array); found: (phone[, ctx], target, rank), target null for a deletion.
    """
    sites = words.select("word", "pron", F.posexplode("pron").alias("site", "full"))
    base, marks = stress(F.col("full"))

    def side(at: F.Column) -> F.Column:
        plain = F.regexp_replace(F.try_element_at("pron", at), r"\d", "")
        return F.when(plain.isin(TARGET_VOWELS), "V").when(plain.isNotNull(), "C").otherwise("#")

    left = F.when(F.col("site") == 0, "#").otherwise(side(F.greatest(F.col("site"), F.lit(1))))
    sites = sites.withColumn("phone", base).withColumn("marks", marks).withColumn("ctx", F.concat_ws("_", left, side(F.col("site") + 2)))
    met = sites.join(found, ["phone", "ctx"] if contexts else ["phone"])
    new = F.when(F.col("target").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat("target", "marks")))
    tail = F.slice("pron", F.col("site") + 2, F.greatest(F.size("pron"), F.lit(1)))
    variant = F.concat(F.slice("pron", F.lit(1), F.col("site")), new, tail)
    made = met.select("word", variant.alias("pron"), "site", "rank")
    every = words.select("word", "pron", F.lit(-1).alias("site"), F.lit(-1).alias("rank")).unionByName(made)
    once = every.groupBy("word", "pron").agg(F.min(F.struct("site", "rank")).alias("o"))
    return once.withColumn("variant", F.row_number().over(Window.partitionBy("word").orderBy("o", "pron")) - 1).filter(F.col("variant") < most).select("word", "variant", "pron")


def char_inventory(df: DataFrame, text: str) -> DataFrame:
    """(ch, code, class, n) of every character, pre-aggregated before the shuffle."""
    each = df.select(F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''")
    counts = each.groupBy("ch").agg(F.count("*").alias("n"))
    ch = F.col("ch")
    kind = (
        F.when(ch.rlike("[ꝺꝼᵹꝽꝿꞁꞃꞅꞇ]"), "insular")
        .when(ch.rlike("[ḂḃĊċḊḋḞḟĠġṀṁṖṗṠṡṪṫ]"), "dotted")
        .when(ch.rlike("[ÁÉÍÓÚáéíóú]"), "accented")
        .when(ch.rlike("[A-Za-z]"), "letter")
        .when(ch.rlike("[0-9]"), "digit")
        .otherwise("other")
    )
    return counts.select("ch", kind.alias("class"), "n")


#: Syllabic phones whose sources are counted.
SYLLABICS = ("em", "en", "el", "eng", "axr")


def syllabic_patterns(ops: DataFrame, keys: Sequence[str], phones: Sequence[str] = SYLLABICS) -> DataFrame:
    """(phone, pattern, n): the reference phones that a spoken syllabic comes from.

    ops: (keys of one spoken word, idx, op, ref, act). A pattern holds all
    reference phones aligned to an equal phone in the word, and counts once for each time that the phone is spoken.
    """
    spoken = ops.filter(F.col("act").isin(*phones) | ((F.col("op") == "match") & F.col("ref").isin(*phones))).withColumn("phone", F.coalesce("act", "ref"))
    listed = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ref"))), lambda x: x["ref"]), lambda x: x.isNotNull())
    words = spoken.groupBy(*keys, "phone").agg(listed.alias("pattern"), F.count("*").alias("times"))
    return words.filter(F.size("pattern") > 0).groupBy("phone", "pattern").agg(F.sum("times").alias("n"))


def pronunciations(words: DataFrame) -> DataFrame:
    """(word, prons, n): the distinct pronunciations of (word, pron) in order of frequency, with the number of tokens."""
    counts = words.groupBy("word", "pron").agg(F.count("*").alias("c"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "pron"))), lambda x: x["pron"])
    return counts.groupBy("word").agg(ordered.alias("prons"), F.sum("c").alias("n"))


def distinct_counts(ops: DataFrame) -> DataFrame:
    """(op, types, contexts, n): how many different transforms and contexts each operation has."""
    contexts = F.count_distinct("ctx") if "ctx" in ops.columns else F.lit(None).cast("long")
    return ops.filter("op <> 'match'").groupBy("op").agg(F.count_distinct(F.struct("ref", "act")).alias("types"), contexts.alias("contexts"), F.count("*").alias("n"))


def target_rules(found: DataFrame) -> DataFrame:
    """(key, total, target, n, rate): rules (phone, ctx, op, target, n, total, rate) in the target phone set.

    Phones without a target and transforms that become identities drop; of source phones that share a key, the last one's rules stay.
    """
    source, goal = to_target(F.col("phone")), to_target(F.col("target"))
    named = found.select("phone", F.concat_ws("/", source, "ctx").alias("key"), "total", F.when(F.col("op") != "deletion", goal).alias("target"), (F.col("op") == "deletion").alias("gone"), "n", F.round(F.col("rate"), 2).alias("rate"), source.alias("source"))
    kept = named.filter((F.col("source") != "") & (F.col("gone") | ((F.col("target") != "") & (F.col("target") != F.col("source")))))
    last = kept.groupBy("key").agg(F.max("phone").alias("phone"))
    return kept.join(last, ["key", "phone"]).select("key", "total", "target", "n", "rate")


def compared(counts: DataFrame, by: str, min_total: int = 5, most: int = 3, min_rate: float = 0.01) -> DataFrame:
    """The most frequent substitutions of each phone and context, one column for each value of `by`."""
    keys = [by, "phone", "ctx"]
    rated = rules(counts, keys, min_total, 1, min_rate).filter("op = 'substitution'")
    top = top_per_key(rated, keys, most, "n", ["target"])
    return top.groupBy("phone", "ctx", "target").pivot(by).agg(F.round(F.first("rate"), 4))
