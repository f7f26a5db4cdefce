"""Runs of decoded labels, state trajectories and their classification, as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.islands import number_islands

#: Symbols that are no phonemes.
SPECIALS = ("|", "-", "<pad>", "<s>", "</s>", "<unk>", "SIL", "SPN", "STL", "<blank>", "<b>")


def label_runs(frames: DataFrame, keys: Sequence[str], frame: str = "t", label: str = "label", skip: Sequence[str] = ("",), drop: Sequence[str] = SPECIALS) -> DataFrame:
    """(keys, label, start, end) of runs; frames of `skip` do not close a run, labels of `drop` go afterwards.

    A run ends where the next run starts, the last one after the last frame of all.
    """
    by = Window.partitionBy(*keys).orderBy(frame)
    frames = frames.withColumn("weftline_n", F.max(frame).over(Window.partitionBy(*keys)) + 1)
    real = frames.filter(~F.col(label).isin(*skip))
    marked = number_islands(real, keys, [frame], F.col(label) != F.lag(label).over(by), "run")
    runs = marked.groupBy(*keys, "run").agg(F.first(label).alias("label"), F.min(frame).alias("start"), F.first("weftline_n").alias("n"))
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("run"))
    return runs.withColumn("end", F.coalesce(after, F.col("n"))).drop("n", "run").filter(~F.col("label").isin(*drop))


def merge_markers(steps: DataFrame, keys: Sequence[str], order: str = "start") -> DataFrame:
    """Consecutive transition markers (src, dst not null) become one: first source, last destination, last end."""
    by = Window.partitionBy(*keys).orderBy(order)
    marker = F.col("src").isNotNull()
    marked = number_islands(steps, keys, [order], ~(marker & F.lag(marker).over(by)), "group")
    return marked.groupBy(*keys, "group").agg(
        F.min_by("label", order).alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("src", order).alias("src"), F.max_by("dst", order).alias("dst")
    ).drop("group")


def states(steps: DataFrame, keys: Sequence[str], order: str = "start") -> DataFrame:
    """Adds state: a marker sets it, a phoneme takes it and moves it on by one."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sets = number_islands(steps, keys, [order], F.col("dst").isNotNull(), "leg")
    base = F.coalesce(F.last("dst", ignorenulls=True).over(before), F.lit(0))
    in_leg = Window.partitionBy(*keys, "leg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.sum(F.when(F.col("dst").isNull(), 1).otherwise(0)).over(in_leg), F.lit(0))
    return sets.withColumn("state", F.when(F.col("dst").isNull(), base + past)).drop("leg")


def variations(phonemes: DataFrame, keys: Sequence[str], order: str = "start", expected: str | None = None) -> DataFrame:
    """Adds variation: repetition, insertion, deletion (with a marker row before), substitution or normal.

    A state seen before is a repetition, one below the least so far an
    insertion; one over the end of the state before by more than one follows a deletion.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    seen = F.row_number().over(Window.partitionBy(*keys, "state").orderBy(order)) > 1
    least = F.min("state").over(by.rowsBetween(Window.unboundedPreceding, -1))
    last_end = F.coalesce(F.lag(F.col("state") + 1).over(by), F.lit(-1))
    wrong = F.lit(False) if expected is None else F.col(expected) != F.col("label")
    skipped = F.col("state") > last_end + 1
    kind = F.when(seen, "repetition").when(F.col("state") < least, "insertion").when(wrong, "substitution").otherwise("normal")
    marked = phonemes.withColumn("variation", kind).withColumn("skips", skipped & ~seen & (F.col("state") >= F.coalesce(least, F.col("state")))).withColumn("from_state", last_end)
    real = marked.drop("skips", "from_state")
    gone = marked.filter("skips").withColumn("variation", F.lit("deletion")).withColumn("label", F.lit(None).cast("string"))
    gone = gone.withColumn("end", F.col("start")).withColumn("state", F.greatest("from_state", F.lit(0))).drop("skips", "from_state")
    return real.unionByName(gone)


def in_seconds(segments: DataFrame, shift: float = 0.02) -> DataFrame:
    """start and end as seconds, three decimals."""
    return segments.withColumn("start", F.round(F.col("start") * shift, 3)).withColumn("end", F.round(F.col("end") * shift, 3))


def greedy_words(frames: DataFrame, keys: Sequence[str], blank: str = "<blk>", shift: float = 0.02) -> DataFrame:
    """Words with times and confidence from the best symbol of each frame (keys, t, label, prob).

    Blanks drop, repeats merge only in neighbouring frames, the delimiters |,
    blank and ▁ split words. A word ends at its delimiter's frame, the last word at its last frame.
    """
    by = Window.partitionBy(*keys).orderBy("t")
    kept = frames.filter(F.col("label") != blank)
    fresh = (F.col("label") != F.lag("label").over(by)) | (F.col("t") != F.lag("t").over(by) + 1)
    chars = number_islands(kept, keys, ["t"], fresh, "char").groupBy(*keys, "char").agg(F.first("label").alias("label"), F.min("t").alias("first"), F.max("t").alias("last"), F.min_by("prob", "t").alias("prob"))
    split = F.col("label").isin("|", " ", "▁")
    order = Window.partitionBy(*keys).orderBy("char")
    numbered = chars.withColumn("split", split).withColumn("word", F.sum(split.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ended = numbered.withColumn("next_split", F.first(F.when(F.col("split"), F.col("first")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("char", "label"))), lambda x: x["label"])
    words = ended.filter(~F.col("split")).groupBy(*keys, "word").agg(
        F.array_join(letters, "").alias("text"), F.min("first").alias("first"), F.coalesce(F.max_by("next_split", "char"), F.max("last")).alias("last"), F.avg("prob").alias("conf")
    )
    return words.select(*keys, "word", "text", F.round(F.col("first") * shift, 3).alias("start"), F.round(F.col("last") * shift, 3).alias("end"), F.round("conf", 3).alias("conf"))


def reference_arcs(reference: DataFrame, similar: DataFrame, keys: Sequence[str], beta: float = 5.0, skip: int = 3, back: int = 2) -> DataFrame:
    """(keys, src, dst, label, weight): arcs of the graph that allows skips, returns and similar symbols.

    reference: (keys, pos, label); similar: (label, other, sim), of which the two most similar count, the label itself among them if it is listed.
    """
    import math

    alpha = 1 - 10 ** (-beta)
    eps = 1 - alpha
    right = reference.select(*keys, F.col("pos").alias("src"), (F.col("pos") + 1).alias("dst"), "label", F.lit(-math.log(alpha)).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("sim"), "other"))
    top = similar.withColumn("r", rank).filter("r <= 2 and label <> other").filter(~F.col("other").isin(*SPECIALS))
    swaps = reference.join(top, "label").select(*keys, F.col("pos").alias("src"), (F.col("pos") + 1).alias("dst"), F.col("other").alias("label"), F.lit(-math.log(eps / 10000)).alias("weight"))
    jumps = F.array(*[F.lit(k) for k in (*range(1, skip + 1), *range(-back, 0))])
    ends = reference.groupBy(*keys).agg((F.max("pos") + 1).alias("states"))
    moved = reference.select(*keys, F.col("pos").alias("src"), F.explode(jumps).alias("by")).join(ends, list(keys))
    moved = moved.withColumn("dst", F.col("src") + F.col("by")).filter((F.col("dst") >= 0) & (F.col("dst") <= F.col("states")))
    cost = -F.log(F.lit(eps) * F.exp(-F.col("by") * F.col("by") / 2))
    markers = moved.select(*keys, "src", "dst", F.concat_ws("<trans>", F.col("src").cast("string"), F.col("dst").cast("string")).alias("label"), cost.alias("weight"))
    return right.unionByName(swaps).unionByName(markers)


def symbol_table(spark: SparkSession, symbols: Sequence[str], markers: int = 0) -> DataFrame:
    """(id, symbol): symbols by place, 0 being the blank; then the transition markers between states 0 to `markers`."""
    listed = spark.createDataFrame(list(enumerate(symbols)), "id long, symbol string")
    if not markers:
        return listed
    state = spark.range(markers + 1)
    pairs = state.select(F.col("id").alias("i")).join(state.select(F.col("id").alias("j")), F.col("i") != F.col("j"))
    place = F.col("i") * markers + F.col("j") - F.when(F.col("j") > F.col("i"), 1).otherwise(0)
    return listed.unionByName(pairs.select((place + len(symbols)).alias("id"), F.concat_ws("<trans>", F.col("i").cast("string"), F.col("j").cast("string")).alias("symbol")))


def ctc_topology(spark: SparkSession, tokens: int) -> DataFrame:
    """(src, dst, ilabel, olabel) over states that are the last symbol read: blank 0, and one for each token; a token follows another only after a blank."""
    token = spark.range(1, tokens).select(F.col("id").alias("t"))
    arc = lambda *ends: F.struct(*[F.lit(v).cast("long").alias(n) if isinstance(v, int) else v.alias(n) for n, v in zip(("src", "dst", "ilabel", "olabel"), ends, strict=True)])
    t = F.col("t")
    arcs = token.select(F.inline(F.array(arc(0, t, t, t), arc(t, t, t, t), arc(t, 0, 0, 0))))
    return arcs.unionByName(spark.range(1).select(F.inline(F.array(arc(0, 0, 0, 0)))))
