"""Sharding by k-d tree partitioning of document metadata.

Documents of equal text form a group, a point with the metadata of its first
document and the bytes of all. The tree starts with all points and all shards.
A node of k shards picks the dimension in which its points spread widest and
splits at the weighted median (for an odd k, at the weight of floor(k/2) of k
shards), found by histograms that Spark aggregates: every round gathers at
most BINS rows a node, and narrows the interval until one value is left. Ties
of that value are split by the hash of the text, so equal texts stay together.
Only a group heavier than HEAVY of a shard enters as single rows, and may be
split where a median falls into it, by the hash of the document; so a group
that holds a third of all rows spreads over as many shards as it needs.

Leaves have near equal bytes. The tree has as many nodes as shards, so it
lives on the driver, and rows find their leaf by a nested CASE expression.

Edge cases: a null text has the size of an empty one and equals it; null
metadata counts as a value of its own; repeated rows are separate members of
their group; very long texts weigh their whole bytes; an empty table gives an
empty result; columns of the input other than the named ones are not used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

SHARDS = 40
OVERHEAD = 16
BINS = 1024
HEAVY = 0.02
#: A tie is cut at its nearer edge, not inside, if it weighs at most this share of a shard.
TOLERANCE = 0.02
SLOT_BLOCKS = 256
DIMENSIONS = ("x0", "x1", "x2", "x3")


@dataclass
class Node:
    """A part of the tree: `shards` leaves from `first` on; the cut sends (dim, tie, row) tuples left."""

    first: int
    shards: int
    weight: float = 0.0
    dim: str = ""
    cut: list[float] = field(default_factory=list)
    through: bool = True
    left: "Node | None" = None
    right: "Node | None" = None


def _unit(column: F.Column) -> F.Column:
    """A hash as a whole number that a double holds exactly."""
    return F.shiftrightunsigned(column, 12).cast("double")


def _goes_left(node: Node) -> F.Column:
    keys = [F.col(node.dim), F.col("tie"), F.col("row")][: len(node.cut)]
    last = keys[-1] <= node.cut[-1] if node.through else keys[-1] < node.cut[-1]
    for key, value in reversed(list(zip(keys[:-1], node.cut[:-1], strict=True))):
        last = (key < value) | ((key == value) & last)
    return last


def _route(node: Node) -> F.Column:
    """The leaf where a point arrives."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(_goes_left(node), _route(node.left)).otherwise(_route(node.right))


def _choose(values: list[tuple[int, str]], default: str = "0D") -> F.Column:
    """CASE over the column node."""
    return F.expr("CASE node " + " ".join(f"WHEN {k} THEN {v}" for k, v in values) + f" ELSE {default} END")


def grow(scratch: Scratch, points: DataFrame, shards: int) -> Node:
    """The tree over points (x0..x3, tie, row, weight). Each level writes the points with their node."""
    root = Node(0, shards)
    ranges = points.agg(F.sum("weight").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"hi_{d}") for d in DIMENSIONS]).first()
    if ranges.w is None:
        return root
    full = {d: (ranges[f"hi_{d}"] - ranges[f"lo_{d}"]) or 1.0 for d in DIMENSIONS}
    leaf = ranges.w / shards
    level, depth = [root], 0
    points = points.withColumn("node", F.lit(0))
    while level := [n for n in level if n.shards > 1]:
        routed = scratch.write(f"depth{depth}", points)
        if depth:
            scratch.drop(f"depth{depth - 1}")
        spread = routed.groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS])
        found = {r.node: r for r in spread.collect()}
        level = [n for n in level if n.first in found]
        for n in level:
            n.weight = float(found[n.first].w)
            n.dim = max(DIMENSIONS, key=lambda d: (found[n.first][d] / full[d], d))
        _cut(routed, level, leaf)
        below = []
        for n in level:
            n.left, n.right = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
            below += [n.left, n.right]
        here = F.col("node")
        for n in level:
            here = F.when(F.col("node") == n.first, F.when(_goes_left(n), n.left.first).otherwise(n.right.first)).otherwise(here)
        points, level, depth = routed.withColumn("node", here), below, depth + 1
    return root


def _cut(routed: DataFrame, level: list[Node], leaf: float) -> None:
    """Find the weighted median of each node of a level, all of them in each round."""
    state = {n.first: {"node": n, "target": n.weight * (n.shards // 2) / n.shards, "before": 0.0, "lo": None, "hi": None} for n in level}
    open_nodes = dict(state)
    while open_nodes:
        stage = {k: ["{dim}", "tie", "row"][len(s["node"].cut)].format(dim=s["node"].dim) for k, s in open_nodes.items()}
        inside = []
        for k, s in open_nodes.items():
            keys = [s["node"].dim, "tie", "row"]
            terms = [f"{x} = {v!r}D" for x, v in zip(keys, s["node"].cut, strict=False)]
            if s["lo"] is not None:
                terms.append(f"{stage[k]} BETWEEN {s['lo']!r}D AND {s['hi']!r}D")
            inside.append((k, " AND ".join(terms) or "true"))
        at = routed.filter(F.col("node").isin(list(open_nodes))).filter(_choose(inside, "false")).withColumn("key", _choose(list(stage.items())))
        unknown = [k for k, s in open_nodes.items() if s["lo"] is None]
        if unknown:
            for r in at.filter(F.col("node").isin(unknown)).groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
                state[r.node]["lo"], state[r.node]["hi"] = r.lo, r.hi
        lo = _choose([(k, f"{s['lo']!r}D") for k, s in open_nodes.items()])
        width = _choose([(k, f"{((s['hi'] - s['lo']) or 1.0)!r}D") for k, s in open_nodes.items()])
        bins = at.filter(F.col("key") >= lo).withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("key") - lo) / width * BINS).cast("int")))
        rows = bins.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("node", "bin").collect()
        per: dict[int, list] = {}
        for r in rows:
            per.setdefault(r.node, []).append(r)
        for k, s in list(open_nodes.items()):
            node, before = s["node"], s["before"]
            for r in per[k]:
                if before + r.w >= s["target"] or r is per[k][-1]:
                    break
                before += r.w
            s["before"] = before
            if r.lo != r.hi:
                s["lo"], s["hi"] = r.lo, r.hi
                continue
            node.cut.append(r.lo)
            if len(node.cut) == 3 or r.w <= TOLERANCE * leaf:
                node.through = before + r.w - s["target"] <= s["target"] - before
                del open_nodes[k]
            else:
                s["lo"] = s["hi"] = None


def manifest(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each document.

    size: bytes of the text and OVERHEAD; slot: its place in the shard, gapless from 0.
    """
    scratch, body = Scratch(docs.sparkSession), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("th"),
        F.pmod(F.xxhash64(F.coalesce(F.col(source), F.lit("")), F.isnull(source)), F.lit(4096)).cast("int").alias("source"),
        F.pmod(F.xxhash64(F.coalesce(F.col(lang), F.lit("")), F.isnull(lang)), F.lit(4096)).cast("int").alias("lang"),
    )
    rows = scratch.write("rows", rows)
    group, total = ["th", "text_crc32", "size"], rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy(*group).agg(F.sum("size").cast("double").alias("weight"), F.min(F.struct("doc_id", "source", "lang")).alias("m"))
    heavy = F.col("weight") > HEAVY * total / shards
    groups = scratch.write(
        "groups",
        groups.select(
            *group,
            F.log2(F.col("size").cast("double")).alias("x0"),
            F.col("m.source").cast("double").alias("x1"),
            F.col("m.lang").cast("double").alias("x2"),
            F.coalesce(F.col("m.doc_id").cast("double"), F.lit(-1.0)).alias("x3"),
            _unit(F.col("th")).alias("tie"),
            "weight",
            heavy.alias("heavy"),
        ),
    )
    in_row = _unit(F.xxhash64("doc_id", F.lit("row")))
    large = F.broadcast(groups.filter("heavy").drop("weight", "heavy"))  # at most shards / HEAVY groups
    single = rows.join(large, group).withColumn("row", in_row).withColumn("weight", F.col("size").cast("double"))
    columns = [*DIMENSIONS, "tie", "row", "weight"]
    points = scratch.write("points", groups.filter("not heavy").withColumn("row", F.lit(0.0)).select(columns).unionByName(single.select(columns)))
    tree = grow(scratch, points, shards)
    placed = rows.join(groups, group).select("doc_id", "size", "text_crc32", "th", *DIMENSIONS, "tie", F.when(F.col("heavy"), in_row).otherwise(0.0).alias("row"))
    member = scratch.write("placed", placed).withColumn("shard", _route(tree).cast("int"))
    block = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SLOT_BLOCKS)).cast("int")
    member = scratch.write("member", member.select("doc_id", "size", "text_crc32", "th", "shard", block.alias("block")))
    scratch.drop_all_but("member")
    counts = member.groupBy("shard", "block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("offset")))  # shards * SLOT_BLOCKS rows
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "th")) - 1
    return member.withColumn("place", place).join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))
