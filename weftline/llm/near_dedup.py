"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set holds its distinct word shingles. Documents of equal sets
form a class, kept as one row. A class has MINIMA minima of its set under
different hashes. Two of them are a coordinate, and each coordinate is a token
(coordinate, value) under which the class is posted. Two classes of similarity
0.8 share about 51 of 64 minima and 20 of 32 tokens; AGREE and MATCHES of them
are asked for, which a pair of that similarity misses with a chance of a few in
a million. Texts of one language share frequent shingles, and so single minima,
the more of them the larger the corpus; two minima at once they hardly share.

Prefix merging: tokens that no other class of a fitting size has are dropped by
one sort, and a class with fewer than MATCHES others cannot have a partner. The
remaining tokens are ordered by rarity, and only the first (count - MATCHES + 1)
are posted: two classes that share MATCHES tokens meet under one of these.

Skip merging: in each posting list, members that are already known to be
connected are skipped. First every list compares its members with one leader,
the member whose tokens are the most frequent, then with a second one from
outside its component. Lists that still hold several components are settled by
differences: since every member was compared with the leader, a pair is linked
only if the shingles in which either differs from the leader overlap by an
amount that both sizes fix (see _by_differences). Members are posted under the
rarest of these, again as a prefix, and meet if what follows in both lists
leaves room for that overlap. Near copies that were edited apart differ from
the leader in places of their own and never meet, so no list is ever expanded
into all pairs of its members, and no link is lost.

Tables that grow with the corpus are joined by merging, whatever their size, so
that a small corpus shows what a large one costs.

Pairs pass if their sizes allow the threshold, if their sketches, one byte of
each minimum, agree in AGREE places, and if their full sets confirm it.

Texts are shuffled only where a row may need it: those whose sets are compared,
and those that may be removed. A bitmap of fixed size, hashed from the keys and
broadcast, picks them during the scan; the exact join follows, so a place that
two keys share costs a row and changes no result.

Edge cases: null texts and texts without words have an empty set and are
linked with nothing; a text of one word has one shingle; repeated rows are in
one class; an empty table gives an empty result; very long texts have as many
tokens as others, and their whole sets are compared; columns of the input other
than the two named are not read, and survivors() returns them as they were.
Nodes are named by their sets, so texts that share an id, or have none, are
told apart; a component is named by its least doc_id, null as the largest, and
of texts with that id one is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.batches import append_columns, fresh, map_texts
from weftline.llm.components import components
from weftline.llm.kernels import NON_SPACE, Prefix, Texts, U, mix, signed
from weftline.llm.repeats import LAST_ID, keyed
from weftline.llm.scratch import Scratch

SHINGLE = 2
MINIMA = 64
#: Minima that the sketches of a pair have to share.
AGREE = 36
#: Coordinates, each of two minima, and how many of them a pair has to share.
COORDINATES = MINIMA // 2
MATCHES = 7
#: Long lists get another leader as long as the last one linked so large a share of what it was compared with.
PAYS = 0.1
#: Posting lists of up to so many members are compared pair by pair.
SMALL = 8
#: Bits of the bitmap that picks texts, 64 in a row of its table.
PICKS = 1 << 24
#: Similarity threshold as (numerator, denominator).
THRESHOLD = (80, 100)

_seeds = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
_FLIPS, _FACTORS = _seeds[:MINIMA], _seeds[MINIMA:] | U(1)
_ID_BITS = 52


def shingle_sets(texts: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, 52-bit hashes, and the bounds of each text among them."""
    starts, ends, of = texts.words(NON_SPACE)
    hashes = texts.word_hashes(starts, ends, fold=True)
    counts = np.bincount(of, minlength=len(texts))
    grams = Prefix(hashes).grams(shingle)
    inside = np.flatnonzero(of[: len(grams)] == of[shingle - 1 :][: len(grams)])
    values, owner = grams[inside], of[inside]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        first = np.searchsorted(of, short)
        values = np.concatenate([values, Prefix(hashes).runs(first, first + counts[short])])
        owner = np.concatenate([owner, short])
    keys = np.sort((owner.astype(np.uint64) << U(_ID_BITS)) | (values >> U(64 - _ID_BITS)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    bounds = np.searchsorted(keys >> U(_ID_BITS), np.arange(len(texts) + 1).astype(np.uint64))
    return keys & U((1 << _ID_BITS) - 1), bounds


def signatures(texts_of: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows with n (set size), fa and fb (the set's name), tokens (one for each coordinate) and sketch (one byte of each minimum)."""

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        members, bounds = shingle_sets(texts, shingle)
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        heads = bounds[full]
        minima = np.zeros((len(full), MINIMA), np.uint64)
        fa, fb = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        if len(full):
            x = mix(members)
            fa[full], fb[full] = np.add.reduceat(x, heads), np.add.reduceat(mix(x ^ _FLIPS[0]), heads)
            for i in range(MINIMA):
                v = (x ^ _FLIPS[i]) * _FACTORS[i]
                v ^= v >> U(31)
                v *= U(0xC4CEB9FE1A85EC53)
                minima[:, i] = mix(np.minimum.reduceat(v, heads) + _FLIPS[i])
        tokens = mix(minima[:, ::2] + mix(minima[:, 1::2]))
        places = np.concatenate([[0], np.cumsum(n > 0)])
        lists = pa.ListArray.from_arrays((COORDINATES * places).astype(np.int32), pa.array(signed(tokens.ravel())))
        sketches = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((MINIMA * places).astype(np.int32)), pa.py_buffer(minima.astype(np.uint8).tobytes())])
        return {"n": n.astype(np.int64), "fa": signed(fa), "fb": signed(fb), "tokens": lists, "sketch": sketches}

    return append_columns(texts_of, "text", kernel, "n long, fa long, fb long, tokens array<long>, sketch binary").drop("text")


def named_by_set() -> F.Column:
    """The node of a class."""
    return F.xxhash64("fa", "fb", "n")


def member_sets(texts_of: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, members): the full set of each text of texts_of(node, text)."""

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        members, bounds = shingle_sets(texts, shingle)
        return {"node": rows.column(rows.schema.get_field_index("node")), "members": pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(signed(members)))}

    return map_texts(texts_of, "text", kernel, "node long, members array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by token and n, the rows whose token another row of a fitting n has too; its first and last row may have one elsewhere."""
    held, follows = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        same = (token[1:] == token[:-1]) & (THRESHOLD[1] * n[:-1].astype(np.int64) >= THRESHOLD[0] * n[1:].astype(np.int64))
        keep = np.concatenate([[follows], same])
        keep[:-1] |= same
        follows, held = bool(keep[-1]), batch.slice(len(token) - 1)
        kept = batch.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
        if kept.num_rows:
            yield kept
    if held is not None:
        yield held


def _pick(doc: str, th: str) -> F.Column:
    """The bit of a key."""
    return F.pmod(F.xxhash64(doc, th), F.lit(PICKS))


def _bitmap(keys: DataFrame) -> DataFrame:
    """(word, bits) of keys(doc, th): which bits they set."""
    at = keys.select(_pick("doc", "th").alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))


def _picked(rows: DataFrame, doc: str, th: str, bitmap: DataFrame, among: bool = True) -> DataFrame:
    """The rows whose key may be among those of the bitmap, or else the rows whose key is not; nothing is shuffled."""
    word, bits = fresh(rows, "weftline_word"), fresh(rows, "weftline_bits")
    at = _pick(doc, th)
    met = rows.join(F.broadcast(bitmap.toDF(word, bits)), F.shiftright(at, 6) == F.col(word), "left")
    may = F.coalesce(F.getbit(bits, at.bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return met.filter(may if among else ~may).drop(word, bits)


def _postings(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """(token, node, n, score): what classes are posted under, after prefix merging.

    score: how often all the tokens of the class occur; in a group of copies
    the original has the highest, as each copy lacks some of its tokens.
    """
    posted = classes.select(F.explode("tokens").alias("token"), "node", F.col("n").cast("int").alias("n"))
    ranked = posted.repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node")
    shared = scratch.write("shared", ranked.mapInArrow(_shared, posted.schema), heavy=True)
    often = scratch.write("often", shared.groupBy("token").agg(F.count("*").cast("int").alias("df")).filter("df > 1"))
    ranked = shared.join(often.hint("merge"), "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    score = F.aggregate("ranked", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    prefix = ranked.filter(F.size("ranked") >= MATCHES).select("node", "n", score.alias("score"), F.explode(F.slice("ranked", 1, F.size("ranked") - F.lit(MATCHES - 1))).alias("x"))
    postings = scratch.write("postings", prefix.select(F.col("x.token").alias("token"), "node", "n", "score"), heavy=True)
    scratch.drop("shared", "often")
    return postings


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, sketch_a, sketch_b) whose sketches agree in AGREE places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((one == other).sum(1) >= AGREE))


class Links:
    """Candidate pairs in, confirmed links and components out."""

    def __init__(self, scratch: Scratch, sketches: DataFrame):
        self.scratch, self.sketches = scratch, sketches
        self.members: DataFrame | None = None
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.table, self.round = "", 0

    def both(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """The pairs with the full sets of both sides."""
        side = lambda name: self.members.select(F.col("node").alias(name), F.col("members").alias(f"members_{name}"))
        return pairs.hint("merge").join(side(a), a).hint("merge").join(side(b), b)

    def alike(self, name: str, pairs: DataFrame) -> tuple[DataFrame, int]:
        """The distinct pairs (a < b, sizes known to fit) whose sketches agree, and how many were compared."""
        side = lambda node: self.sketches.select(F.col("node").alias(node), F.col("sketch").alias(f"sketch_{node}"))
        pairs = self.scratch.write(f"{name}-pairs", pairs.distinct())
        compared = pairs.count()
        met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b")
        found = self.scratch.write(name, met.mapInArrow(_alike, "a long, b long"), heavy=True)
        self.scratch.drop(f"{name}-pairs")
        return found, compared

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are not connected yet."""
        if self.labels is None:
            return pairs
        label = lambda node: self.labels.select(F.col("node").alias(node), F.col("label").alias(f"label_{node}"))
        named = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
        return named.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")

    def confirm(self, alike: DataFrame) -> int:
        """Add the pairs whose full sets reach the threshold; how many."""
        self.round += 1
        shared = F.size(F.array_intersect("members_a", "members_b"))
        union = F.size("members_a") + F.size("members_b") - shared
        links = self.scratch.write(f"links{self.round}", self.both(alike, "a", "b").filter(THRESHOLD[1] * shared >= THRESHOLD[0] * union).select("a", "b"), heavy=True)
        linked = links.count()
        if linked:
            self.links = links if self.links is None else self.links.unionByName(links)
            before = self.table
            self.labels, self.table = components(self.scratch, f"labels{self.round}", self.links)
            if before:
                self.scratch.drop(before)
        return linked


def _fit(a: str, b: str) -> F.Column:
    """Whether two set sizes allow the threshold."""
    return THRESHOLD[1] * F.least(a, b) >= THRESHOLD[0] * F.greatest(a, b)


def _pair(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open_lists(scratch: Scratch, name: str, lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(token, node, n, score, comp) of the posting lists whose members are in more than one component."""
    if labels is None:
        return lists.withColumn("comp", F.col("node"))
    now = scratch.write(f"{name}-all", lists.select("token", "node", "n", "score").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label"))
    split = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    kept = scratch.write(name, now.join(split, "token", "left_semi"), heavy=True)
    scratch.drop(f"{name}-all")
    return kept


def _leader() -> F.Column:
    """The member of a list whose tokens are the most frequent."""
    return F.max(F.struct("score", "node", "comp", "n")).alias("l")


def _with_leader(lists: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs of each list's leader with the members of other components."""
    met = lists.join(leaders, "token").filter((F.col("comp") != F.col("l.comp")) & (F.col("node") != F.col("l.node")) & _fit("n", "l.n"))
    return met.select(*_pair("node", "l.node"))


def _all_pairs(lists: DataFrame) -> DataFrame:
    """All pairs (a, b) of the members of short lists."""
    one, other = lists.alias("p"), lists.alias("q")
    pairs = one.join(other, (F.col("p.token") == F.col("q.token")) & (F.col("p.node") < F.col("q.node")) & _fit("p.n", "q.n"))
    return pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))


def _settle(scratch: Scratch, links: Links, lists: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> None:
    """Confirm all links between members of one list; sets_of gives the full sets of the nodes that can have one."""
    sizes = lists.groupBy("token").agg((F.count("*") <= SMALL).alias("small"))
    sized = scratch.write("sized", lists.join(sizes, "token"), heavy=True)
    scratch.drop("postings")
    long = _open_lists(scratch, "open1", sized.filter("not small").drop("small"), None)
    leaders = scratch.write("leaders1", long.groupBy("token").agg(_leader()))
    first, _ = links.alike("alike1", _with_leader(long, leaders))
    short, _ = links.alike("alike2", _all_pairs(sized.filter("small")))
    nodes = long.select("node")
    for pairs in (first, short):
        nodes = nodes.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links.members = sets_of(scratch.write("live", nodes.distinct()))
    links.confirm(first)
    links.confirm(links.apart(short))
    long = _open_lists(scratch, "open2", long, links.labels)
    if links.labels is not None:
        scratch.drop("sized")
    tried, turn = leaders.select("token", F.col("l.node").alias("node")), 3
    while True:
        now = tried if links.labels is None else tried.join(links.labels, "node", "left").select("token", F.coalesce("label", "node").alias("node"))
        outside = long.join(now.select("token", F.col("node").alias("comp")), ["token", "comp"], "left_anti")
        leaders = scratch.write(f"leaders{turn}", outside.groupBy("token").agg(_leader()))
        alike, compared = links.alike(f"alike{turn}", _with_leader(long, leaders))
        linked = links.confirm(alike)
        long, turn = _open_lists(scratch, f"open{turn}", long, links.labels), turn + 1
        if linked < PAYS * compared or not linked:
            break
        tried = tried.unionByName(leaders.select("token", F.col("l.node").alias("node")))
    links.confirm(links.alike("alike-last", _by_differences(scratch, links, long))[0])


def _by_differences(scratch: Scratch, links: Links, lists: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the open lists: all that can be linked and are not yet connected.

    A member differs from its leader in a set of d shingles. Two members are
    linked if and only if they differ from each other in at most
    (n + n') (y - x) / (y + x) shingles, for a threshold of x / y. They differ
    in d + d' - 2 o, where o is the overlap of both differences; so with
    excess = (y + x) d - (y - x) n, a link needs 2 (y + x) o >= excess + excess'.
    A member's least partner excess thus fixes how long a prefix of its
    differences, rarest first, has to be posted. Where the sum is not positive
    the pair is linked whatever the overlap, and comparing with the member of
    the least excess connects them all.
    """
    num, den = THRESHOLD
    leaders = lists.groupBy("token").agg(_leader())
    met = lists.join(leaders, "token").filter(F.col("node") != F.col("l.node"))
    met = scratch.write("met", met.select(F.col("l.node").alias("leader"), F.col("l.comp").alias("lcomp"), "node", "comp", "n").distinct(), heavy=True)
    apart = F.array_union(F.array_except("members_node", "members_leader"), F.array_except("members_leader", "members_node"))
    apart = links.both(met, "leader", "node").select("leader", "lcomp", "node", "comp", "n", apart.alias("apart"))
    excess = (F.lit(num + den) * F.size("apart") - F.lit(den - num) * F.col("n")).cast("long")
    apart = scratch.write("apart", apart.withColumn("excess", excess), heavy=True)
    least = scratch.write("least", apart.groupBy("leader", "comp").agg(F.min(F.struct("excess", "node")).alias("m")))
    first = least.groupBy("leader").agg(F.min(F.struct("m.excess", "comp", "m.node")).alias("f"))
    second = least.join(first, "leader").filter(F.col("comp") != F.col("f.comp")).groupBy("leader", "f").agg(F.min("m.excess").alias("second"))
    partner = F.when(F.col("comp") == F.col("f.comp"), F.col("second")).otherwise(F.col("f.excess"))
    bounded = apart.join(second, "leader").withColumn("sum", F.col("excess") + partner)
    bounded = scratch.write("bounded", bounded.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("sum") / (2 * (num + den))))), heavy=True)
    sure = bounded.filter((F.col("comp") != F.col("f.comp")) & (F.col("sum") <= 0)).select(*_pair("node", "f.node"))
    columns = ["leader", "lcomp", "node", "comp", "n", "excess", "need"]
    each = bounded.filter(F.size("apart") >= F.col("need")).select(*columns, F.explode("apart").alias("x"))
    often = scratch.write("often", each.groupBy("leader", "x").agg(F.count("*").alias("df")).filter("df > 1"))
    ranked = each.join(often, ["leader", "x"]).groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))
    prefix = F.slice("xs", 1, F.greatest(F.lit(0), F.size("xs") - F.col("need").cast("int") + 1))
    posted = ranked.select("leader", "lcomp", "node", "comp", "n", "excess", F.size("xs").alias("m"), F.posexplode(prefix).alias("at", "x"))
    posted = scratch.write("differences", posted.select("leader", "lcomp", "node", "comp", "n", "excess", (F.col("m") - F.col("at")).alias("rest"), F.col("x.x").alias("x")), heavy=True)
    scratch.drop("met", "apart", "least", "often")
    one, other = posted.filter("comp <> lcomp").alias("p"), posted.alias("q")  # members of the leader's component are connected
    room = 2 * (num + den) * F.least("p.rest", "q.rest") >= F.col("p.excess") + F.col("q.excess")
    same = (F.col("p.leader") == F.col("q.leader")) & (F.col("p.x") == F.col("q.x")) & (F.col("p.comp") != F.col("q.comp"))
    once = (F.col("q.comp") == F.col("q.lcomp")) | (F.col("p.node") < F.col("q.node"))
    return one.join(other, same & once & _fit("p.n", "q.n") & room).select(*_pair("p.node", "q.node")).unionByName(sure)


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows(doc, th, n, fa, fb) of every document; classes(fa, fb, n, node, label, head, head_th), the head being the least document of the component."""
    scratch = Scratch(docs.sparkSession)
    texts = keyed(docs, doc_id, text)
    signed_rows = scratch.write("signatures", signatures(texts))
    rows = scratch.write("rows", signed_rows.select("doc", "th", "n", "fa", "fb"))
    least = F.min(F.struct("doc", "th"))
    classes = signed_rows.filter("n > 0").groupBy("fa", "fb", "n").agg(least.alias("m"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = scratch.write("classes", classes.select("fa", "fb", "n", named_by_set().alias("node"), F.col("m.doc").alias("doc"), F.col("m.th").alias("th"), "tokens", "sketch"), heavy=True)
    scratch.drop("signatures")
    lists = _postings(scratch, classes)
    wanted = scratch.write("wanted", lists.select("node").distinct())
    some = classes.join(wanted.hint("merge"), "node", "left_semi")
    sketches = scratch.write("sketches", some.select("node", "sketch"), heavy=True)
    named = scratch.write("named", classes.select("fa", "fb", "n", "node", "doc", "th"), heavy=True)
    scratch.drop("classes", "wanted")
    links = Links(scratch, sketches)

    def sets_of(nodes: DataFrame) -> DataFrame:
        reps = scratch.write("reps", named.select("node", "doc", "th").join(nodes.hint("merge"), "node", "left_semi"))
        picked = _picked(texts, "doc", "th", scratch.write("reps-bits", _bitmap(reps)))
        found = picked.join(reps.hint("merge"), ["doc", "th"]).dropDuplicates(["doc", "th"]).select("node", "text")
        return scratch.bucketed("members", member_sets(found), "node")

    _settle(scratch, links, lists, sets_of)
    if links.labels is None:
        labelled = named.withColumn("label", F.col("node"))
    else:
        labelled = named.join(links.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = scratch.write("labelled", labelled)
    heads = labelled.groupBy("label").agg(F.min(F.struct("doc", "th")).alias("m")).select("label", F.col("m.doc").alias("head"), F.col("m.th").alias("head_th"))
    headed = scratch.write("headed", labelled.select("fa", "fb", "n", "node", "label").join(heads, "label"))
    scratch.drop_all_but("rows", "headed")
    return rows, headed


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    rows, classes = near_classes(docs, doc_id, text)
    found = rows.join(classes.select("fa", "fb", "n", "head", "head_th"), ["fa", "fb", "n"], "left")
    component = F.coalesce("head", "doc")
    real = lambda c: F.when(c != LAST_ID, c)
    kept = (F.col("doc") == component) & (F.col("th") == F.coalesce("head_th", "th"))
    return found.select(real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"), kept.alias("kept"))


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the least id, and all with an empty set; columns as before."""
    rows, classes = near_classes(docs, doc_id, text)
    scratch = Scratch(docs.sparkSession)
    single = classes.select(F.col("head").alias("doc"), F.col("head_th").alias("th"), F.lit(True).alias("head")).distinct()
    full = rows.filter("n > 0").groupBy("doc", "th").agg((F.count("*") > 1).alias("again"))
    touched = full.join(single.hint("merge"), ["doc", "th"], "left").filter("head is null or again")
    touched = scratch.write("touched", touched.select("doc", "th", F.coalesce("head", F.lit(False)).alias("head")), heavy=True)
    bitmap = scratch.write("touched-bits", _bitmap(touched))
    key, tag, head, place = (fresh(docs, f"weftline_{c}") for c in ("doc", "th", "head", "place"))
    tagged = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))).withColumn(tag, F.xxhash64(text))
    met = _picked(tagged, key, tag, bitmap).join(touched.toDF(key, tag, head).hint("merge"), [key, tag], "left")
    met = met.withColumn(place, F.row_number().over(Window.partitionBy(key, tag).orderBy(head)))
    columns = [f"`{c}`" for c in docs.columns]
    left = met.filter(F.col(head).isNull() | (F.col(head) & (F.col(place) == 1))).select(*columns)
    return _picked(tagged, key, tag, bitmap, among=False).select(*columns).union(left)
