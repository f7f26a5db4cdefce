import random
import re
import zlib
from collections import defaultdict

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, dom, html_text, langid, licenses, mixing, near_dedup, quality, sharding, substring_dedup, suffix_dedup

BENCHMARK = [(1, None), (2, ""), (3, "two words"), (None, "the an er in"), (10, "Licensed under CC BY-NC 4.0 now")]


def texts(corpus):
    return [(r[0], r[1]) for r in corpus]


@pytest.fixture(scope="session")
def benchmark(spark, corpus):
    long = sorted(t for _, t in texts(corpus) if t and len(t.split()) > 60)
    items = [*BENCHMARK, (20, " ".join(long[0].split()[5:30])), (21, " ".join(long[0].split()[10:50])), (22, long[1])]
    return items, spark.createDataFrame(items, "item_id int, text string")


def test_decontamination(docs, corpus, benchmark, empty):
    items, table = benchmark
    expected = brute.contamination(texts(corpus), [(i, t) for i, t in items if i is not None])
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for part_bytes in (decontaminate.PART_BYTES, 300):  # at once, and part by part
        found = decontaminate.verdicts(decontaminate.occurrences(docs, table, part_bytes=part_bytes))
        assert {r.doc_id: tuple(r[c] for c in columns) for r in found.collect()} == expected
    assert decontaminate.verdicts(decontaminate.occurrences(empty, table)).count() == 0
    assert decontaminate.verdicts(decontaminate.occurrences(docs, table.limit(0))).filter("contaminated").count() == 0


def test_word_repeats(docs, clashing, corpus, empty):
    expected = brute.word_repeats(texts(corpus))
    for table in (docs, clashing):
        found = substring_dedup.digests(substring_dedup.remove_repeats(table))
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == expected
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_byte_repeats(docs, corpus, empty):
    found = suffix_dedup.digests(suffix_dedup.remove_repeats(docs))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()} == brute.byte_repeats(texts(corpus))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_ranks_by_prefix_doubling(docs, corpus, empty):
    found = defaultdict(set)
    for r in suffix_dedup.by_ranks(docs).collect():
        found[r.doc].add(r.pos)
    seen, expected = set(), defaultdict(set)
    for i, text in sorted(texts(corpus)):
        data = (text or "").encode()
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                expected[i].add(at)
            seen.add(data[at : at + 100])
    assert found == expected and len(expected) > 5
    assert suffix_dedup.by_ranks(empty).count() == 0


def test_repeats_without_ids(spark):
    """Different texts under one id, or none, are told apart; equal rows keep what only they have."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = words(40)
    rows = [(1, shared + " " + words(30)), (None, words(20) + " " + shared), (None, words(30)), (7, words(30)), (7, shared + " " + words(9)), (None, words(30))] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {bytes(r.kept).decode() for r in substring_dedup.remove_repeats(table).collect()}
    assert kept == {t if i == 1 or shared not in t else t.replace(shared, "").strip() for i, t in rows}
    left = {(r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table).collect()}
    assert len(left) == 6 and (1, rows[0][1].encode()) in left and all(len(k) < 110 for i, k in left if i == 7 and k != rows[3][1].encode())
    assert {k for i, k in left if i is None} >= {rows[2][1].encode(), rows[5][1].encode()}


def test_settling_batch_by_batch():
    from weftline.llm import repeats

    rng = random.Random(3)
    flat = lambda parts: sorted((tuple(r.values()) for b in parts for r in b.to_pylist()), key=str)
    for _ in range(300):
        n = rng.randrange(1, 30)
        rows = sorted((rng.randrange(4), rng.randrange(3), rng.randrange(4), rng.randrange(3), rng.randrange(2)) for _ in range(n))
        columns = [pa.array(c, t) for c, t in zip((*zip(*rows, strict=True), [1] * n, [0] * n), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        whole = pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc", "lo", "th", "n", "off"])
        cuts = [0, *sorted(rng.randrange(n + 1) for _ in range(4)), n]
        for within in (True, False):
            for representatives in (True, False):
                parts = [whole.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]
                assert flat(repeats._settle(iter(parts), within, representatives)) == flat(repeats._settle(iter([whole]), within, representatives))


def test_licenses(docs, corpus, empty):
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in texts(corpus):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert sum("cc-by-nc" in r.labels for r in found.values()) == 1
    twice = licenses.scan(docs.unionByName(docs)).groupBy("doc_id").count().filter("count <> 2").count()
    assert twice == 0 and licenses.scan(empty).count() == 0


def license_labels(text):
    """(labels, best coverage) by the rule of diagonals, template by template."""
    w, found, best = brute.plain_words(text), {x for x in brute.licenses(text)[4].split(",") if x}, 0.0
    for label, template in licenses.templates():
        t = template.split()
        grams, votes = len(t) - 2, defaultdict(set)
        for at in range(grams):
            for pos in range(len(w) - 2):
                if w[pos : pos + 3] == t[at : at + 3]:
                    votes[pos - at].add(at)
        span, last = set(), None
        for diagonal in sorted(votes):
            if last is not None and diagonal - last > licenses.SLACK:
                span = set()
            span, last = span | votes[diagonal], diagonal
            if len(span) / grams >= licenses.COVERAGE:
                found.add(label)
                best = max(best, len(span) / grams)
    return ",".join(sorted(found)), best


def test_license_labels_by_brute_force(spark, clashing):
    rng, rows = random.Random(6), []
    for k, (_, template) in enumerate(licenses.templates()):
        w = template.split()
        rows.append((3 * k, " ".join(rng.choices(["alpha", "beta", "the"], k=9) + w + rng.choices(["gamma", "of"], k=5))))
        for at in sorted(rng.sample(range(len(w)), max(1, len(w) // 12)), reverse=True):
            w[at : at + 1] = rng.choice([[], ["inserted", w[at]], ["changed"]])
        rows.append((3 * k + 1, " ".join(w).upper()))
        rows.append((3 * k + 2, " ".join(w[: len(w) // 2])))
    rows.append((999, " ".join(t for _, t in licenses.templates()) + " mit license"))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    for r in found:
        text = dict(rows)[r.doc_id]
        labels, best = license_labels(text)
        assert r.labels == labels, (r.doc_id, text)
        assert abs(r.score - (1.0 if r.n_base else min(best, 1.0))) < 1e-9
    assert len(found) == len(rows) and sum(r.labels != "" for r in found) >= 40
    assert licenses.scan(clashing).count() == clashing.count()


def test_license_scan_is_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_sharding(spark, docs, corpus, empty):
    found = sharding.manifest(docs, shards=8).collect()
    data = {i: (t or "").encode() for i, t in texts(corpus)}
    weight, slots = defaultdict(int), defaultdict(list)
    for r in found:
        assert r.size == len(data[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(data[r.doc_id])
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(found) == len(data) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.manifest(empty, shards=8).count() == 0
    copies = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a hot text").otherwise(F.md5(F.col("id").cast("string"))).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"))
    sizes = [r["sum(size)"] for r in sharding.manifest(copies, shards=10).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 10 and max(sizes) <= 1.03 * min(sizes)


def split_by_force(points, first, shards, full, leaf, out):
    """The k-d tree by its rule: cut the widest dimension at the weighted median, ties by hash, then by row."""
    if shards == 1:
        out.update((p["id"], first) for p in points)
        return
    spread = lambda d: (max(p[d] for p in points) - min(p[d] for p in points)) / full[d]
    dim = max(sharding.DIMENSIONS, key=lambda d: (spread(d), d))
    target, before, inside, fixed = sum(p["weight"] for p in points) * (shards // 2) / shards, 0.0, points, []
    for key in (dim, "tie", "row"):
        values = sorted({p[key] for p in inside})
        for v in values:
            weight = sum(p["weight"] for p in inside if p[key] == v)
            if before + weight >= target or v == values[-1]:
                break
            before += weight
        fixed.append((key, v))
        inside = [p for p in inside if p[key] == v]
        if weight <= sharding.TOLERANCE * leaf:
            break
    through = before + weight - target <= target - before
    place, cut = (lambda p: tuple(p[k] for k, _ in fixed)), tuple(v for _, v in fixed)
    left = [p for p in points if place(p) < cut or (through and place(p) == cut)]
    split_by_force(left, first, shards // 2, full, leaf, out)
    split_by_force([p for p in points if p not in left], first + shards // 2, shards - shards // 2, full, leaf, out)


def test_tree_by_brute_force(spark):
    from weftline.llm.scratch import Scratch

    rng = random.Random(12)
    points = [{"id": i, "x0": float(rng.randrange(40)), "x1": float(rng.choice([0, 0, 0, 7, 9])), "x2": rng.random(), "x3": float(i), "tie": float(rng.randrange(50)), "row": float(i % 3), "weight": float(rng.randint(1, 90))} for i in range(400)]
    points += [{**points[0], "id": 1000 + k, "row": float(k), "weight": 400.0} for k in range(30)]
    table = spark.createDataFrame(points, "id int, x0 double, x1 double, x2 double, x3 double, tie double, row double, weight double")
    full = {d: max(p[d] for p in points) - min(p[d] for p in points) for d in sharding.DIMENSIONS}
    for shards in (2, 7):
        tree = sharding.grow(Scratch(spark), table, shards)
        found = {r.id: r.shard for r in table.select("id", sharding._route(tree).alias("shard")).collect()}
        expected = {}
        split_by_force(points, 0, shards, full, sum(p["weight"] for p in points) / shards, expected)
        assert found == expected and len(set(found.values())) == shards


def test_very_long_texts_and_other_columns(spark, clashing):
    """Texts of 200,000 words, and columns named like results, through the operators that map texts."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", str(rng.randrange(10**6))]) for _ in range(200_000))
    table = spark.createDataFrame([(1, long, "en", "s"), (2, long[:900_000], "en", "s"), (3, "short text here", "en", "s")], "doc_id long, text string, lang string, source string")
    benchmark = spark.createDataFrame([(1, " ".join(long.split()[150_000:150_020]))], "item_id int, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.verdicts(decontaminate.occurrences(table, benchmark)).collect()}
    assert hits[1] == (200_000, 20) and hits[3] == (3, 0)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.digests(substring_dedup.remove_repeats(table)).collect()}
    assert removed[1] == removed[3] == 0 and removed[2] >= len(long[:900_000].split()) - 1
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.digests(suffix_dedup.remove_repeats(table)).collect()}
    assert cut[2] == 900_000 and cut[3] == 0
    assert near_dedup.verdicts(table).filter("kept").count() == 3 - (900_000 / len(long) > 0.85)
    assert mixing.report(table).filter("size = 200000").count() == 1 and sharding.manifest(table, shards=2).count() == 3
    assert licenses.scan(table).filter("n_words = 200000").count() == 1
    assert quality.measure(table, quality.DEFAULT_WEIGHTS).filter("n_words = 200000").count() == 1
    n = clashing.count()
    assert quality.measure(clashing, quality.DEFAULT_WEIGHTS).count() == n and sharding.manifest(clashing, shards=4).count() == n
    assert decontaminate.occurrences(clashing, benchmark).count() == n and langid.predict(clashing, langid.learn(clashing)).count() == n
    assert suffix_dedup.remove_repeats(clashing).count() == n


def test_mixing(docs, clashing, corpus, empty):
    size, by = {i: len(brute.words(t)) for i, t in texts(corpus)}, defaultdict(int)
    source = {r[0]: r[3] for r in corpus}
    for i, n in size.items():
        by[source[i]] += n
    goal, taken = brute.targets(by), defaultdict(int)
    found = mixing.report(docs).collect()
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == by[source[r.doc_id]] and abs(r.target - goal[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[source[r.doc_id]] += r.taken
    for s, target in goal.items():
        assert abs(taken[s] - target) <= max(size[i] for i in size if source[i] == s)
    assert sorted(map(tuple, mixing.report(docs).collect())) == sorted(map(tuple, found))
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixing.mix(empty).count() == 0
    drawn = defaultdict(int)
    for r in mixed.select("doc_id").collect():
        drawn[r.doc_id] += 1
    assert all(drawn[i] <= 3 for i in size)


def test_pivotal_steps_keep_expected_copies():
    sizes, p, runs = [100, 90, 80, 70, 60, 50, 40, 30, 20, 10], 0.3, 4000
    rng, up = random.Random(5), [0] * len(sizes)
    for _ in range(runs):
        keys = [rng.getrandbits(63) for _ in sizes]
        batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(["s"] * 10), pa.array(sizes, pa.float64()), pa.array([p] * 10), pa.array([0] * 10)], names=["k", "skey", "size", "p", "block"])
        taken = {k: x for out in mixing._round(iter([batch]), True) for k, x in zip(out["k"].to_pylist(), out["extra"].to_pylist(), strict=True)}
        assert len(taken) == 10 and abs(sum(s * taken[k] for s, k in zip(sizes, keys, strict=True)) - p * sum(sizes)) < 100
        for i, k in enumerate(keys):
            up[i] += taken[k]
    error = 4 * (p * (1 - p) / runs) ** 0.5
    assert all(abs(n / runs - p) < error for n in up), [n / runs for n in up]


def test_mixing_with_odd_columns(spark):
    rows = [(i, f"some words here {i}", "a", {"k": str(i)}, 1) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,string>, weftline_copies int")
    assert mixing.mix(table).columns == table.columns and mixing.mix(table).count() == 30


def test_langid(docs, corpus, empty):
    model = langid.learn(docs)
    found = {r.doc_id: r for r in langid.predict(docs.drop("lang"), model).collect()}
    for i, text in texts(corpus):
        has_letter = any(c.isalpha() for c in text or "")
        assert (found[i].lang_pred in ("a", "b")) == has_letter and 0 <= found[i].score <= 1
        assert has_letter or found[i].lang_pred == "und"
    assert all(r.lang_pred == "und" for r in langid.predict(docs, langid.learn(empty)).collect())


def test_langid_learns(spark):
    rows = [(i, " ".join([("haus und baum", "house and tree")[i % 2]] * 5), ("de", "en")[i % 2]) for i in range(60)] + [(99, "bäume und häuser", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(table, langid.learn(table)).filter(langid.held_out("doc_id"))
    assert found.count() > 5 and found.filter("lang <> lang_pred").count() == 0


def score_by_force(text, names, counts):
    """Log probabilities of the languages by the definition: words first, then shorter and shorter n-grams."""
    import math

    words = re.findall(r"[^\W\d_]+", text.lower())
    total = [0.0] * len(names)
    vocabulary = [sum(c[k] for c in counts.values()) for k in range(len(names))]
    grams = {}
    for size in (1, 2, 3, 4):
        table = defaultdict(lambda: [0] * len(names))
        for w, c in counts.items():
            for g in langid.Model.split(w, size):
                table[g] = [a + b for a, b in zip(table[g], c, strict=True)]
        grams[size] = table
    for w in words:
        for k in range(len(names)):
            if w in counts:
                total[k] += math.log((counts[w][k] + 0.1) / (vocabulary[k] + 0.1 * len(counts)))
                continue
            value = 0.0
            for size in (4, 3, 2, 1):
                known = [g for g in langid.Model.split(w, size) if g in grams[size]]
                if known:
                    all_of = sum(c[k] for c in grams[size].values())
                    value = sum(math.log((grams[size][g][k] + 0.1) / (all_of + 0.1 * len(grams[size]))) for g in known) / len(known) + (4 - size) * langid.BACKOFF
                    break
            total[k] += value + langid.BACKOFF
    share = [math.exp((t - max(total)) / len(words)) for t in total]
    best = max(range(len(names)), key=lambda k: total[k])
    return names[best], share[best] / sum(share)


def test_langid_by_brute_force():
    import numpy as np

    rng = random.Random(8)
    counts = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))): [rng.randrange(9), rng.randrange(9), rng.randrange(3)] for _ in range(40)}
    names = ["x", "y", "z"]
    model = langid.Model(names, list(counts), np.array(list(counts.values())))
    for _ in range(60):
        text = " ".join(rng.choice([*counts, *("".join(rng.choice("abcdéfq") for _ in range(rng.randint(1, 7))) for _ in range(20))]) for _ in range(rng.randint(1, 12)))
        got, expected = model.score(text), score_by_force(text, names, counts)
        assert got[0] == expected[0] and abs(got[1] - expected[1]) < 1e-9
    assert model.score("123 _ ²") == (langid.UNKNOWN, 0.0)


def test_near_duplicates(docs, clashing, corpus, empty):
    found = near_dedup.verdicts(docs.unionByName(docs)).distinct()
    expected = brute.components(texts(corpus))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == expected
    left = near_dedup.survivors(clashing)
    assert left.columns == clashing.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(i for i, x in expected.items() if x[2])
    assert near_dedup.verdicts(empty).count() == 0


def test_near_duplicates_without_ids(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (1, text("c") + " more"), (2, text("d")), (2, text("e")), (None, text("a")), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, (r.text or "-")[0]) for r in near_dedup.survivors(table).collect()]
    assert sorted(left, key=str) == sorted([(None, "a"), (None, "b"), (1, "c"), (2, "d"), (2, "e"), (None, "-")], key=str)
    found = near_dedup.verdicts(table).filter("n_shingles > 0")
    assert found.filter("kept").count() == 6 and found.filter("component_id = 1").count() == 2  # the repeated row is kept twice


def test_near_duplicates_in_one_large_group(spark):
    """Copies at all distances from one text, most a little under the threshold from it and from each other, some linked only with one another."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 360):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(4, 14)):
            words[k] = rng.choice("abcdefgh")
        if i % 3 == 0:
            del words[rng.randrange(100) :][: rng.randint(1, 12)]
        rows.append((i, " ".join(words)))
        if i % 9 == 0:
            words[rng.randrange(120 - 20)] = "again"
            rows.append((1000 + i, " ".join(words)))
    expected = brute.components(rows)
    found = near_dedup.verdicts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == expected
    assert 100 < len({x[1] for x in expected.values()}) < 350


def test_near_duplicates_among_texts_of_frequent_words(spark):
    """Texts that share frequent shingles by chance, the more of them the larger the corpus, are not posted; their near copies are."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 3) for k in range(500)], k=100))) for i in range(800)]
    rows += [(1000 + i, rows[i][1].replace(rows[i][1].split()[50], "other", 1)) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = near_dedup.signatures(near_dedup.keyed(table, "doc_id", "text")).withColumn("node", near_dedup.named_by_set())
    posted = {r.node for r in near_dedup._postings(near_dedup.Scratch(spark), classes).select("node").collect()}
    copies = {r.node for r in classes.filter("doc < 20 or doc >= 1000").collect()}
    assert copies <= posted and len(posted) < 3 * len(copies)
    found = near_dedup.verdicts(table)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute.components(rows)


def test_quality(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(r[0], int(not re.search(r"[|]|!!", r[1] or "")), None) for r in corpus], "doc_id long, quality int, toxic int")
    weights = quality.fit(docs, labels)
    found = {r.doc_id: r for r in quality.verdicts(quality.measure(docs, weights)).collect()}
    for i, text in texts(corpus):
        r = found[i]
        n, *_, repeated = expected = brute.quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and (not r.kept or not r.base_failed)
    clean = [i for i, t in texts(corpus) if t and re.fullmatch(r"(?s)[A-Z][a-z. \n]+.*", t) and not found[i].base_failed and "|" not in t and "!!" not in t]
    assert len(clean) > 30 and all(found[i].kept for i in clean)
    assert quality.fit(docs, labels.limit(0)) == quality.DEFAULT_WEIGHTS
    assert quality.measure(empty, weights).count() == 0


MIXED_PROSE = ["The old house stands by the sea and waits.", "Nobody came to see it for many years.", "Then a child opened the door."]
MIXED_JUNK = ["Home | About | Contact | Login | More", "BUY NOW!! CHEAP!! OFFER!!", "###*** $$$ win %%% &&& click ***"]


def test_quality_labels_lines_of_mixed_documents():
    import numpy as np

    rng = random.Random(2)
    pick = lambda pool, n: [rng.choice(pool) + " " + "word " * rng.randrange(3) for _ in range(n)]
    good = ["\n".join(pick(MIXED_PROSE, 8)) for _ in range(30)] + ["\n".join(pick(MIXED_PROSE, 7) + pick(MIXED_JUNK, 1)) for _ in range(10)]
    bad = ["\n".join(pick(MIXED_PROSE, 2) + pick(MIXED_JUNK, 7)) for _ in range(40)]
    weights = quality.train(good + bad, [True] * 40 + [False] * 40)

    def labels(text):
        (part,) = quality.slices(pa.array([text]))
        return quality.viterbi(quality.Lines(part).features(part) @ np.array(weights[:-1]), weights[-1]).tolist()

    assert labels("\n".join([*MIXED_PROSE, *MIXED_JUNK, *MIXED_PROSE])) == [True] * 3 + [False] * 3 + [True] * 3


def test_quality_gradient_by_brute_force():
    import itertools
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(4, 2, 3)), rng.normal(size=4)
    there = np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    x[~there] = 0
    content, same = quality.marginals(x @ w[:-1], w[-1], there)
    for c, n in ((0, 4), (1, 3)):
        labels = list(itertools.product((0, 1), repeat=n))
        score = lambda y: sum(float(x[i, c] @ w[:-1]) * y[i] for i in range(n)) + w[-1] * sum(y[i] == y[i + 1] for i in range(n - 1))  # noqa: B023, E731
        mass = [math.exp(score(y)) for y in labels]
        for i in range(n):
            assert abs(content[i, c] - sum(m for m, y in zip(mass, labels, strict=True) if y[i]) / sum(mass)) < 1e-9
        for i in range(n - 1):
            assert abs(same[i, c] - sum(m for m, y in zip(mass, labels, strict=True) if y[i] == y[i + 1]) / sum(mass)) < 1e-9
    goal, pairs = np.where(there, 0.3, 0.0), np.where(there[1:], 0.6, 0.0)
    likelihood = lambda v: sum(
        float((goal[:n, c] * (x[:n, c] @ v[:-1])).sum() + v[-1] * pairs[: n - 1, c].sum())
        - math.log(sum(math.exp(sum(float(x[i, c] @ v[:-1]) * y[i] for i in range(n)) + v[-1] * sum(y[i] == y[i + 1] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=n)))
        for c, n in ((0, 4), (1, 3))
    )
    found = quality.gradient(w, x, there, goal, pairs, np.ones(2))
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        assert abs(found[k] - (likelihood(w + step) - likelihood(w - step)) / 2e-5) < 1e-6


def test_viterbi_is_the_best_labelling():
    import itertools
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        scores, stay = [rng.uniform(-2, 2) for _ in range(6)], rng.uniform(-1, 2)
        value = lambda y: sum(s for s, k in zip(scores, y) if k) + stay * sum(a == b for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product((False, True), repeat=6), key=value)
        assert abs(value(quality.viterbi(np.array(scores), stay).tolist()) - value(best)) < 1e-9


PAGE = "<html><head><title>t</title><style>x</style></head><body><nav><ul><li><a href='/'>Menu {0}</a></ul></nav><div class='ad'>Buy {0}</div><article><h1>Head {0}</h1><p>First&nbsp;text &amp; more {0}<br>next<p>Second   {0} has words enough</p><div>Share this page</div></article><section class='comments'><p>Nice {0}</p></section><script>var a='</p>'</script><footer>Foot</footer></body></html>"


def test_html(spark):
    rows = [(i, f"https://h.org/{i}", PAGE.format(i)) for i in range(9)] + [(20, None, None), (21, "::bad", ""), (22, "https://one.org", "<p>Only <b>text"), (23, "https://h.org/x", "no markup at all")]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(9):
        assert found[i] == f"Head {i}\nFirst text & more {i} next\nSecond {i} has words enough"
    assert [found[i] for i in (20, 21, 22, 23)] == ["", "", "Only text", "no markup at all"]


ARTICLE = "<html><body><div id=top>Site name</div><article><h1>{0} title</h1><p>{0} opens with this text</p>{1}<p>{0} ends here</p></article></body></html>"


def read(html, wrapper):
    return dom.extract(html, dom.Wrapper(wrapper) if wrapper else None)


def test_html_keeps_copies():
    copy = ["One title", "One opens with this text", "One ends here"]
    copies = [ARTICLE.format("One", "").replace("<body>", f"<body><!-- {i} -->") for i in range(8)]
    assert read(copies[0], dom.induce(copies)).split("\n") == copy
    wrapper = dom.induce(copies + [ARTICLE.format(w, "") for w in ("Two", "Three")])
    assert read(copies[0], wrapper).split("\n") == copy


def test_html_template_by_place():
    rows = [ARTICLE.format(w, "").replace("</article>", "<div>Share this page</div></article>") for w in ("One", "Two", "Three", "Four")]
    wrapper = dom.induce(rows)
    assert read(rows[0], wrapper) == "One title\nOne opens with this text\nOne ends here"
    assert "Share this page" in read(ARTICLE.format("Five", "<p>Share this page</p>"), wrapper)
    assert "Share this page" in read(ARTICLE.format("Five", "<div>Share this page</div>"), wrapper)


def test_html_keeps_whole_articles():
    nested = "<body><div>Top</div><article><h1>{0} title</h1><p>{0} lead</p><div class=body><p>" + "{0} text is long enough " * 20 + "</p></div></article></body>"
    rows = [nested.format(w) for w in ("One", "Two", "Three", "Four")]
    for page in (read(rows[0], dom.induce(rows)), read(rows[0], None)):
        assert page.split("\n")[:2] == ["One title", "One lead"]
    parts = "<body><div>Top</div><section><p>{0} one</p></section><section><p>{0} and the second section</p></section><section><p>{0} three</p></section></body>"
    rows = [parts.format(w) for w in ("One", "Two", "Three", "Four")] + ["<body><div>Top</div><section><p>" + "All in one. " * 9 + "</p></section></body>"]
    assert read(rows[0], dom.induce(rows)).split("\n") == ["One one", "One and the second section", "One three"]


def test_tree_matching():
    pairs = []
    dom.match(dom.parse("<ul><li>a<li>b<li>c</ul>"), dom.parse("<ul><li>x<p>y</p><li>z</ul>"), pairs)
    assert [x.tag for x, _ in pairs].count("li") == 2 and pairs[0][0].tag == "#document"


def matched_by_force(x, y):
    """Nodes in the best alignment, by the definition."""
    if x.label != y.label:
        return 0
    xs, ys = x.elements(), y.elements()
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, a in enumerate(xs, 1):
        for j, b in enumerate(ys, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + matched_by_force(a, b))
    return 1 + best[-1][-1]


def random_tree(rng, depth=0):
    tag = rng.choice(["div", "section", "b", "ul"])
    inner = "".join(random_tree(rng, depth + 1) for _ in range(rng.randrange(5))) if depth < 4 else ""
    return f"<{tag}>{inner}</{tag}>"


def test_tree_matching_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a, b = (dom.parse("<body>" + "".join(random_tree(rng) for _ in range(3)) + "</body>") for _ in range(2))
        pairs = dom.Matcher().pairs(a, b)
        assert len(pairs) == matched_by_force(a, b) and all(x.label == y.label for x, y in pairs)
        opposite = {id(x): y for x, y in pairs}
        assert len({id(y) for _, y in pairs}) == len(pairs)
        assert all(opposite[id(x.parent)] is y.parent for x, y in pairs if x.parent is not None)
        for x in dom.walk(a):  # order is kept
            at = [y.parent.elements().index(y) for y in (opposite[id(c)] for c in x.elements() if id(c) in opposite)]
            assert at == sorted(at)


PLAIN = "<html><body><div><ul><li><a href=/a>Home {0}</a><li><a href=/b>More {0}</a></ul></div><div><p>Offer of the day {0}</p></div><div><h2>{0} title</h2><p>Update</p>{1}<div>Read on below</div><p>{0} ends here</p></div><div>Imprint {0}</div></body></html>"


def plain_page(i, n=4):
    return PLAIN.format(f"W{i}", "".join(f"<p>{f'text {i} number {k} ' * 6}</p>" for k in range(n + i % 3)))


def test_wrapper_decides_on_unmarked_pages():
    pages = [plain_page(i) for i in range(6)]
    wrapper = dom.induce(pages)
    for i, page in enumerate(pages):
        body = [" ".join(f"text {i} number {k}".split() * 6) for k in range(4 + i % 3)]
        assert read(page, wrapper).split("\n") == [f"W{i} title", "Update", *body, f"W{i} ends here"]
        assert "Imprint" in read(page, None)
    assert read(plain_page(7, 0), wrapper).split("\n")[0] == "W7 title" and "Home" not in read(plain_page(7, 0), wrapper)


def test_wrapper_among_slots_of_like_size():
    rng = random.Random(1)
    w = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [(w(25), w(25), w(20)) for _ in range(6)]
    pages = [f"<body><div class=top>{w(4)}</div><div class=main><h1>T {i}</h1><p>{a}</p><p>{b}</p></div><div class=sidebar><p>{c}</p><p>{w(15)}</p></div><div class=foot>{w(6)}</div></body>" for i, (a, b, c) in enumerate(texts)]
    assert read(pages[0], dom.induce(pages)) == "\n".join(["T 0", *texts[0][:2]])
    pages = [f"<body><table><tr><td>{w(3)}</td><td><p>{a}</p><p>{b}</p></td><td><a href=x>{c}</a></td></tr></table></body>" for a, b, c in texts]
    assert read(pages[2], dom.induce(pages)) == "\n".join(texts[2][:2])
    pages = [f"<body><article><h1>T&amp;{i}</h1><p>{a}</p><form>Mail <input></form><table><tr><td>1</td><td>{b}</td></tr></table><div class=ad>{w(3)}</div><section class=comments><p>{c}</p></section></article></body>" for i, (a, b, c) in enumerate(texts)]
    assert read(pages[3], dom.induce(pages)) == "\n".join(["T&3", texts[3][0], "1", texts[3][1]])


def test_deep_and_wide_pages():
    deep = "<body><div>" + "<div>x " * 20000 + "</div>" * 20000 + "</div></body>"
    assert read(deep, None).split() == ["x"] * 20000
    assert dom.induce([deep, deep.replace("x ", "y "), deep.replace("x ", "z ")]) is not None
    wide = ["<body><div>Menu</div><div class=main>" + "".join(f"<p>{w} {k} is a line</p>" + "<hr>" * (k % j == 0) for k in range(6000)) + "</div></body>" for j, w in ((7, "one"), (11, "two"), (13, "three"), (17, "four"))]
    assert sum(map(len, wide)) > 500_000
    found = read(wide[0], dom.induce(wide)).split("\n")
    assert len(found) == 6000 and found[5] == "one 5 is a line"


def test_html_empty_and_clashing(spark):
    rows = [(i, f"https://h.org/{i}", PAGE.format(i), 1, "kept") for i in range(3)] * 2
    table = spark.createDataFrame(rows, "page_id int, url string, html string, text int, host string")
    found = html_text.extract(table)
    assert found.columns == ["page_id", "url", "html", "host", "text"] and found.filter("host = 'kept'").count() == 6
    assert found.select("page_id", "text").distinct().count() == 3 and html_text.extract(table.limit(0)).count() == 0
