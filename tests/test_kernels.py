import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.kernels import banddp, ctc, editdp, fuzzy, ocrseq, rewrite, tokendiff, worddp
from weftline.plans import rowwise, sequences

WORDS = st.lists(st.sampled_from("abcd"), max_size=7)


def table_align(ref, hyp, scores, whole):
    """The alignment table cell by cell, as its rules say."""
    n, m = len(ref), len(hyp)
    h = [[(-(m + 2) if whole else 0)] * (m + 1) for _ in range(n + 1)]
    back = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for r in range(n + 1):
        h[r][0] = 0
    if whole:
        for c in range(1, m + 1):
            h[0][c], back[0][c] = h[0][c - 1] + scores.insertion, (0, c - 1)
    best, end = None, (0, 0)
    for r in range(1, n + 1):
        for c in range(1, m + 1):
            d = h[r - 1][c - 1] + (scores.match if ref[r - 1] == hyp[c - 1] else scores.substitution)
            if (d >= h[r][c]) if whole else d > 0:
                h[r][c], back[r][c] = d, (r - 1, c - 1)
            if h[r - 1][c] + scores.deletion > h[r][c]:
                h[r][c], back[r][c] = h[r - 1][c] + scores.deletion, (r - 1, c)
            if h[r][c - 1] + scores.insertion > h[r][c]:
                h[r][c], back[r][c] = h[r][c - 1] + scores.insertion, (r, c - 1)
            if (not whole or c == m) and (best is None or h[r][c] >= best):
                best, end = h[r][c], (r, c)
    return h, back, end, best


@pytest.mark.parametrize("whole", [True, False])
@given(ref=WORDS, hyp=WORDS, penalty=st.sampled_from([-1, -3]))
@settings(max_examples=150, deadline=None)
def test_word_alignment_follows_the_table(whole, ref, hyp, penalty):
    scores = worddp.Scores(1, -1, penalty, penalty)
    steps, score = worddp.align(ref, hyp, scores, whole)
    h, back, end, best = table_align(ref, hyp, scores, whole)
    if not ref or not hyp:
        return
    assert score == best
    if steps:
        assert (steps[-1].ref_to, steps[-1].hyp_to) == end
    for s in steps:
        assert back[s.ref_to][s.hyp_to] == (s.ref_from, s.hyp_from)


def test_long_alignment_keeps_few_rows(monkeypatch):
    monkeypatch.setattr(worddp, "CELLS", 1)
    rng = np.random.default_rng(5)
    ref = rng.choice(list("abcdefgh"), 900).tolist()
    hyp = [w for k, w in enumerate(ref[100:800]) if k % 11]
    steps, score = worddp.align(ref, hyp)
    h, back, end, best = table_align(ref, hyp, worddp.Scores(), True)
    assert score == best and (steps[-1].ref_to, steps[-1].hyp_to) == end and len(steps) > 600
    assert all(back[s.ref_to][s.hyp_to] == (s.ref_from, s.hyp_from) for s in steps)


@pytest.mark.parametrize("cells", [1, 1 << 24])
@given(ref=WORDS, hyp=st.lists(st.sampled_from("abcz"), max_size=80), seed=st.integers(0, 99))
@settings(max_examples=150, deadline=None)
def test_word_alignment_in_bits_follows_the_table(cells, ref, hyp, seed):
    ref = ref + np.random.default_rng(seed).choice(list("abcd"), 30).tolist()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(worddp, "CELLS", cells)
        plain, scores = worddp._Table(ref, hyp, worddp.Scores(), True, None), worddp.Scores()
        ends = [(int(row[-1]), (r, len(hyp))) for r, row in plain.forward()]
        best, end = max(ends)
        if hyp:
            assert worddp.align(ref, hyp, scores) == (worddp._trace(plain, end, best), best)


def test_long_files_take_a_step_for_many_cells():
    rng = np.random.default_rng(7)
    ref = [str(w) for w in rng.zipf(1.3, 12_000) % 3000]
    hyp = [w for k, w in enumerate(ref) if k % 7 != 6]
    began = time.process_time()
    steps, score = worddp.align(ref, hyp)
    spent = time.process_time() - began
    row, numbers = np.zeros(len(hyp) + 1, np.int64), range(200)
    began = time.process_time()
    plain = worddp._Table(ref, hyp, worddp.Scores(), True, None)
    for r in numbers:
        row, _ = plain.follow(row, r + 1)
    assert spent < (time.process_time() - began) / len(numbers) * len(ref) and score >= len(hyp) - 12_000 // 7 and len(steps) >= len(hyp)


def test_golden_alignment():
    steps, score = worddp.align("the cat sat on the mat".split(), "cat sat down".split())
    assert [(s.ref_from, s.hyp_from, s.ref_to, s.hyp_to) for s in steps] == [(1, 0, 2, 1), (2, 1, 3, 2), (3, 2, 4, 3)] and score == 1


def test_penalties_are_needed():
    with pytest.raises(ValueError):
        worddp.Scores(deletion=0)


def test_golden_edits():
    found = editdp.edits("dh ax s t ao r".split(), "dh ix s ao r".split())
    assert [(o, r, a) for o, _, r, a in found] == [("match", "dh", "dh"), ("substitution", "ax", "ix"), ("match", "s", "s"), ("deletion", "t", None), ("match", "ao", "ao"), ("match", "r", "r")]


@given(WORDS, WORDS)
@settings(max_examples=100)
def test_edits_rebuild_both(a, b):
    found = editdp.edits(a, b)
    assert [r for _, _, r, _ in found if r is not None] == a and [h for *_, h in found if h is not None] == b


def test_golden_bands():
    assert banddp.align(np.array([[0.9, 0.1], [0.1, 0.8]])) == [(0, 0), (1, 1)]


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 1000))
@settings(max_examples=60)
def test_bands_list_every_item_once(m, n, seed):
    sim = np.random.default_rng(seed).random((m, n))
    found = banddp.align(sim)
    assert sorted(i for i, _ in found if i is not None) == list(range(m)) and sorted(j for _, j in found if j is not None) == list(range(n))
    pairs = [(i, j) for i, j in found if i is not None and j is not None]
    assert pairs == sorted(pairs) and all(sim[i, j] >= banddp.THRESHOLD for i, j in pairs)


def test_golden_ocr():
    found = ocrseq.align("the quikc fox".split(), "the quick brown fox".split(), {"the", "fox"}.__contains__)
    assert [(p, round(c, 2)) for p, c, _ in found] == [(0, 0.75), (1, -0.4), (3, 0.5)]
    with pytest.raises(ValueError):
        ocrseq.align(["a"], [])


def test_chunk_split():
    ops = tokendiff.diff("a b c d".split(), "a b d".split())
    assert ("delete", 2, 3) not in [o[1:4] for o in tokendiff.split(ops, [0, 2, 3], compat=True)]
    assert (1, "delete", 2, 3, 2, 2) in tokendiff.split(ops, [0, 2, 3])
    assert "+b" in tokendiff.text_diff("a", "a\nb")


def test_locate():
    assert fuzzy.locate("quick", "the quick fox") == (4, 9, 100.0)
    assert fuzzy.locate("zzzz", "the quick fox") is None and fuzzy.locate("", "x") is None


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
@settings(max_examples=100)
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert fuzzy.lcs_length(a, b) == t[-1][-1]


def test_forced_alignment():
    logits = np.full((6, 3), -5.0)
    for t, k in enumerate([0, 1, 1, 0, 2, 0]):
        logits[t, k] = 5.0
    assert [(a, b) for a, b, _ in ctc.forced(ctc.log_softmax(logits), [1, 2])] == [(1, 3), (4, 5)]


def test_best_path():
    logits = np.full((4, 3), -5.0)
    for t, k in enumerate([1, 0, 2, 0]):
        logits[t, k] = 5.0
    path, _ = ctc.best_path(ctc.log_softmax(logits), [(0, 1, 1, 0.0), (1, 2, 2, 0.0)], 2)
    assert [(t, s) for t, s, _ in path if s > 0] == [(0, 1), (2, 2)]


def test_rewrite():
    rule = rewrite.Rewrite("t", "d", "[aeiou]h?", "er")
    assert rewrite.variants(["b", "ah", "t", "er"], [rule]) == [("b", "ah", "t", "er"), ("b", "ah", "d", "er")]
    assert rewrite.variants(["s", "t"], [rewrite.Rewrite("t", "")]) == [("s", "t"), ("s",)]
    assert rewrite.pronunciations([[("a",), ("b",)], [("c",)]]) == [("a", "c"), ("b", "c")]


def test_bands_keep_few_rows(monkeypatch):
    rng = np.random.default_rng(3)
    left, right = rng.standard_normal((2, 700, 8))
    left[200:500] = right[150:450]
    left, right = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right))
    whole = banddp.align(left @ right.T)
    assert {(200 + k, 150 + k) for k in range(300)} <= set(whole)
    monkeypatch.setattr(banddp, "CELLS", 1 << 13)
    tracemalloc.start()
    found = banddp.align_vectors(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == whole and most < 700 * 700 * 4  # the table alone has 8 bytes a cell


@given(st.integers(1, 14), st.integers(1, 14), st.integers(0, 1000), st.sampled_from([0.0, 0.1, 0.3]), st.sampled_from([0, 2, 10]))
@settings(max_examples=80, deadline=None)
def test_bands_follow_the_whole_box(m, n, seed, penalty, band):
    sim = np.round(np.random.default_rng(seed).random((m, n)) * 1.4 - 0.4, 1)
    total, back = np.full((m + 1, n + 1), -np.inf), {}
    total[0, 0] = 0
    for i, j in np.ndindex(m, n):
        tried = [(-np.inf, None)]
        if sim[i, j] >= 0.2:
            tried = [(total[p, q] + sim[i, j] - penalty * max(max(i - p, j - q) - 1, 0), (p, q)) for p in range(max(0, i - band), i + 1) for q in range(max(0, j - band), j + 1)]
        tried += [(total[i, j + 1], (i, j + 1)), (total[i + 1, j], (i + 1, j))]
        total[i + 1, j + 1], back[i + 1, j + 1] = max(tried, key=lambda x: x[0])
    at, pairs = (m, n), []
    while at in back and total[at] > -np.inf:
        p, q = back[at]
        if p < at[0] and q < at[1]:
            pairs.append((at[0] - 1, at[1] - 1))
        at = p, q
    assert [x for x in banddp.align(sim, penalty, 0.2, band) if None not in x] == pairs[::-1]


def test_results_are_objects_for_few_rows_at_once():
    kind = sequences._READ
    words = pa.array([[f"w{k % 7}" for k in range(200)]] * 1500 + [None, []])
    run = rowwise.listed(kind, lambda w: None if w is None else [(k, 0.5, False) for k in range(len(w))]).func
    tracemalloc.start()
    found = run(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8_000_000  # 300,000 dicts would be seven times that
    assert found[-2].as_py() is None and found[-1].as_py() == [] and found[1499].as_py()[199] == {"ref_pos": 199, "confidence": 0.5, "failed": False}
    assert len(found) == 1502 and len(run(words.slice(0, 0))) == 0
