"""Where a short text lies in a longer one: best window by insert-delete similarity."""

from __future__ import annotations

import numpy as np

CUTOFF = 55.0


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common / total length; 100 for two empty texts."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def locate(short: str, long: str, cutoff: float = CUTOFF) -> tuple[int, int, float] | None:
    """(start, end, score) of the window of `long` most like `short`, the first of equals; None below the cutoff.

    Windows at the edges may be shorter than `short`. A bound from character
    counts skips windows that cannot beat the best so far.
    """
    if not short or not long:
        return None
    n = min(len(short), len(long))
    if len(long) < len(short):
        score = ratio(short, long)
        return (0, len(long), score) if score >= cutoff else None
    alphabet = sorted(set(short))
    text = np.array(list(long))
    common = np.zeros(len(long) + 1 - n + 2 * (n - 1), np.int64)
    spans = [(0, k) for k in range(1, n)] + [(s, s + n) for s in range(len(long) - n + 1)] + [(s, len(long)) for s in range(len(long) - n + 1, len(long))]
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    for c in alphabet:
        seen = np.concatenate([[0], np.cumsum(text == c)])
        common += np.minimum(seen[ends] - seen[starts], short.count(c))
    bound = 200.0 * common / (len(short) + ends - starts)
    best: tuple[int, int, float] | None = None
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < cutoff or (best is not None and bound[k] < best[2]):
            break
        score = ratio(short, long[starts[k] : ends[k]])
        if score >= cutoff and (best is None or (score, -starts[k]) > (best[2], -best[0])):
            best = (int(starts[k]), int(ends[k]), score)
    return best
