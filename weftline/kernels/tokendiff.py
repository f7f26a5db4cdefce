"""Token diffs by longest matching blocks, and their split at chunk boundaries."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher, unified_diff


def diff(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """(op, a from, a to, b from, b to) with op equal, replace, insert or delete."""
    return SequenceMatcher(None, a, b).get_opcodes()


def split(ops: Sequence[tuple[str, int, int, int, int]], bounds: Sequence[int], compat: bool = False) -> list[tuple[int, str, int, int, int, int]]:
    """(chunk, op, a from, a to, b from, b to) with the ops cut at chunk bounds of the b side.

    Equal stretches split one to one, others share their a words in
    proportion, truncated. What b lacks goes to the chunk that it lies in; at
    a bound to the next chunk (compat: it is lost), at the end to the last.
    """
    out: list[tuple[int, str, int, int, int, int]] = []
    chunks = list(zip(bounds[:-1], bounds[1:], strict=True))
    for op, a0, a1, b0, b1 in ops:
        if b0 == b1:
            inside = [k for k, (lo, hi) in enumerate(chunks) if lo < b0 < hi]
            if not inside and not compat and chunks:
                inside = [k for k, (lo, _) in enumerate(chunks) if lo >= b0][:1] or [len(chunks) - 1]
            out += [(k, op, a0, a1, b0, b1) for k in inside]
            continue
        for k, (lo, hi) in enumerate(chunks):
            x, y = max(b0, lo), min(b1, hi)
            if x < y:
                if op == "equal":
                    out.append((k, op, a0 + x - b0, a0 + y - b0, x, y))
                else:
                    share = (a1 - a0) / (b1 - b0)
                    out.append((k, op, a0 + int((x - b0) * share), a1 if y == b1 else a0 + int((y - b0) * share), x, y))
    return out


def text_diff(a: str, b: str) -> str:
    """A unified diff of two texts by lines."""
    return "\n".join(unified_diff(a.splitlines(), b.splitlines(), lineterm=""))
