"""Sequential alignment of OCR words to a reference, with confidences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

WINDOW, EDITS = 20, 3


def levenshtein(a: str, b: str, most: int) -> int:
    """Edit distance; anything over `most` is most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def align(words: Sequence[str], reference: Sequence[str], known: Callable[[str], bool] = lambda w: False, window: int = WINDOW, edits: int = EDITS) -> list[tuple[int, float, bool]]:
    """(reference position, confidence, failed) of each word; reference must not be empty.

    The next position is tried first, then equal words ahead and behind, then
    similar ones, nearer in edits first. A later word may raise or lower the
    confidence of the one before it.
    """
    if not reference:
        raise ValueError("the reference has no words")
    ref = [w.lower() for w in reference]
    out: list[list] = []
    at = -1

    def ahead(start: int, fits: Callable[[str], bool]) -> int | None:
        return next((i for i in range(start, min(start + window, len(ref))) if fits(ref[i])), None)

    def behind(before: int, fits: Callable[[str], bool]) -> int | None:
        return next((i for i in range(before - 1, max(0, before - window) - 1, -1) if fits(ref[i])), None)

    def before(change: float) -> None:
        if out:
            out[-1][1] += change

    for word in words:
        w, in_dictionary = word.lower(), known(word)
        confidence, then = 0.5 * in_dictionary, at + 1
        if then < len(ref) and ref[then] == w:
            before(0.25)
            at = then
            out.append([at, confidence + 0.25, False])
            continue
        if then < len(ref):
            confidence -= 0.25
            if in_dictionary:
                before(-0.25)
        found = ahead(then + 1, w.__eq__)
        gain = 0.25
        if found is None and at > 0:
            found, gain = behind(at, w.__eq__), 0.1
            if found is not None:
                before(-0.4)
        searches = [(ahead, then)] + ([(behind, at)] if at > 0 else [])
        for search, start in searches if found is None else ():
            for d in range(1, edits + 1):
                found = search(start, lambda r, d=d: levenshtein(w, r, d) <= d)
                if found is not None:
                    break
            gain = 0.1
            if found is not None:
                break
        if found is not None:
            at = found
            out.append([at, confidence + gain, False])
        else:
            at = min(then, len(ref) - 1)
            out.append([at, confidence - 1.0, True])
    return [(p, round(c, 6), f) for p, c, f in out]
