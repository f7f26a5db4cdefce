"""Word alignment by dynamic programming: semi-global or local, one row of the table at a time.

Only every so many rows are kept; the moves between two of them are computed
again when the path is followed back through them. So a table of any size needs
memory for the square root of its rows. With the usual scores a row is a few
integers with a bit for each column, so that a step serves dozens of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

NONE, DIAGONAL, DELETION, INSERTION = 0, 1, 2, 3
#: Moves kept at once at least; smaller tables are kept whole.
CELLS = 1 << 24


@dataclass(frozen=True)
class Scores:
    match: int = 1
    substitution: int = -1
    deletion: int = -1
    insertion: int = -1

    def __post_init__(self) -> None:
        if self.deletion >= 0 or self.insertion >= 0:
            raise ValueError("deletions and insertions need a penalty")


@dataclass(frozen=True)
class Step:
    ref_from: int
    hyp_from: int
    ref_to: int
    hyp_to: int


def align(ref: Sequence[str], hyp: Sequence[str], scores: Scores | None = None, whole_hyp: bool = True, similarity: Callable[[str, str], int] | None = None) -> tuple[list[Step], int]:
    """(steps, score). whole_hyp: all of hyp against the best stretch of ref; else the best stretches of both.

    Ties: the diagonal wins over what the cell holds, then deletion and
    insertion only if strictly better; the last best end wins.
    """
    scores = scores or Scores()
    if whole_hyp and similarity is None and scores == Scores() and ref and hyp:
        bits = _Bits(ref, hyp)
        best, end = bits.best()
        return _trace(bits, end, best), best
    table = _Table(ref, hyp, scores, whole_hyp, similarity)
    m, best, end = len(hyp), -(1 << 60), (0, 0)
    for r, row in table.forward():
        if whole_hyp:
            if m and row[m] >= best:
                best, end = int(row[m]), (r, m)
        elif m and row[1:].max() >= best:
            best = int(row[1:].max())
            end = (r, int(np.flatnonzero(row[1:] == best)[-1]) + 1)
    return _trace(table, end, best), best


class _Table:
    """Rows of the alignment table and the moves into their cells."""

    def __init__(self, ref: Sequence[str], hyp: Sequence[str], scores: Scores, whole_hyp: bool, similarity: Callable[[str, str], int] | None):
        self.ref, self.hyp, self.scores, self.whole_hyp, self.similarity = ref, hyp, scores, whole_hyp, similarity
        codes = {w: i for i, w in enumerate(dict.fromkeys([*ref, *hyp]))}
        self.ref_codes = [codes[w] for w in ref]
        self.hyp_codes = np.array([codes[w] for w in hyp], np.int64)
        self.across = np.arange(len(hyp) + 1, dtype=np.int64) * scores.insertion
        self.step = max(1, int(len(ref) ** 0.5), CELLS // (len(hyp) + 1))
        self.kept = {0: self.across.copy() if whole_hyp else np.zeros(len(hyp) + 1, np.int64)}
        self.first, self.moves = -1, np.empty((0, 0), np.int8)

    def forward(self) -> Iterator[tuple[int, np.ndarray]]:
        """(r, row) from the second row on; keeps every step-th row."""
        row = self.kept[0]
        for r in range(1, len(self.ref) + 1):
            row, _ = self.follow(row, r)
            if r % self.step == 0:
                self.kept[r] = row
            yield r, row

    def gain(self, r: int) -> np.ndarray:
        if self.similarity is None:
            return np.where(self.hyp_codes == self.ref_codes[r - 1], self.scores.match, self.scores.substitution)
        return np.array([self.similarity(self.ref[r - 1], w) for w in self.hyp], np.int64)

    def follow(self, row: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Row r and the moves into it, from the row before."""
        m, moves = len(self.hyp), np.zeros(len(self.hyp) + 1, np.int8)
        cell = np.full(m + 1, -(m + 2) if self.whole_hyp else 0, np.int64)
        cell[0] = 0
        across = row[:-1] + self.gain(r)
        take = across >= cell[1:] if self.whole_hyp else across > 0
        cell[1:] = np.where(take, across, cell[1:])
        moves[1:] = np.where(take, DIAGONAL, NONE)
        down = row[1:] + self.scores.deletion
        take = down > cell[1:]
        cell[1:] = np.where(take, down, cell[1:])
        moves[1:][take] = DELETION
        reach = np.maximum.accumulate(cell - self.across) + self.across
        take = reach[:-1] + self.scores.insertion > cell[1:]
        moves[1:][take] = INSERTION
        return np.where(np.append(False, take), reach, cell), moves

    def move(self, r: int, c: int) -> int:
        """How the best path comes into a cell."""
        if r == 0:
            return INSERTION if self.whole_hyp and c else NONE
        first = (r - 1) // self.step * self.step
        if first != self.first:
            row, found = self.kept[first], []
            for k in range(first + 1, min(first + self.step, len(self.ref)) + 1):
                row, moves = self.follow(row, k)
                found.append(moves)
            self.first, self.moves = first, np.stack(found)
        return int(self.moves[r - first - 1, c])

    def worth(self, r: int, c: int) -> int:
        """What a diagonal move into a cell gains."""
        a, b = self.ref[r - 1], self.hyp[c - 1]
        return self.similarity(a, b) if self.similarity else (self.scores.match if a == b else self.scores.substitution)


class _Bits:
    """The table of whole_hyp with the usual scores, a row of it in a few integers with a bit for each column.

    A cell differs by -1 to 2 from the one to its left and from the one above it
    (Loving, Hernandez and Benson's BitPAl). Differences of -1 run along a row
    as carries of an addition.
    """

    whole_hyp, scores = True, Scores()

    def __init__(self, ref: Sequence[str], hyp: Sequence[str]):
        self.ref, self.hyp, self.m = ref, hyp, len(hyp)
        self.all, at = (1 << self.m) - 1, {}
        wanted = set(ref)
        for c, w in enumerate(hyp):
            if w in wanted:
                at.setdefault(w, []).append(c)
        self.at = {w: self._bits(places) for w, places in at.items()}
        self.step = max(1, int(len(ref) ** 0.5), 8 * CELLS // (self.m + 1))
        self.kept = {0: (0, 0, 0)}
        self.first, self.moves = 0, []

    def _bits(self, places: list[int]) -> int:
        if len(places) < 8:
            return sum(1 << c for c in places)
        found = bytearray(self.m // 8 + 1)
        for c in places:
            found[c >> 3] |= 1 << (c & 7)
        return int.from_bytes(found, "little")

    def follow(self, row: tuple[int, int, int], r: int) -> tuple[tuple[int, int, int], tuple[int, int], int]:
        """Row r, the diagonal moves and deletions into it, and the difference of its last cell to the one above.

        A row is where a cell is more than its left one by 0, by 1 and by 2; elsewhere it is less by 1.
        """
        zero, one, two = row
        every, match = self.all, self.at.get(self.ref[r - 1], 0)
        less, differs = every ^ (zero | one | two), every ^ match
        # Differences to the cell above (up2, up1, up0), and those of the cell to the left (left2, left1, left0).
        seeds = less & match
        up2 = ((((seeds + less) ^ less) | seeds) & less) if seeds else 0
        left2 = (up2 << 1) & every
        begun = zero & (match | left2)
        run = less & differs
        seeds = (begun << 1) & run
        up1 = begun | (((((seeds + run) ^ run) | seeds) & run) if seeds else 0)
        left1 = (up1 << 1) & every
        up0 = (match & one) | (differs & ((one & left2) | (zero & left1) | (less & ~(left2 | left1))))
        left0 = ((up0 << 1) | 1) & every
        leftless = every ^ (left0 | left1 | left2)
        # The cell against the one diagonally before it: 1, 0 or -1 more.
        more = match | two | left2
        same = (one | left1) & ~more
        least = every ^ (more | same)
        row = (more & left1) | (same & left0) | (least & leftless), (more & left0) | (same & leftless), more & leftless
        diagonal = match | least
        deletion = ((more & two) | (same & one)) & ~diagonal
        last = self.m - 1
        return row, (diagonal, deletion), 2 if up2 >> last else 1 if up1 >> last else 0 if up0 >> last else -1

    def best(self) -> tuple[int, tuple[int, int]]:
        """The best score of all of hyp, and where its last best path ends."""
        row, score, best, end = self.kept[0], -self.m, -(1 << 60), (0, 0)
        for r in range(1, len(self.ref) + 1):
            row, moves, change = self.follow(row, r)
            if r <= self.step:
                self.moves.append(moves)
            if r % self.step == 0:
                self.kept[r] = row
            score += change
            if score >= best:
                best, end = score, (r, self.m)
        return best, end

    def move(self, r: int, c: int) -> int:
        """How the best path comes into a cell."""
        if r == 0 or c == 0:
            return INSERTION if c else NONE
        first = (r - 1) // self.step * self.step
        if first != self.first:
            row, self.moves = self.kept[first], []
            for k in range(first + 1, min(first + self.step, len(self.ref), r) + 1):
                row, moves, _ = self.follow(row, k)
                self.moves.append(moves)
            self.first = first
        diagonal, deletion = self.moves[r - first - 1]
        return DIAGONAL if diagonal >> c - 1 & 1 else DELETION if deletion >> c - 1 & 1 else INSERTION

    def worth(self, r: int, c: int) -> int:
        """What a diagonal move into a cell gains."""
        return 1 if self.ref[r - 1] == self.hyp[c - 1] else -1


def _trace(table: _Table | _Bits, end: tuple[int, int], score: int) -> list[Step]:
    out: list[Step] = []
    r, c = end
    while (c > 0) if table.whole_hyp else (score >= 0):
        code = table.move(r, c)
        if code == DIAGONAL:
            to, cost = (r - 1, c - 1), table.worth(r, c)
        elif code == DELETION:
            to, cost = (r - 1, c), table.scores.deletion
        elif code == INSERTION:
            to, cost = (r, c - 1), table.scores.insertion
        else:
            to, cost = (0, 0), 0
        if to == (0, 0):
            if score != 0:
                out.append(Step(*to, r, c))
            break
        out.append(Step(*to, r, c))
        r, c = to
        score -= cost
    return out[::-1]
