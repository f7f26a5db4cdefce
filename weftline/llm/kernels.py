"""Vectorised text kernels on UTF-8 bytes: word spans, fingerprints, winnowing. No Spark here.

Texts come as Arrow string arrays; every kernel works on slices of whole
texts of about SLICE bytes, so memory is bounded by the longest single text.
Fingerprints are polynomial sums modulo 2**64 with random byte values,
finished by a bit mixer; two of them with different bases make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Texts of a slice, so that a text's index in it fits into 12 bits.
SLICE_TEXTS = 4096

U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

_every = np.arange(256)
#: Words of the whitespace kind: [^\x20\x09-\x0D]+ ; bytes of multi-byte characters count as word bytes.
NON_SPACE = ~((_every == 0x20) | ((_every >= 0x09) & (_every <= 0x0D)))
#: Words of the letter-and-digit kind: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
ALNUM = ((_every >= 0x30) & (_every <= 0x39)) | ((_every >= 0x61) & (_every <= 0x7A)) | ((_every >= 0x41) & (_every <= 0x5A)) | (_every >= 0x80)
#: Lower-casing of A-Z alone.
LOWER = np.where((_every >= 0x41) & (_every <= 0x5A), _every + 32, _every).astype(np.uint8)

_FOLDED_VALUES = _BYTE_VALUES[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 4096)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = U(self.inverse)
            self.down = np.cumprod(steps)
        return self.up, self.down


_POWERS = tuple(Powers(b) for b in _BASES)


class Prefix:
    """Fingerprints of any run of a sequence of 64-bit values in O(1) each."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = _POWERS[which].to(len(values) + 1)
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The fingerprint of each k-gram of the whole sequence."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U(k))


class Texts:
    """A slice of whole texts: bytes, text offsets, index of its first text in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text indexes of the words; kind: which bytes belong to words."""
        data, offsets = self.data, self.offsets
        if not len(data):
            empty = np.empty(0, np.int64)
            return empty, empty, empty
        inside = kind[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(offsets, starts, side="right") - 1

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
        values = (_FOLDED_VALUES if fold else _BYTE_VALUES)[self.data]
        return Prefix(values).runs(starts, ends)

    def byte_values(self) -> np.ndarray:
        return _BYTE_VALUES[self.data]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """A string column as slices of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        assert (np.diff(offsets) == lengths).all()
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + SLICE_TEXTS, len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def word_counts(texts: Texts, of_text: np.ndarray) -> np.ndarray:
    return np.bincount(of_text, minlength=len(texts)).astype(np.int64)


def window_minimum(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash in each window of that width, the leftmost of equals.

    The order uses the high bits of a hash, then the position; both depend on
    the window's content alone, so equal windows choose the same position.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bits = max(1, int(len(hashes)).bit_length())
    low = U((1 << bits) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[:n], best[width - have : width - have + n])
    return (best[:n] & low).astype(np.int64)


def winnow(hashes: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of windows of `width` hashes: anchor position, first owned window, number of owned windows.

    valid: which window starts lie in one text. Every valid window is owned by
    exactly one anchor, chosen by the window's own content; the windows of an
    anchor are consecutive.
    """
    least = window_minimum(hashes, width)
    starts = np.flatnonzero(valid[: len(least)])
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    anchors = least[starts]
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return anchors[at], starts[at], np.diff(np.append(at, len(starts)))


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the positions 0..length-1 lie in one of the ranges."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
