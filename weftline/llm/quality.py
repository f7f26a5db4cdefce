"""Quality rules by line sequence labelling with a linear-chain conditional random field.

Each line with a word gets features of its bytes and words; Viterbi decoding
of a two-label chain marks it content or boilerplate, and the share of words
in content lines decides whether the document stays.

Only documents are labelled, so the labels of lines are latent. Training
alternates: given weights, the lines of each labelled document get the
marginals of its chain, tilted by one number for the document so that at least
LEAST_SHARE of its words are expected in lines of its own label (content in
good ones, boilerplate in bad ones); given these, gradient ascent fits emission
and transition weights to the expected counts. It starts from lines that all
carry their document's label, without transitions. A junk document may thus
keep lines of prose, and a good one a line of boilerplate. The sample is
bounded: SAMPLE_DOCS documents of each label, each of at most SAMPLE_BYTES.
Without labels of both kinds the weights are DEFAULT_WEIGHTS.

Base rules come first: a document of under MIN_WORDS words, or of which more
than half of the words lie in 3-word windows that the text repeats, fails.

Edge cases: null and empty texts have no words, count zero everywhere and fail
the base rules; a text without line breaks is one line; very long texts are
read and labelled whole; repeated rows get equal results; null labels are no
labels; an empty table gives an empty result; columns of the input that have
the name of a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import append_columns
from weftline.llm.kernels import NON_SPACE, Prefix, Texts, U, covered, mix, slices

MIN_WORDS = 50
SAMPLE_DOCS = 400
SAMPLE_BYTES = 20_000
CONTENT_SHARE = 0.5
#: Share of a labelled document's words that training expects in lines of its own label, at least.
LEAST_SHARE = 0.6
#: How often the labels of the training lines are estimated anew.
ROUNDS = 6
FEATURES = ("bias", "symbols", "exclaims", "capitals", "same_word", "bars", "short", "sentence_end", "repeated_line", "digits")
#: Emission weights of the label content, then the transition weight of keeping the label.
DEFAULT_WEIGHTS = (2.0, -20.0, -20.0, -4.0, -6.0, -6.0, 0.0, 0.5, -1.0, 0.0, 1.0)
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double"

_every = np.arange(256)
_SYMBOL = np.isin(_every, [ord(c) for c in "#*$%&|<>"])
_CAPITAL = (_every >= 0x41) & (_every <= 0x5A)
_LETTER = _CAPITAL | ((_every >= 0x61) & (_every <= 0x7A)) | (_every >= 0xC0)
_DIGIT = (_every >= 0x30) & (_every <= 0x39)
_START = (_every & 0xC0) != 0x80


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of true flags between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[bounds])


class Lines:
    """Words and lines of a slice of texts; lines: those with a word."""

    def __init__(self, texts: Texts):
        data, offsets = texts.data, texts.offsets
        self.starts, self.ends, self.of = texts.words(NON_SPACE)
        self.bounds = np.searchsorted(self.of, np.arange(len(texts) + 1))
        self.hashes = texts.word_hashes(self.starts, self.ends, fold=False)
        breaks = np.flatnonzero(data == 0x0A)
        begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        begins = begins[begins < len(data)]
        stops = np.append(begins[1:], len(data))
        stops = stops - (data[stops - 1] == 0x0A) if len(data) else stops
        n = np.bincount(np.searchsorted(begins, self.starts, side="right") - 1, minlength=len(begins)) if len(begins) else np.empty(0, int)
        has = n > 0
        self.line_starts, self.line_ends, self.line_words = begins[has], stops[has], n[has]
        self.line_of = np.searchsorted(offsets, self.line_starts, side="right") - 1
        self.line_bounds = np.searchsorted(self.line_of, np.arange(len(texts) + 1))
        names = Prefix(texts.byte_values()).runs(self.line_starts, self.line_ends)
        keys = mix(names + self.line_of.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        self.again = np.ones(len(keys), bool)
        self.again[np.unique(keys, return_index=True)[1]] = False

    def features(self, texts: Texts) -> np.ndarray:
        if not len(self.line_starts):
            return np.empty((0, len(FEATURES)))
        data = texts.data
        edges = np.stack([self.line_starts, self.line_ends], 1).ravel()

        def count(table: np.ndarray) -> np.ndarray:
            return _sums(table[data], edges)[::2].astype(float)

        size = (self.line_ends - self.line_starts).astype(float)
        words = self.line_words.astype(float)
        same = np.zeros(len(self.hashes), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.of[1:] == self.of[:-1])
        first = np.searchsorted(self.starts, self.line_starts)
        same_in = np.diff(np.concatenate([[0], np.cumsum(same)])[np.append(first, len(same))])
        tail = data[self.ends[first + self.line_words - 1] - 1]
        letters = count(_LETTER)
        return np.stack(
            [
                np.ones(len(size)),
                count(_SYMBOL) / size,
                count(_every == ord("!")) / size,
                np.where(letters >= 4, count(_CAPITAL) / np.maximum(letters, 1), 0),
                same_in / words,
                np.minimum(count(_every == ord("|")) / words, 1),
                (words <= 3).astype(float),
                np.isin(tail, [ord(c) for c in ".?!"]).astype(float),
                self.again.astype(float),
                count(_DIGIT) / size,
            ],
            1,
        )


def viterbi(scores: np.ndarray, stay: float) -> np.ndarray:
    """Best labels (1: content) of one chain; scores: of content over boilerplate; stay: of keeping a label."""
    content, other = 0.0, 0.0
    from_content = np.empty((len(scores), 2), bool)
    for i, s in enumerate(scores.tolist()):
        if i:
            from_content[i, 1] = content + stay >= other
            from_content[i, 0] = content > other + stay
            content, other = (content + stay if from_content[i, 1] else other), (content if from_content[i, 0] else other + stay)
        content += s
    labels = np.empty(len(scores), bool)
    at = content >= other
    for i in range(len(scores) - 1, -1, -1):
        labels[i] = at
        at = from_content[i, int(at)]
    return labels


def marginals(scores: np.ndarray, stay: float, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many chains, one a column: the chance of content of each line, and of one label for a line and the next.

    there: which lines exist; chains start at the first row.
    """
    forward, backward = np.zeros((*scores.shape, 2)), np.zeros((*scores.shape, 2))
    for i in range(len(scores)):
        if i:
            a, b = forward[i - 1, :, 0], forward[i - 1, :, 1]
            forward[i] = np.stack([np.logaddexp(a + stay, b), np.logaddexp(a, b + stay)], 1)
        forward[i, :, 1] += scores[i]
    for i in range(len(scores) - 2, -1, -1):
        a, b = backward[i + 1, :, 0], backward[i + 1, :, 1] + scores[i + 1]
        now = np.stack([np.logaddexp(a + stay, b), np.logaddexp(a, b + stay)], 1)
        backward[i] = np.where(there[i + 1][:, None], now, 0)
    total = forward + backward
    logz = np.logaddexp(total[..., 0], total[..., 1])
    content = np.where(there, np.exp(total[..., 1] - logz), 0)
    same = sum(np.exp(forward[:-1, :, k] + stay + backward[1:, :, k] + k * scores[1:] - logz[1:]) for k in (0, 1))
    return content, np.where(there[1:], same, 0)


def _tilted(scores: np.ndarray, stay: float, there: np.ndarray, words: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals under the least tilt that expects LEAST_SHARE of each chain's words in lines of its own label."""
    sign, all_words = np.where(good, 1.0, -1.0), words.sum(0)
    low, high = np.zeros(len(good)), np.zeros(len(good))

    def at(tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        content, same = marginals(scores + sign * tilt, stay, there)
        share = (content * words).sum(0) / all_words
        return content, same, np.where(good, share, 1 - share) >= LEAST_SHARE

    content, same, enough = at(low)
    high = np.where(enough, 0.0, 64.0)
    for _ in range(12):
        middle = (low + high) / 2
        content, same, enough = at(middle)
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return at(high)[:2]


def gradient(w: np.ndarray, x: np.ndarray, there: np.ndarray, content: np.ndarray, same: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts under the targets less those under the weights, each chain at its weight."""
    now, now_same = marginals(x @ w[:-1], w[-1], there)
    return np.append(np.einsum("ij,ijk->k", (content - now) * weight, x), ((same - now_same) * weight).sum())


def train(texts: list[str], good: list[bool], rounds: int = ROUNDS, steps: int = 60, rate: float = 0.2, ridge: float = 0.001) -> tuple[float, ...]:
    """Weights that fit the latent line labels of the documents, all chains in lockstep."""
    chains = []
    for part in slices(pa.array(texts, pa.string())):
        lines = Lines(part)
        x = lines.features(part)
        spans = [slice(lines.line_bounds[t], lines.line_bounds[t + 1]) for t in range(len(part))]
        chains += [(x[at], lines.line_words[at], good[part.first + t]) for t, at in enumerate(spans)]
    chains = sorted((c for c in chains if len(c[0])), key=lambda c: -len(c[0]))
    y = np.array([g for *_, g in chains], bool)
    if not y.any() or y.all():
        return DEFAULT_WEIGHTS
    longest, n = len(chains[0][0]), len(chains)
    x, words, there = np.zeros((longest, n, len(FEATURES))), np.zeros((longest, n)), np.zeros((longest, n), bool)
    for k, (f, count, _) in enumerate(chains):
        x[: len(f), k], words[: len(f), k], there[: len(f), k] = f, count, True
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) / there.sum(0)
    content, same = np.where(there, y, 0.0), np.where(there[1:], 0.5, 0.0)
    w = np.zeros(len(FEATURES) + 1)
    for turn in range(rounds):
        if turn:
            content, same = _tilted(x @ w[:-1], w[-1], there, words, y)
        m, v = 0.0, 0.0
        for step in range(1, steps + 1):
            change = gradient(w, x, there, content, same, weight) - ridge * w
            m, v = 0.9 * m + 0.1 * change, 0.999 * v + 0.001 * change**2
            w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tuple(float(k) for k in w)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE_DOCS, longest: int = SAMPLE_BYTES) -> tuple[float, ...]:
    """Weights from at most `sample` documents of each label, the first in an order by hash of the id."""
    ranked = labels.filter(F.col(quality).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(quality).alias("q"))
    both = [ranked.filter(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(both[0].unionByName(both[1]))  # at most 2 * sample rows
    found = docs.join(chosen, F.col(doc_id) == F.col("id")).filter(F.octet_length(text) <= longest)
    rows = found.select("id", text, "q").orderBy("id", F.xxhash64(text)).limit(2 * sample).collect()
    return train([r[1] for r in rows], [r["q"] == 1 for r in rows])


def measure(docs: DataFrame, weights: tuple[float, ...], text: str = "text") -> DataFrame:
    """The documents with the counts of the base rules and content_share: of words, those in content lines."""
    emission, stay = np.array(weights[:-1]), float(weights[-1])

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        lines, data, offsets = Lines(texts), texts.data, texts.offsets
        scores = lines.features(texts) @ emission
        n_words = np.diff(lines.bounds).astype(np.int64)
        share = np.zeros(len(texts))
        for t in range(len(texts)):
            lo, hi = lines.line_bounds[t], lines.line_bounds[t + 1]
            if hi > lo:
                share[t] = lines.line_words[lo:hi][viterbi(scores[lo:hi], stay)].sum() / n_words[t]
        repeats = np.zeros(len(lines.hashes), bool)
        grams = Prefix(lines.hashes).grams(3)
        inside = np.flatnonzero(lines.of[: len(grams)] == lines.of[2:][: len(grams)])
        if len(inside):
            keys = mix(grams[inside] + lines.of[inside].astype(np.uint64) * U(0x9E3779B97F4A7C15))
            _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
            twice = inside[counts[which] > 1]
            repeats = covered(len(lines.hashes), twice, twice + 3)
        return {
            "n_words": n_words,
            "word_chars": _sums(NON_SPACE[data] & _START[data], offsets),
            "n_symbols": _sums(_SYMBOL[data], offsets),
            "n_dup_lines": _sums(lines.again, lines.line_bounds),
            "n_repeat_words": _sums(repeats, lines.bounds),
            "content_share": share,
        }

    return append_columns(docs, text, kernel, COLUMNS)


def verdicts(measured: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Digest columns base_failed and kept beside those of measure()."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= content_share))
