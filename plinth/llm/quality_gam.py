"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, on the logistic
loss; a feature's trees add up to one lookup table over its bins (Lou et al.
2013, Nori et al. 2019).  The pairs of features that explain most of what is
left get tables over two features' bins in the same way.  A score is the sum of
one addition per table, vectorised over a batch, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import HashCache, list_array, texts, window_hashes, word_hashes, words_of

#: Labelled rows the model is fitted on, at most (those of least id hash).
TRAIN_ROWS = 20_000
FEATURES = [
    "log_words", "word_length", "distinct_words", "symbols", "upper", "exclamations", "pipes", "same_as_before", "repeat_windows",
    "repeat_lines", "digits", "no_letter_words", "stops", "words_a_line", "lines_that_end", "longest_word", "short_words", "same_case_words",
]


def features(text: str | None, cache: HashCache) -> np.ndarray:
    """Of the whole text alone; zeros for a text without words."""
    out = np.zeros(len(FEATURES), np.float32)
    words = words_of(text)
    n = len(words)
    if not n:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = lengths.sum()
    hashes = word_hashes(words, cache)
    upper, lower = byte[65:91].sum(), byte[97:123].sum()
    digits = byte[48:58].sum()
    symbols = sum(byte[ord(c)] for c in "#*$%&|<>")
    repeat = 0
    if n >= 8:
        _, back, count = np.unique(window_hashes(hashes, 8), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(count[back] > 1)
        edge[starts] += 1
        edge[starts + 8] -= 1
        repeat = (np.cumsum(edge)[:n] > 0).sum()
    lines = [x for x in text.split("\n") if not x.isspace() and x]
    out[:] = (
        np.log1p(n), chars / n, len(np.unique(hashes)) / n, symbols / chars, upper / max(1, upper + lower), byte[33] / n, byte[124] / n,
        (hashes[1:] == hashes[:-1]).sum() / n, repeat / n, 1 - len(set(lines)) / max(1, len(lines)), digits / chars,
        1 - min(n, upper + lower) / n, (byte[46] + byte[44] + byte[63]) / n, np.log1p(n / max(1, len(lines))),
        sum(x.rstrip()[-1:] in ".!?\"" for x in lines) / max(1, len(lines)), np.log(lengths.max()), (lengths <= 3).sum() / n,
        sum(w.isupper() for w in words) / n,
    )
    return out


class AdditiveModel:
    """Lookup tables over binned features and pairs of features."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 8, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15):
        self.most_bins, self.pair_bins, self.most_pairs = bins, pair_bins, pairs
        self.rounds, self.pair_rounds, self.rate = rounds, pair_rounds, rate
        self.base = 0.0
        self.tables: list[np.ndarray] = []
        self.pair_tables: dict[tuple[int, int], np.ndarray] = {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.most_bins + 1)[1:-1])) for f in range(d)]
        self.pair_edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.pair_bins + 1)[1:-1])) for f in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4) if n else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        if not n or y.min() == y.max():
            return self
        binned, coarse = self._bin(x, self.edges), self._bin(x, self.pair_edges)
        logit = np.full(n, self.base)
        for _ in range(self.rounds):
            for f in range(d):
                step = self._tree(binned[f], logit, y, len(self.tables[f]))
                self.tables[f] += step
                logit += step[binned[f]]
        self._add_pairs(coarse, logit, y)
        return self

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]

    @staticmethod
    def _gradients(logit: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    def _tree(self, bins: np.ndarray, logit: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
        """A tree of up to four leaves over one feature's bins, as a table."""
        g, h = self._gradients(logit, y)
        sg, sh = np.bincount(bins, g, size), np.bincount(bins, h, size)
        parts = [(0, size)]
        for _ in range(2):
            parts = [p for lo, hi in parts for p in self._split(sg, sh, lo, hi)]
        out = np.zeros(size)
        for lo, hi in parts:
            out[lo:hi] = self.rate * sg[lo:hi].sum() / (sh[lo:hi].sum() + 1.0)
        return out

    @staticmethod
    def _split(sg: np.ndarray, sh: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo < 2:
            return [(lo, hi)]
        lg, lh = np.cumsum(sg[lo:hi])[:-1], np.cumsum(sh[lo:hi])[:-1]
        rg, rh = sg[lo:hi].sum() - lg, sh[lo:hi].sum() - lh
        cut = lo + 1 + int(np.argmax(lg**2 / (lh + 1) + rg**2 / (rh + 1)))
        return [(lo, cut), (cut, hi)]

    def _corner(self, a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, shape: tuple[int, int]) -> tuple[float, np.ndarray]:
        """The best pair of cuts, one on each feature: its gain, and its table."""
        flat = a * shape[1] + b
        sg = np.bincount(flat, g, shape[0] * shape[1]).reshape(shape)
        sh = np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)
        if min(shape) < 2:
            return 0.0, np.zeros(shape)
        cg, ch = sg.cumsum(0).cumsum(1), sh.cumsum(0).cumsum(1)
        quads = []
        for c in (cg, ch):
            one = c[:-1, :-1]
            two, three = c[:-1, -1:] - one, c[-1:, :-1] - one
            quads.append((one, two, three, c[-1, -1] - one - two - three))
        gain = sum(q**2 / (w + 1) for q, w in zip(*quads))
        i, j = np.unravel_index(np.argmax(gain), gain.shape)
        value = [self.rate * q[i, j] / (w[i, j] + 1) for q, w in zip(*quads)]
        out = np.empty(shape)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
        return float(gain[i, j]), out

    def _add_pairs(self, coarse: list[np.ndarray], logit: np.ndarray, y: np.ndarray) -> None:
        shapes = [len(e) + 1 for e in self.pair_edges]
        g, h = self._gradients(logit, y)
        gains = [(self._corner(coarse[a], coarse[b], g, h, (shapes[a], shapes[b]))[0], a, b) for a, b in combinations(range(len(coarse)), 2)]
        chosen = [(a, b) for gain, a, b in sorted(gains, key=lambda x: (-x[0], x[1], x[2]))[: self.most_pairs] if gain > 0]
        self.pair_tables = {p: np.zeros((shapes[p[0]], shapes[p[1]])) for p in chosen}
        for _ in range(self.pair_rounds):
            for a, b in chosen:
                g, h = self._gradients(logit, y)
                _, step = self._corner(coarse[a], coarse[b], g, h, (shapes[a], shapes[b]))
                self.pair_tables[a, b] += step
                logit += step[coarse[a], coarse[b]]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for bins, table in zip(self._bin(x, self.edges), self.tables):
            logit += table[bins]
        coarse = self._bin(x, self.pair_edges)
        for (a, b), table in self.pair_tables.items():
            logit += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-logit))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labels that are not held out.

    The labels picked are a table of at most ``rows`` rows of two numbers,
    which is what is broadcast; only their documents' features are computed.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where("quality in (0, 1) and doc_id is not null").where(~_held_out())
    picked = marked.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            x = list_array([features(t, cache) for t in texts(batch)], pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), x], ["quality", "x"])

    known = _plain(docs).join(F.broadcast(picked), "doc_id").select("quality", "text")
    sample = known.mapInArrow(run, "quality int, x array<float>").toArrow()
    if not sample.num_rows:
        return AdditiveModel().fit(np.zeros((1, len(FEATURES)), np.float32), np.array([1.0]))
    x = np.array(sample.column("x").to_pylist(), np.float32)
    y = sample.column("quality").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the fit must not hang on the order rows arrive in
    return AdditiveModel().fit(x[order], y[order])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Reads doc_id and text of ``docs`` and doc_id and quality of ``labels``.
    Null and empty texts have zero features and get a score like others; labels
    other than 0 and 1, and ids without a document, are not learnt from;
    repeated labels count as often as they come.  Without any label every score
    is close to 1 and nothing is rejected.
    """
    model = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _scored(model, batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    plain = _plain(docs).select("doc_id", _held_out().alias("held_out"), "text")
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    model = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _scored(model, batches):
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _scored(model: AdditiveModel, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    cache = HashCache()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            yield part, model.score(np.array([features(t, cache) for t in texts(part)]))
