"""Language identification by multinomial naive Bayes over hashed n-grams.

Runs of one to three letters (anything else counts as one blank) are hashed to
BUCKETS columns.  The log-probability matrix is as wide as the languages and as
long as the buckets, MATRIX_CELLS at most whatever the corpus, and is broadcast.
A batch of texts is scored at once: for each length of n-gram it is a sparse
matrix, a row for each text with the columns of its n-grams, whose product with
the log-probabilities is a sum over each row's stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import texts

BUCKETS = 1 << 15
#: Labelled documents whose whole texts are counted, at most (least id hash).
TRAIN_DOCS = 20_000
#: Characters scored at once; a longer text is summed part by part, each n-gram in the part it starts in.
PART_CHARS = 400_000
#: Cells of the matrix at most; with more languages than these allow, columns are folded.
MATRIX_CELLS = 1 << 26
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_letter: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; every run of other characters is one 32."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[points]
    points = np.where(letters, points, 32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    return points[keep]


def gram_buckets(points: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each place, for n = 1, 2, 3."""
    out, total = [], np.zeros(len(points), np.uint32)
    for n, multiplier in enumerate(_MULTIPLIERS):
        if len(points) <= n:
            break
        total = total[: len(points) - n] * np.uint32(31) + points[n:].astype(np.uint32) * np.uint32(multiplier)
        mixed = total ^ (total >> np.uint32(15))
        mixed = mixed * np.uint32(0x2C1B3C6D)
        out.append(((mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int64))
    return out


class SparseRows:
    """Rows of texts (or of parts of one) with the columns of their n-grams, for each n."""

    def __init__(self, rows: list[tuple[int, np.ndarray, int]]):
        """``rows``: the text's number, its code points, and at how many of these n-grams may start."""
        self.texts = np.array([i for i, _, _ in rows], np.int64)
        points = np.concatenate([p for _, p, _ in rows]) if rows else np.empty(0, np.uint32)
        lengths = np.array([len(p) for _, p, _ in rows], np.int64)
        starts, most = np.cumsum(lengths) - lengths, np.array([m for _, _, m in rows], np.int64)
        self.columns: list[np.ndarray] = []
        self.pointers: list[np.ndarray] = []
        for n, buckets in enumerate(gram_buckets(points), 1):
            count = np.clip(lengths - n + 1, 0, most)
            ends = np.cumsum(count)
            self.columns.append(buckets[np.repeat(starts - (ends - count), count) + np.arange(count.sum())])
            self.pointers.append(np.concatenate([[0], ends]))

    def times(self, matrix: np.ndarray, texts: int) -> np.ndarray:
        """The product with ``matrix``, a row for each of ``texts``; columns are folded to its length."""
        out = np.zeros((texts, matrix.shape[1]))
        for columns, pointers in zip(self.columns, self.pointers):
            full = np.flatnonzero(np.diff(pointers))
            if len(full):
                sums = np.add.reduceat(matrix.take(columns % len(matrix), axis=0), pointers[:-1][full], axis=0, dtype=np.float64)
                np.add.at(out, self.texts[full], sums)
        return out


def sparse_batches(points: list[np.ndarray], most: int) -> Iterator[SparseRows]:
    """The texts as sparse rows, some ``most`` characters at a time."""
    rows: list[tuple[int, np.ndarray, int]] = []
    held = 0
    for i, whole in enumerate(points):
        for lo in range(0, len(whole), most):
            rows.append((i, whole[lo : lo + most + 2], most))
            held += len(rows[-1][1])
            if held >= most:
                yield SparseRows(rows)
                rows, held = [], 0
    if rows:
        yield SparseRows(rows)


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                by_lang.setdefault(lang, []).append(code_points(text))
            for lang, points in by_lang.items():
                have = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for rows in sparse_batches(points, most):
                    for columns in rows.columns:
                        have += np.bincount(columns, minlength=BUCKETS)
        for lang, have in counts.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(have[at])], ["lang", "bucket", "n"])

    return run


class NaiveBayes:
    def __init__(self, langs: list[str], counts: np.ndarray, documents: np.ndarray):
        """``counts``: buckets x languages; add-half smoothing."""
        self.langs = langs
        smooth = counts + 0.5
        self.matrix = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.prior = np.log(documents / documents.sum())

    def scores(self, batch: list[str], most: int = PART_CHARS) -> np.ndarray:
        """Posterior of each language for each text; a row of zeros for a text without letters."""
        points = [code_points(text) for text in batch]
        total = np.tile(self.prior, (len(batch), 1))
        for rows in sparse_batches(points, most):
            total += rows.times(self.matrix, len(batch))
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        odds[[not len(p) for p in points]] = 0
        return odds


def fit_languages(docs: DataFrame, most: int = TRAIN_DOCS) -> NaiveBayes | None:
    """Learn from at most ``most`` documents with a language and text, none held out."""
    rank = F.xxhash64("doc_id", F.lit(17))
    known = docs.where("lang is not null and text is not null").where(~_held_out())
    last = known.select(rank.alias("rank")).orderBy("rank").limit(most).agg(F.max("rank")).first()[0]
    if last is None:
        return None
    sample = known.where(rank <= F.lit(last))
    sums = sample.select("lang", "text").mapInArrow(_count(PART_CHARS), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    langs, length = sorted(sizes), BUCKETS
    while length * len(langs) > MATRIX_CELLS:
        length //= 2
    counts = np.zeros((length, len(langs)))
    column = {lang: i for i, lang in enumerate(langs)}
    np.add.at(counts, (sums.column("bucket").to_numpy() % length, [column[x] for x in sums.column("lang").to_pylist()]), sums.column("n").to_numpy())
    return NaiveBayes(langs, counts, np.array([sizes[x] for x in langs], float))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    Learns from doc_id, text and lang, predicts from text alone.  A null text
    or one without a letter is ``und`` with score 0, as is every row if no
    document has a language.  Ties go to the language first in the alphabet.
    Very long texts are read whole, in parts.  Runs Spark jobs before it returns.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit_languages(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                if model is None:
                    langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                else:
                    posterior = model.scores([t or "" for t in texts(batch)])
                    best, scores = posterior.argmax(axis=1).tolist(), posterior.max(axis=1)
                    langs = [model.langs[i] if score else UNKNOWN for i, score in zip(best, scores.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
