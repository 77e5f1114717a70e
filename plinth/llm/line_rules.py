"""Quality rules by cross-document line frequency.

Lines are normalised and hashed.  For each host (a document's ``source``) the
distinct documents that hold a line are counted; exact copies of a text are
one document here.  Lines in more documents than the limit are boilerplate and
go; a document is rejected if too little of it is left.  Counts are combined
before they are shuffled and are keyed by host and line, so a hot host is
spread; the join that marks the lines is one Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialised
from .textops import HashCache, list_array, texts, window_hashes, word_hashes

#: A line is boilerplate in more documents of its host than both of these.
LEAST_DOCUMENTS, SHARE_OF_HOST = 20, 0.02
#: Words, and share of the words, that must be left.
LEAST_WORDS, LEAST_SHARE = 10, 0.3
#: Fixed values of the contract.
_SPACE, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
_REPEAT_WORDS = 8


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = HashCache()
    for batch in batches:
        numbers: list[list[int]] = [[], [], [], [], []]
        hashes, sizes = [], []
        for text in texts(batch):
            text = text or ""
            words: list[bytes] = []
            marks, counts, seen, repeated = [], [], set(), 0
            for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                own = line.split()
                if not own:
                    continue
                words += own
                repeated += line in seen
                seen.add(line)
                marks.append(xxhash.xxh3_64_intdigest(b" ".join(own).lower()))
                counts.append(len(own))
            row = (
                len(words),
                len(text) - sum(map(text.count, _SPACE)),
                sum(map(text.count, _SYMBOLS)),
                repeated,
                _repeat_words(words, cache),
            )
            for col, x in zip(numbers, row):
                col.append(x)
            hashes.append(np.array(marks, np.uint64).view(np.int64))
            sizes.append(np.array(counts, np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "source", "content")] + [pa.array(c, pa.int64()) for c in numbers] + [list_array(hashes, pa.int64()), list_array(sizes, pa.int32())],
            ["doc_id", "source", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sizes"],
        )


def _repeat_words(words: list[bytes], cache: HashCache) -> int:
    if len(words) <= _REPEAT_WORDS:
        return 0
    _, back, count = np.unique(window_hashes(word_hashes(words, cache), _REPEAT_WORDS), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + _REPEAT_WORDS] -= 1
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def line_rules(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE_OF_HOST) -> DataFrame:
    """doc_id, the base figures, base_failed, n_line_words, kept, for every row.

    Reads doc_id, text and source.  Null and empty texts have no words and fail
    the base rules.  A null source is a host of its own.  Rows are told apart
    by all they hold, so ids may be null or repeat; equal rows get equal
    verdicts.  ``n_line_words`` counts the words in boilerplate lines.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    measured = plain.select("doc_id", "source", F.xxhash64("text", F.lit(3)).alias("content"), "text").mapInArrow(
        _measure,
        "doc_id long, source string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, sizes array<int>",
    )
    measured = materialised(measured)
    distinct = measured.groupBy("source", "content").agg(F.first("lines").alias("lines"))
    distinct = materialised(distinct.select("source", F.array_distinct("lines").alias("lines")))
    hosts = distinct.groupBy("source").agg(F.count("*").alias("documents"))
    often = distinct.select("source", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_documents)
    often = materialised(often.join(hosts, "source").where(F.col("n") > share * F.col("documents")).select("source", "line"))
    keyed = measured.select(F.xxhash64("doc_id", "source", "content").alias("key"), "source", F.explode(F.arrays_zip("lines", "sizes")).alias("z"))
    cut = keyed.select("key", "source", F.col("z.lines").alias("line"), F.col("z.sizes").alias("words")).join(often, ["source", "line"])
    # equal rows share a key: each holds its part of the sum
    cut = materialised(cut.groupBy("key").agg(F.sum("words").alias("cut")))
    same = measured.withColumn("key", F.xxhash64("doc_id", "source", "content")).drop("lines", "sizes")
    copies = same.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    out = same.join(cut, "key", "left").join(materialised(copies), "key", "left")
    lost = (F.coalesce("cut", F.lit(0)) / F.coalesce("copies", F.lit(1))).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    out = out.withColumn("n_line_words", lost).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", kept.alias("kept"))
