"""Line dedup: lines that many documents share go from all of them.

Lines are exploded, normalised and hashed; distinct documents are counted for
each hash; lines over the threshold are dropped and the rest is put together
again by position.  DataFrame functions only.

Only hashes and positions are exploded and shuffled, never lines: they are
written once, counted and joined.  What comes back to a document is the set of
positions to drop, so its text is moved once, as one row.  A line that a third
of all documents share is combined before the count's shuffle, spread over
documents in the distinct step, and met in a join of freshly read tables, which
Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialised
from .textops import free_name

#: Fixed values of the contract: what is stripped, and the letters that are lower-cased.
_SPACE = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line as it is compared: stripped of white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _hashes(*values: Column) -> tuple[Column, Column]:
    """128 bits, as two hashes with seeds of their own."""
    return F.xxhash64(F.lit(41), *values), F.xxhash64(F.lit(43), *values)


def _row() -> tuple[Column, Column]:
    """What tells documents apart: a null id or text is like nothing else."""
    return _hashes(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)


def shared_positions(docs: DataFrame, documents: int = 10, least: int = 1) -> DataFrame:
    """(r1, r2, gone): for each document with shared lines their positions, from 0.

    Reads doc_id and text.  Keys of ``least`` code points or more that are found
    in ``documents`` documents or more are shared.  Rows equal in id and text
    are one document.
    """
    r1, r2 = _row()
    lines = docs.select(r1.alias("r1"), r2.alias("r2"), F.posexplode(_lines()).alias("pos", "line"))
    keyed = lines.select("r1", "r2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    h1, h2 = _hashes(F.col("key"))
    hashed = materialised(keyed.select("r1", "r2", "pos", h1.alias("h1"), h2.alias("h2")))
    holders = hashed.groupBy("h1", "h2", "r1", "r2").agg(F.lit(1).alias("one"))
    often = materialised(holders.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("h1", "h2"))
    gone = hashed.join(often, ["h1", "h2"]).groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))
    out = materialised(gone)
    drop(hashed, often)
    return out


def dedup_lines(docs: DataFrame, documents: int = 10, least: int = 1) -> DataFrame:
    """All columns of ``docs`` and all its rows, ``text`` without the lines that are shared, and two more: n_lines, n_dropped.

    ``text`` is cut at every line feed; a null or empty text is one empty line,
    and a null text becomes an empty one.  An empty key is dropped only where
    ``least`` is 0.  Rows that repeat both id and text count as one document
    and stay, all alike.  An id may be null or repeat with other texts: those
    are documents of their own.  Columns named like the new ones stay, and the
    new ones get an underscore.  An empty table gives an empty one.  Runs Spark
    jobs before it returns.
    """
    names = docs.columns
    n_lines = free_name(names, "n_lines")
    n_dropped = free_name([*names, n_lines], "n_dropped")
    r1, r2, lines, gone = (free_name(names, c) for c in ("_r1", "_r2", "_lines", "_gone"))
    k1, k2 = _row()
    marked = docs.withColumns({r1: k1, r2: k2, lines: _lines()}).drop("text")
    found = shared_positions(docs, documents, least).select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("gone").alias(gone))
    joined = marked.join(found, [r1, r2], "left")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.transform(F.array_except(places, F.col(gone)), lambda at: F.get(F.col(lines), at))
    kept = F.array_join(F.when(F.col(gone).isNull(), F.col(lines)).otherwise(left), "\n")
    done = joined.withColumns({"text": kept, n_lines: F.size(lines).cast("long"), n_dropped: F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")})
    return done.select(*[F.col(f"`{c}`") for c in names], n_lines, n_dropped)


def dedup_digests(docs: DataFrame, documents: int = 10, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of :func:`dedup_lines`, for every row."""
    out = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), documents, least)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
