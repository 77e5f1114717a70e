"""Substring dedup with repeated-phrase automata.

A window of ``size`` words is repeated if its word sequence starts anywhere
else.  Every window holds exactly one *anchor*: the phrase of ANCHOR words
with the least hash in it, the leftmost of equals.  Equal windows have equal anchors, so only windows round
anchors that occur twice can repeat; that leaves a tenth of the words to count.

1. Anchors are counted over all texts, equal texts as two (map-side combined).
2. All texts are streamed again; each hands on its stretches of windows with a
   recurring anchor, packed into shards of some SHARD_WINDOWS windows as they
   come.  Nothing is dealt by anchor, so no phrase is crowded, however often it
   occurs; a window outside the stretches cannot repeat.
3. A shard sends each of its distinct windows, as a 128-bit hash, to a bucket
   of hashes, twice if it holds it twice.  The bucket confirms, with one bit a
   window, what occurs more than once in all.
4. A shard compiles its confirmed passages, runs of repeated windows, into an
   Aho-Corasick automaton over word numbers and streams its stretches through it
   to locate every occurrence.
5. The located word ranges go back to their texts, to all copies of each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialised
from .textops import HashCache, as_signed, free_name, list_array, mix, texts, window_hashes, word_hashes, words_of

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of an anchor; the shorter, the fewer anchors and the more chance repeats.
ANCHOR = 12
#: Windows of a shard, and windows a bucket of their hashes is meant to hold.
SHARD_WINDOWS, BUCKET_WINDOWS = 40_000, 400_000


def anchors(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, position, first window, windows) for each anchor of a text."""
    grams = window_hashes(hashes, ANCHOR)
    span = size - ANCHOR + 1
    if len(grams) < span:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    # the leftmost least gram of every window, by a sparse table of minima
    at = np.arange(len(grams))
    width = 1
    while width * 2 <= span:
        a, b = at[:-width], at[width:]
        at = np.where(grams[b] < grams[a], b, a)
        width *= 2
    n, rest = len(grams) - span + 1, span - width
    a, b = at[:n], at[rest : rest + n]
    least = np.where(grams[b] < grams[a], b, a)
    first = np.flatnonzero(np.diff(least, prepend=-1))
    where = least[first]
    return grams[where], where, first, np.diff(first, append=n)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            found = [as_signed(anchors(word_hashes(words_of(t), cache), size)[0]) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), list_array(found, pa.int64())], ["key", "row", "anchors"])

    return run


def stretches(text: str | None, want: np.ndarray, size: int, most: int, cache: HashCache) -> Iterator[tuple[int, list[bytes]]]:
    """(first word, words) of the runs of windows whose anchors are wanted; runs of more than ``most`` windows in parts."""
    words = words_of(text)
    grams, _, first, count = anchors(word_hashes(words, cache), size)
    here = np.zeros(len(words) + 1, np.int8)
    inside = np.isin(as_signed(grams), want)
    here[first[inside]] += 1
    here[(first + count)[inside]] -= 1
    edge = np.diff(np.cumsum(here) > 0, prepend=False)
    for a, b in np.flatnonzero(edge).reshape(-1, 2).tolist():
        for lo in range(a, b, most):
            yield lo, words[lo : min(b, lo + most) + size - 1]


_SHARD = "shard long, keys array<binary>, copies array<int>, starts array<int>, words binary"


def _shards(size: int):
    """Stretches, packed: a row has their texts' keys and copies, first words, and words (a line each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        number = TaskContext.get().partitionId() << 36
        held: list[list] = [[], [], [], []]
        windows = 0

        def packed() -> pa.RecordBatch:
            kinds = [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = [pa.array([number], pa.int64()), *[pa.array([x], k) for x, k in zip(held, kinds)], pa.array([b"\n".join(held[3])], pa.binary())]
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays(columns, ["shard", "keys", "copies", "starts", "words"])

        for batch in batches:
            for key, copies, text, want in zip(batch.column("key").to_pylist(), batch.column("copies").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                for start, words in stretches(text, np.array(want, np.int64), size, SHARD_WINDOWS, cache):
                    for column, x in zip(held, (key, copies, start, b" ".join(words))):
                        column.append(x)
                    windows += len(words) - size + 1
                    if windows >= SHARD_WINDOWS:
                        yield packed()
                        number, windows = number + 1, 0
        if held[0]:
            yield packed()

    return run


class Shard:
    """A shard's words in a row, and its distinct windows in the order of their buckets."""

    def __init__(self, packed: bytes, copies: list[int], size: int, buckets: int, cache: HashCache):
        self.stretches = [line.split(b" ") for line in packed.split(b"\n")]
        lengths = np.array([len(x) for x in self.stretches], np.int64)
        self.ends = np.cumsum(lengths)
        hashes = word_hashes([w for x in self.stretches for w in x], cache)
        # a window lies within one stretch
        sound = np.ones(len(hashes) + 1, bool)
        tail = (self.ends[:, None] - np.arange(1, size)[None, :]).ravel()
        sound[tail] = False
        self.at = np.flatnonzero(sound[: len(hashes)])
        one, two = (window_hashes(h, size)[self.at] for h in (hashes, mix(hashes ^ np.uint64(0xA0761D6478BD642F))))
        bucket = (one % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((two, one, bucket))
        one, two, bucket = one[order], two[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        weight = np.array(copies, np.int64)[np.searchsorted(self.ends, self.at, side="right")]
        self.often = np.bincount(self.number, weight, new.sum()) > 1
        self.hashes = np.column_stack([one[new], two[new]])
        self.bucket = bucket[new]

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            yield int(self.bucket[a]), slice(a, b)

    def runs(self, repeated: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
        """For each stretch the word ranges of its passages: runs of windows that are marked as repeated."""
        mark = np.zeros(int(self.ends[-1]) + 2, np.int8)
        mark[self.at[repeated[self.number]] + 1] = 1
        edge = np.flatnonzero(np.diff(mark)).reshape(-1, 2)
        out: list[list[tuple[int, int]]] = [[] for _ in self.stretches]
        begin = np.concatenate([[0], self.ends])
        for i, a, b in zip(np.searchsorted(self.ends, edge[:, 0], side="right").tolist(), edge[:, 0].tolist(), edge[:, 1].tolist()):
            out[i].append((a - int(begin[i]), b - int(begin[i]) + size - 1))
        return out


def _deal(size: int, buckets: int):
    """A shard's distinct windows by hash, each once, with a mark if the shard itself shows it repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for number, copies, words in zip(*[batch.column(c).to_pylist() for c in ("shard", "copies", "words")]):
                shard = Shard(words, copies, size, buckets, cache)
                rows = [(bucket, shard.hashes[part].tobytes(), np.packbits(shard.often[part]).tobytes()) for bucket, part in shard.by_bucket()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([number] * len(rows), pa.int64()), *columns[1:]], ["bucket", "shard", "hashes", "often"])

    return run


def _confirm(table: pa.Table) -> pa.Table:
    """For every shard of a bucket, a bit for each of its windows: whether it occurs more than once in all."""
    parts = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("hashes").to_pylist()]
    sizes = [len(x) for x in parts]
    often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("often").to_pylist(), sizes)])
    hashes = np.concatenate(parts)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    hashes, often = hashes[order], often[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]).any(axis=1)
    window = np.cumsum(new) - 1
    known = np.empty(len(order), bool)
    known[order] = (np.bincount(window, 1 + often) > 1)[window]
    bits = [np.packbits(x).tobytes() for x in np.split(known, np.cumsum(sizes)[:-1])]
    return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _locate(size: int, buckets: int):
    """Word ranges (key, a, b) that the shards' confirmed passages cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for keys, copies, starts, words, answers in zip(*[batch.column(c).to_pylist() for c in ("keys", "copies", "starts", "words", "answers")]):
                shard = Shard(words, copies, size, buckets, cache)
                told = {x["bucket"]: x["bits"] for x in answers}
                repeated = np.zeros(len(shard.hashes), bool)
                for bucket, part in shard.by_bucket():
                    repeated[part] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=part.stop - part.start)
                passages = PassageAutomaton()
                numbered = [passages.number(x) for x in shard.stretches]
                for stretch, runs in zip(numbered, shard.runs(repeated, size)):
                    for a, b in runs:
                        passages.add(stretch[a:b])
                passages.compile()
                found = [(key, start + a, start + b) for key, start, stretch in zip(keys, starts, numbered) for a, b in passages.locate(stretch)]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*found) if found else ([], [], []), (pa.binary(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "a", "b"])

    return run


class PassageAutomaton:
    """Aho-Corasick over word numbers, its keys being confirmed passages."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

    def number(self, words: list[bytes]) -> tuple[int, ...]:
        numbers = self.numbers
        return tuple([numbers.setdefault(w, len(numbers) + 1) for w in words])

    def add(self, passage: tuple[int, ...]) -> None:
        self.machine.add_word(passage, len(passage))

    def compile(self) -> None:
        if len(self.machine):
            self.machine.make_automaton()

    def locate(self, words: tuple[int, ...]) -> list[tuple[int, int]]:
        """Merged word ranges [from, to) that passages cover."""
        if not len(self.machine):
            return []
        out: list[tuple[int, int]] = []
        for end, length in self.machine.iter(words):
            a, b = end + 1 - length, end + 1
            while out and a <= out[-1][1]:
                a, b = min(a, out[-1][0]), max(b, out[-1][1])
                out.pop()
            out.append((a, b))
        return out


def _content(text: Column) -> Column:
    """What tells texts apart: 128 bits of their SHA-256; a null text is an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def repeated_ranges(docs: DataFrame, size: int = 35) -> DataFrame:
    """(key, ranges): for each text with repeated windows, the word ranges they cover.

    The key is the text's, see ``_content``.  Texts that occur more than once
    are looked at once, as two: all their windows are repeated, and their ranges
    hold for every copy.  Runs Spark jobs before it returns.
    """
    text = F.col("text").cast("string")
    # the row's own hash deals copies of one text to different tasks
    source = docs.select(_content(text).alias("key"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    found = source.mapInArrow(_count(size), "key binary, row long, anchors array<long>").where(F.size("anchors") > 0)
    contents = found.groupBy("key").agg(F.min("row").alias("row"), F.first("anchors").alias("anchors"), F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"))
    contents = materialised(contents)
    inside = contents.select(F.explode("anchors").alias("anchor"), "copies")
    recurring = materialised(inside.groupBy("anchor").agg(F.sum("copies").alias("occurs")).where("occurs > 1"))
    occurs = recurring.agg(F.sum("occurs")).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, occurs * (size - ANCHOR + 2) // 2 // BUCKET_WINDOWS)
    each = contents.select("key", "row", "copies", F.explode(F.array_distinct("anchors")).alias("anchor"))
    per_text = each.join(recurring.select("anchor"), "anchor").groupBy("row", "key", "copies").agg(F.collect_list("anchor").alias("wanted"))
    wanted = source.select("row", "text").hint("merge").join(per_text, "row")
    # texts that share a row hash by chance are told apart by content
    wanted = wanted.where(_content(F.col("text")) == F.col("key")).select("key", "copies", "text", "wanted")
    shards = materialised(wanted.mapInArrow(_shards(size), _SHARD))
    drop(contents, recurring)
    dealt = shards.select("shard", "copies", "words").mapInArrow(_deal(size, buckets), "bucket long, shard long, hashes binary, often binary")
    answers = dealt.groupBy("bucket").applyInArrow(_confirm, "shard long, bucket long, bits binary")
    answers = answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    ranges = shards.join(answers, "shard").mapInArrow(_locate(size, buckets), "key binary, a int, b int")
    out = materialised(ranges.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    drop(shards)
    return out


def cut_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated windows cut out of ``text``.

    A text that loses nothing stays as it is; of others the runs of kept words
    stay with their own white space, joined by a blank.  ``n_chars``, where there
    is one, counts the new text.  Null texts stay null.
    """
    columns = docs.columns
    key, found = free_name(columns, "key"), free_name(columns, "ranges")
    ranges = repeated_ranges(docs, size).withColumnsRenamed({"key": key, "ranges": found})
    # the hint keeps the plan the same whether few or many texts have ranges
    joined = docs.withColumn("text", F.col("text").cast("string")).withColumn(key, _content(F.col("text"))).hint("merge").join(ranges, key, "left").select(*columns, found)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = part.columns[: len(columns)]
                out[at] = pa.array([_cut(t, r) for t, r in zip(out[at].to_pylist(), part.column(found).to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays(out, columns)

    schema = joined.drop(found).schema
    out = joined.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out


def _cut(text: str | None, ranges: list | None) -> str | None:
    if not text or not ranges:
        return text
    _, keep = _kept(text, ranges)
    spans = [m.span() for m in _WORD.finditer(text)]
    edge = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
    return " ".join([text[spans[a][0] : spans[b - 1][1]] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])


def _kept(text: str | None, ranges: list | None) -> tuple[list[bytes], np.ndarray]:
    words = words_of(text)
    keep = np.ones(len(words), bool)
    if ranges:
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, [r["a"] for r in ranges], 1)
        np.add.at(edge, [r["b"] for r in ranges], -1)
        keep = np.cumsum(edge)[: len(words)] == 0
    return words, keep


def remove_repeats(docs: DataFrame, size: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``) of every row of ``docs``.

    Reads doc_id and text.  Null, empty and word-less texts have no words, and
    the digest of the empty string.  Texts shorter than ``size`` words keep all.
    Every occurrence of a repeated window goes, in the same document too;
    exact copies of ``size`` words or more go whole.  Results hang on the text
    alone, so ids may be null or repeat.
    """
    ranges = repeated_ranges(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cols: list[list] = [[], [], [], []]
                for text, found in zip(texts(part), part.column("ranges").to_pylist()):
                    words, keep = _kept(text, found)
                    left = b" ".join([w for w, k in zip(words, keep.tolist()) if k]) if not keep.all() else b" ".join(words)
                    for col, x in zip(cols, (len(words), int(len(words) - keep.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass") if with_text else None)):
                        col.append(x)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.withColumn("key", _content(F.col("text"))).hint("merge").join(ranges, "key", "left").select("doc_id", "text", "ranges")
    out = out.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
