"""Cross-tokenizer alignment by byte-owner arrays.

A byte-level BPE (A) and a piece BPE (B) encode the same bytes.  Token numbers
are repeated over the bytes they own, once for A and once for B: consecutive
distinct pairs of owners are the overlapping tokens (links), and bytes where
both owners change are the cuts between groups.  A corpus-wide count of linked
id pairs says how good each link is.

The count is combined in batches, then by Spark.  Looking it up takes no
shuffle of all links: at most ``KEPT_PAIRS`` of the most frequent pairs are
broadcast, whatever the corpus, and only links of rarer pairs are shuffled to
their counts and added up by row.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .packing import TextIds
from .storage import drop, materialised

#: Most frequent pairs that are broadcast, at most: 12 MB.
KEPT_PAIRS = 1 << 19
#: Documents, and bytes of text, that are aligned at once; and links of a batch that are counted together.
GROUP_DOCS, GROUP_BYTES, COUNT_LINKS = 2000, 2 << 20, 1 << 20
#: Chunks in each of the two generations a worker keeps, and their longest.
CACHE_ENTRIES, LONGEST_KEPT = 120_000, 64
_BLANK = "▁"


class PlainIds(TextIds):
    """Ids of A, with the strings of special tokens as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.specials = []
        letters = byte_letters()
        size = self.tokenizer.get_vocab_size()
        spelled = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token in spelled]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) >= CACHE_ENTRIES:
            self.old, self.words = self.words, {}
        return super().__call__(texts)


class PieceIds:
    """Ids of B for whole texts.

    No merge reaches from a letter to the blank after it, as no piece holds a
    blank inside, so texts are cut at blanks, all chunks of a group are numbered
    in Arrow, and each distinct one is given to the library once and kept.
    Texts with two blanks in a row are encoded whole, and all texts are if some
    piece of the vocabulary does hold a blank inside.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(_BLANK in p.lstrip(_BLANK) for p in pieces)
        self.chunks: dict[str, bytes] = {"": array("I", [self.model.piece_to_id(_BLANK)]).tobytes()}
        self.old: dict[str, bytes] = {}

    def _codes(self, chunks: list[str]) -> list[bytes]:
        new = [c for c in chunks if c not in self.chunks]
        for chunk in new:
            if chunk in self.old:
                self.chunks[chunk] = self.old[chunk]
        new = [c for c in new if c not in self.chunks]
        fresh = dict(zip(new, (array("I", ids).tobytes() for ids in self.model.encode(new, num_threads=1)))) if new else {}
        self.chunks.update((c, ids) for c, ids in fresh.items() if len(c) <= LONGEST_KEPT)
        return [self.chunks[c] if c in self.chunks else fresh[c] for c in chunks]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text begins in them (and the end); texts are without the blank that B adds."""
        if len(self.chunks) >= CACHE_ENTRIES:
            self.old, self.chunks = self.chunks, {"": self.chunks[""]}
        whole = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        if not self.apart:
            whole = pc.is_valid(texts)
        texts_whole = texts.filter(whole).to_pylist()
        words = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        codes = self._codes(coded.dictionary.to_pylist())
        at[bounds[:-1][whole.to_numpy(zero_copy_only=False)]] = np.arange(len(codes), len(codes) + len(texts_whole))
        if texts_whole:
            codes += [array("I", ids).tobytes() for ids in self.model.encode(texts_whole, num_threads=1)]
        ids, ends = _gathered(codes, at)
        return ids, ends[bounds]


def _gathered(codes: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id lists numbered by ``at`` in a row, and where each begins (and the end)."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    flat = np.frombuffer(b"".join(codes), np.uint32)
    begin = np.cumsum(sizes) - sizes
    count = sizes[at]
    ends = np.concatenate([[0], np.cumsum(count)])
    return flat[np.repeat(begin[at] - ends[:-1], count) + np.arange(ends[-1])], ends


class Spelling:
    """Bytes and decimal digits of a vocabulary's ids, as tables."""

    def __init__(self, spelled: list[bytes]):
        self.sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        digits = [str(i).encode() for i in range(len(spelled))]
        self.n_digits = np.fromiter(map(len, digits), np.int64, len(digits))
        self.digits = np.zeros((len(digits), int(self.n_digits.max(initial=1)) + 1), np.uint8)
        for row, text in zip(self.digits, digits):
            row[: len(text)] = np.frombuffer(text, np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        count = self.sizes[ids]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.begin[ids] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


def owners(sizes: np.ndarray) -> np.ndarray:
    """For each byte the number of the token that owns it."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked token numbers of A and of B, in order, and for each token of A and of B the number of its group.

    Both cover the same bytes and no token is empty.
    """
    a, b = owners(a_sizes), owners(b_sizes)
    if not len(a):
        return a, b, a, b
    new_a, new_b = np.diff(a, prepend=-1) > 0, np.diff(b, prepend=-1) > 0
    links = np.flatnonzero(new_a | new_b)
    group = np.cumsum(new_a & new_b, dtype=np.int32) - 1
    return a[links], b[links], group[np.flatnonzero(new_a)], group[np.flatnonzero(new_b)]


def _spelled_groups(ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], tables: tuple[Spelling, Spelling], closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;a3|b2,b3;` for all groups in a row, and where each group's end (closing says which groups are wanted)."""
    n = len(ids[0]) + len(ids[1])
    count = [np.bincount(g, minlength=len(closing)) for g in group]
    place = (
        np.arange(len(ids[0])) + (np.cumsum(count[1]) - count[1])[group[0]],
        np.arange(len(ids[1])) + np.cumsum(count[0])[group[1]],
    )
    width = max(t.digits.shape[1] for t in tables)
    text, size = np.empty((n, width), np.uint8), np.empty(n, np.int64)
    for x, at, table in zip(ids, place, tables):
        text[at, : table.digits.shape[1]] = table.digits[x]
        size[at] = table.n_digits[x]
    mark = np.full(n, ord(","), np.uint8)
    last = np.cumsum(count[0] + count[1])
    mark[last - 1] = ord(";")
    mark[last - count[1] - 1] = ord("|")
    text[np.arange(n), size] = mark
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    return text[np.arange(width) <= size[:, None]], ends[np.concatenate([[0], last])][np.concatenate([[0], np.flatnonzero(closing) + 1])]


class Aligner:
    """Encodes with both vocabularies and aligns; one a worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = PlainIds(a_path), PieceIds(b_path)
        self.tables = Spelling(self.a.bytes), Spelling(self.b.bytes)

    def encoded(self, texts: pa.StringArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B, and how many each text has: none where its bytes are not space and text in both."""
        spaced = pc.binary_join_element_wise("", texts, " ")
        given = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.binary_length(spaced).to_numpy(zero_copy_only=False))
        want = np.frombuffer(b"".join(pc.if_else(pc.equal(texts, ""), "", spaced).cast(pa.binary()).to_pylist()), np.uint8)
        ids, counts, right = [], [], np.ones(len(texts), bool)
        for table, (found, bounds) in zip(self.tables, (self._a(spaced), self.b(texts))):
            number = np.repeat(np.arange(len(texts)), np.diff(bounds))
            size = np.bincount(number, table.sizes[found], len(texts)).astype(np.int64)
            same = size == given
            # only texts of equal length can be compared byte by byte
            keep = same[number] & (given[number] > 0)
            got = table.bytes_of(found[keep])
            wanted = want[np.repeat(same, given)]
            wrong = np.repeat(np.arange(len(texts)), np.where(same, given, 0))[got != wanted]
            same[wrong] = False
            right &= same
            ids.append(found)
            counts.append(number)
        right &= given > 0
        kept = [x[right[n]] for x, n in zip(ids, counts)]
        return kept, [np.bincount(n[right[n]], minlength=len(texts)) for n in counts]

    def _a(self, spaced: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = self.a(spaced)
        inner = np.ones(len(ids), bool)
        inner[bounds[1:] - 1] = False
        return ids[inner], bounds - np.arange(len(bounds))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    at = 0
    while at < len(sizes):
        fits = int(np.searchsorted(np.cumsum(sizes[at : at + GROUP_DOCS], dtype=np.int64), GROUP_BYTES))
        yield batch.slice(at, max(1, fits))
        at += max(1, fits)


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _aligner(a_path, b_path)
        n_b = len(worker.b.bytes)
        for batch in (part for whole in batches for part in _groups(whole)):
            texts = pc.fill_null(batch.column("text"), "")
            (a, b), (n_a, n_b_of) = worker.encoded(texts)
            docs = len(texts)
            at_a, at_b, group_a, group_b = aligned(worker.tables[0].sizes[a], worker.tables[1].sizes[b])
            doc = np.repeat(np.arange(docs), n_a)
            links = np.bincount(doc[at_a], minlength=docs)
            # every text ends a group, and the last of each text closes it
            groups_of = doc[np.flatnonzero(np.diff(group_a, prepend=-1))]
            groups = np.bincount(groups_of, minlength=docs)
            closing = np.diff(groups_of, append=docs) > 0
            some = np.flatnonzero(n_a)
            shas = [""] * docs
            if len(some):
                text, cut = _spelled_groups((a, b), (group_a, group_b), worker.tables, closing)
                view = memoryview(text)
                for i, lo, hi in zip(some.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                    shas[i] = hashlib.sha256(view[lo : hi - 1]).hexdigest()
            code = a[at_a].astype(np.int64) * n_b + b[at_b]
            key, times = np.unique((doc[at_a].astype(np.int64) << 40) | code, return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(key >> 40, minlength=docs))]).astype(np.int32)
            pairs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key & ((1 << 40) - 1), pa.int64()))
            counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))
            numbers = [pa.array(x.astype(np.int64)) for x in (n_a, n_b_of, groups, links)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(shas, pa.string()), pairs, counts], _COLUMNS)

    return run


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about COUNT_LINKS distinct links."""
    ends = batch.column("pairs").offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + COUNT_LINKS)) - 1)
        yield batch.slice(at, to - at)
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs and their links, of so many links at a time."""
    pairs, times, held = [], [], 0

    def sums() -> pa.RecordBatch:
        distinct, back = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, np.concatenate(times))
        return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], ["pair", "n"])

    for batch in (part for whole in batches for part in _parts(whole)):
        pairs.append(_flat(batch, "pairs"))
        times.append(_flat(batch, "times"))
        held += len(pairs[-1])
        if held >= COUNT_LINKS:
            yield sums()
            pairs, times, held = [], [], 0
    if held:
        yield sums()


def pair_counts(tokens: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether none of its B id has more."""
    counts = materialised(tokens.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.pmod(F.col("pair"), F.lit(n_b))
    # a row for each id of B at most
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = materialised(counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    drop(counts)
    return out


def _least_kept(counts: DataFrame) -> int:
    """The least power of two from which counts are kept, so that ``KEPT_PAIRS`` pairs are kept at most."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).orderBy(F.desc("power")).collect()
    kept, least = 0, 1 << 62
    for row in sizes:
        kept += row["pairs"]
        if kept > KEPT_PAIRS:
            break
        least = 1 << row["power"]
    return least


def _looked_up(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = kept.value
        for batch in (part for whole in batches for part in _parts(whole)):
            code, times = _flat(batch, "pairs"), _flat(batch, "times").astype(np.int64)
            offsets = batch.column("pairs").offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            place = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            found = pairs[place] == code if len(pairs) else np.zeros(len(code), bool)
            each = np.where(found, n[place], 0) * times if len(pairs) else np.zeros(len(code), np.int64)
            good = np.where(found & best[place], times, 0) if len(pairs) else np.zeros(len(code), np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (good, each, ~found)]
            rare = pa.array(sums[2][offsets].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", *_COLUMNS[:6])]
                + [pa.array(np.diff(s[offsets])) for s in sums[:2]]
                + [pa.ListArray.from_arrays(rare, pa.array(code[~found])), pa.ListArray.from_arrays(rare, pa.array(times[~found]))],
                ["row", *_COLUMNS[:6], "good", "each", "pairs", "times"],
            )

    return run


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, for every row of ``docs``.

    Reads doc_id and text only.  Null and empty texts, and texts that either
    vocabulary spells otherwise, have no tokens: zeros and an empty hash.  Ids
    may be null or repeat: each row is a document and counts.  A text is aligned
    whole; a task holds some 100 bytes for each byte of its longest text.  An
    empty table gives an empty one.  Runs Spark jobs before it returns.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialised(plain.mapInArrow(_align(a_path, b_path), _SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(tokens, PieceIds(b_path).model.get_piece_size())
    least = _least_kept(counts)
    table = counts.where(F.col("n") >= least).toArrow().combine_chunks().sort_by("pair")
    kept = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    looked = tokens.mapInArrow(_looked_up(kept), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, good long, each long, pairs array<long>, times array<long>")
    looked = materialised(looked)
    drop(tokens)
    rare = looked.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    rare = rare.join(counts.where(F.col("n") < least), "pair")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_good"), F.sum(F.col("times") * F.col("n")).alias("rare_each"))
    out = looked.drop("pairs", "times").join(rest, "row", "left")
    total = {"n_best": F.col("good") + F.coalesce("rare_good", F.lit(0)), "count_sum": F.col("each") + F.coalesce("rare_each", F.lit(0))}
    return out.select(*names, *[c.cast("long").alias(name) for name, c in total.items()], "groups_sha256")
