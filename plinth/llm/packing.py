"""Packing documents into training sequences by vector bin packing.

Every item is a vector of tokens, segments (always one) and loss-bearing
tokens; a sequence limits all three.  The next item of a sequence is the one
whose vector has the largest dot product with what the sequence has left, each
dimension weighed by its mean demand (Panigrahy et al. 2011); segments weigh the
same for all.  Items may be cut: an item that doesn't fit whole fills the gap
with its first part.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters

#: Words in each of the two generations a worker keeps, and their longest.
CACHE_ENTRIES, LONGEST_KEPT = 400_000, 64
#: Items that are packed together, and bytes of text from which fewer are; what a task holds at once.
GROUP_DOCS, GROUP_BYTES = 2000, 16 << 20

#: Two white space characters in a row: there pre-tokens hang on what follows.
_STRADDLES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Marks a word that no blank precedes.
_BARE = "\x01"
_STOPS = set(".,;:!?")


class TextIds:
    """Ids of whole texts from the tokenizers library, as uint32 values.

    The pre-tokenizer starts a pre-token at every single blank and cuts out
    every single line end.  So texts are cut there, all words of a group are
    numbered in Arrow, each distinct one (with the blank before it, if any) is
    given to the library's BPE model once and kept, and the words' ids are
    gathered by number.  A letters-only word, and a stop after one, are
    pre-tokens as they are; other words are cut by the library's pre-tokenizer.
    Texts with special tokens or longer runs of white space are encoded whole.
    """

    def __init__(self, path: str):
        # a task has one core; the library's threads would only wait on each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.blank = self.letters[32]

    def _pieces(self, word: str) -> list[str]:
        """The word's pre-tokens as the model spells them."""
        bare = word[:1] == _BARE
        core = word[1:] if bare else word
        if core.isalpha():
            stem = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            return [stem if bare else self.blank + stem]
        text = core if bare or core == "\n" else " " + core
        return [piece for piece, _ in self.cut(text)] if text else []

    def _code(self, word: str) -> bytes:
        known = self.words.get(word) or self.old.get(word)
        if known is None:
            stem = word[:-1]
            if word[-1:] in _STOPS and (stem[1:] if stem[:1] == _BARE else stem).isalpha():
                known = self._code(stem) + self._code(_BARE + word[-1])
            else:
                tokenize = self.model.tokenize
                known = array("I", [t.id for piece in self._pieces(word) for t in tokenize(piece)]).tobytes()
        if len(word) <= LONGEST_KEPT:
            self.words[word] = known
        return known

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, a closing 0 after each text's, and where each text begins in them (and the end)."""
        if len(self.words) >= CACHE_ENTRIES:
            self.old, self.words = self.words, {}
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring_regex(texts, _STRADDLES), pc.match_substring(texts, _BARE))
        for special in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        texts_whole = texts.filter(whole).to_pylist()
        lines = pc.replace_substring(pc.if_else(whole, "", texts), "\n", f" \n {_BARE}")
        # an empty word closes each text; its place, not its content, tells it apart
        words = pc.split_pattern(pc.binary_join_element_wise(_BARE, lines, " ", ""), " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        codes = list(map(self._code, coded.dictionary.to_pylist()))
        at[bounds[1:] - 1] = len(codes)
        codes.append(b"\0\0\0\0")
        at[bounds[:-1][whole.to_numpy(zero_copy_only=False)]] = np.arange(len(codes), len(codes) + len(texts_whole))
        codes += [array("I", code.ids).tobytes() for code in self.tokenizer.encode_batch_fast(texts_whole, add_special_tokens=False)]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        flat = np.frombuffer(b"".join(codes), np.uint32)
        begin = np.cumsum(sizes) - sizes
        count = sizes[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(begin[at] - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[bounds - bounds[0]]


_encoders: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """A worker's encoder; what it has kept outlives the task."""
    if path not in _encoders:
        _encoders[path] = TextIds(path)
    return _encoders[path]


def groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of GROUP_DOCS rows, of fewer where their texts are long."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    at = 0
    while at < len(sizes):
        fits = int(np.searchsorted(np.cumsum(sizes[at : at + GROUP_DOCS], dtype=np.int64), GROUP_BYTES))
        yield batch.slice(at, max(1, fits))
        at += max(1, fits)


def fill(tokens: np.ndarray, loss: np.ndarray, size: int, segments: int, loss_limit: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length).

    Sequences of one item come off items first that are too long for one, or
    bear too much loss.  What is left of all items is packed by the dot-product
    rule.  A sequence that ends short of ``size`` is dealt on in powers of two,
    which need no padding.  ``loss`` holds how many of each item's tokens bear
    loss: its last ones.
    """
    out: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(tokens), np.int64)
    for i in np.flatnonzero((tokens >= size) | (loss > loss_limit)).tolist():
        left, bears = int(tokens[i]), int(loss[i])
        while left >= size or bears > loss_limit:
            take = min(left, size, left - bears + loss_limit)
            if take < size:
                take = 1 << take.bit_length() - 1
            out.append([(i, int(start[i]), take)])
            start[i] += take
            left -= take
            bears = min(bears, left)
    left = (tokens - start).astype(np.int64)
    waiting = np.nonzero(left > 0)[0]
    waiting = waiting[np.argsort(-left[waiting], kind="stable")]
    need = left[waiting].astype(np.float64)
    bear = np.minimum(loss[waiting], need).astype(np.float64)
    weights = (need.mean() / size**3, bear.mean() / loss_limit**3) if len(waiting) else (1.0, 1.0)
    alive = len(waiting)
    while alive:
        room, slots, losses = size, segments, loss_limit
        bin_: list[tuple[int, int, int]] = []
        while room and slots and alive:
            score = need * (weights[0] * room) + bear * (weights[1] * losses)
            pick = int(np.argmax(np.where((need > 0) & (need <= room) & (bear <= losses), score, -1.0)))
            # the last segment should close the gap: what yields most goes in, cut if need be
            if slots == 1 or not 0 < need[pick] <= room or bear[pick] > losses:
                pick = int(np.argmax(np.minimum(need, need - bear + losses)))
            take = int(min(need[pick], room, need[pick] - bear[pick] + losses))
            if take < 1:
                break
            item = int(waiting[pick])
            bin_.append((item, int(start[item]), take))
            start[item] += take
            need[pick] -= take
            losses -= int(max(0, bear[pick] - need[pick]))
            bear[pick] = min(bear[pick], need[pick])
            alive -= need[pick] == 0
            room, slots = room - take, slots - 1
        out.extend([bin_] if room == 0 else _powers(bin_))
        if alive and alive < len(need) // 2:
            keep = need > 0
            waiting, need, bear = waiting[keep], need[keep], bear[keep]
    return out


def _powers(bin_: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a short sequence into sequences whose lengths are powers of two."""
    total = sum(length for _, _, length in bin_)
    out, queue = [], bin_[::-1]
    for bit in reversed(range(total.bit_length())):
        want = 1 << bit
        if not total & want:
            continue
        part = []
        while want:
            item, start, length = queue.pop()
            take = min(want, length)
            part.append((item, start, take))
            if take < length:
                queue.append((item, start + take, length - take))
            want -= take
        out.append(part)
    return out


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def _joined(prompts: tuple[np.ndarray, np.ndarray], answers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each prompt's ids, without its closing id, before its answer's."""
    (x, a), (y, b) = prompts, answers
    parts = [part for i in range(len(a) - 1) for part in (x[a[i] : a[i + 1] - 1], y[b[i] : b[i + 1]])]
    return np.concatenate(parts) if parts else y, a + b - np.arange(len(a))


def pack(docs: DataFrame, path: str, size: int = 1024, segments: int = 64, loss_limit: int | None = None, prompt: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is the ids of its ``text`` and a closing 0, all loss-bearing; a
    null text is just the closing id.  For instruction data ``prompt`` names a
    column whose ids come before them and bear no loss.  Sequences hold at most
    ``size`` tokens, ``segments`` pieces and ``loss_limit`` loss-bearing tokens
    (default: ``size``); each is full or a power of two long.  Reads these
    columns only; equal rows are packed each; sequence ids are unique across tasks.
    """
    loss_limit = loss_limit or size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path)
        sequence = TaskContext.get().partitionId() << 36
        for part in (part for batch in batches for part in groups(batch)):
            ids, bounds = encode(part.column("text"))
            loss = np.diff(bounds)
            if prompt:
                ids, bounds = _joined(encode(part.column("prompt")), (ids, bounds))
            tokens = np.diff(bounds)
            doc_ids, raw, first = part.column("doc_id").to_pylist(), memoryview(ids).cast("B"), bounds.tolist()
            cols: list[list] = [[] for _ in _COLUMNS]
            for bin_ in fill(tokens, loss, size, segments, loss_limit):
                offset = 0
                for item, start, length in bin_:
                    crc = zlib.crc32(raw[4 * (first[item] + start) : 4 * (first[item] + start + length)])
                    total = int(tokens[item])
                    bears = max(0, start + length - max(start, total - int(loss[item])))
                    for col, x in zip(cols, (doc_ids[item], start, length, crc, total, sequence, offset, bears)):
                        col.append(x)
                    offset += length
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _COLUMNS)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(prompt).cast("string").alias("prompt")] if prompt else []))
    return plain.mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))
