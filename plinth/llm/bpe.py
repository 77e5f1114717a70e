"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences BPE
produces (Berglund, Martens & van der Merwe 2024).  It starts as one state that
loops on all bytes; a merge gadget for each rule (u, v) -> w, in rank order,
- splits the state that u leads to, the copy having no way out on v, and
- lets every state with a way out on u also leave on w, to where v led.
All ways out on one token lead to one state, so a state is its owner (the
token before it) and the rank it was split at; which tokens leave it follows
from the splits it went through.

Arcs are spelled out in bytes and the whole is made deterministic: a state of
the byte automaton is the set of arcs under way, each with the place it left,
and the token that ends here.  Every prefix of a word has one accepted path, so
one token ends at each byte.  The transitions for all that the vocabulary spells
are compiled when it is read; those beyond it are added when a text first takes
them.  Encoding is one look-up a byte, without a step back; the tokens are read
off from the last one.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import texts

#: How byte-level vocabularies write the 256 bytes.
_PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Entries in each of the two generations of a worker's cache of pieces.
CACHE_ENTRIES = 250_000
#: Transitions of the byte automaton, beyond the vocabulary's, and of the token automaton held before they are made anew.
TABLE_ENTRIES = 600_000


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable bytes stand for themselves, the rest for U+0100 on."""
    out = {chr(b): b for b in _PRINTABLE}
    rest = [b for b in range(256) if b not in _PRINTABLE]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]):
        """``merges``: (left, right, result) ids by rank."""
        self.labels: dict[int, bytes] = {i: label for label, i in vocab.items()}
        self.rank_of: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.owner, self.born = [-1], [-1]
        self.leads_to: dict[int, int] = {i: 0 for label, i in vocab.items() if len(label) == 1}
        self.came_from = dict(self.leads_to)
        for rank, (u, v, w) in enumerate(merges):
            if (u, v) in self.rank_of or u not in self.leads_to or v not in self.leads_to:
                continue
            self._gadget(rank, u, v, w)
        self.known: dict[tuple[int, int], bool] = {}
        # labels as a trie: node and byte -> node; the token a node spells, or -1; whether it goes on
        self.trie: dict[int, int] = {}
        self.spelled, self.goes_on = [-1], [True]
        usable = [(label, i) for label, i in vocab.items() if i in self.leads_to]
        for label, i in usable:
            node = 0
            for byte in label:
                step = node << 8 | byte
                if step not in self.trie:
                    self.trie[step] = len(self.spelled)
                    self.spelled.append(-1)
                    self.goes_on.append(False)
                    self.goes_on[node] = True
                node = self.trie[step]
            self.spelled[node] = i
        self._words = [label for label, _ in usable]
        self._compile()

    def _compile(self) -> None:
        """The byte automaton's transitions for all words of the vocabulary."""
        self.arcs: dict[int, int] = {}
        self.under_way: list[tuple[tuple[int, int], ...]] = [((0, 0),)]
        self.ends = [-1]
        self._states: dict[tuple, int] = {}
        for label in self._words:
            self._walk(label)
        self.compiled = len(self.arcs)

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.rank_of[u, v] = rank
        if w not in self.leads_to:
            self.left[w], self.made[w] = u, rank
            self.leads_to[w] = self.came_from[w] = self.leads_to[v]
        self.owner.append(u)
        self.born.append(rank)
        self.leads_to[u] = len(self.owner) - 1

    def _removed_at(self, state: int, token: int) -> int | None:
        """Rank of the split by which ``state`` lost its way out on ``token``."""
        while state:
            owner = self.owner[state]
            rank = self.rank_of.get((owner, token))
            if rank is not None and rank <= self.born[state]:
                return rank
            state = self.came_from[owner]
        return None

    def leaves(self, state: int, token: int) -> bool:
        """Whether ``state`` has a way out on ``token``; it then leads to ``leads_to[token]``."""
        known = self.known.get((state, token))
        if known is not None:
            return known
        part, until, out = token, None, True
        while True:
            gone = self._removed_at(state, part)
            if gone is not None and (until is None or gone <= until):
                out = False
                break
            if part not in self.left:
                break
            until, part = self.made[part], self.left[part]
        if len(self.known) >= TABLE_ENTRIES:
            self.known.clear()
        self.known[state, token] = out
        return out

    def _arc(self, at: int, byte: int) -> int:
        """Add the byte automaton's transition from ``at``."""
        trie, spelled, goes_on, token = self.trie, self.spelled, self.goes_on, -1
        on: list[tuple[int, int]] = []
        for node, left in self.under_way[at]:
            node = trie.get(node << 8 | byte, -1)
            if node < 0:
                continue
            if token < 0 and spelled[node] >= 0 and self.leaves(left, spelled[node]):
                token = spelled[node]
            if goes_on[node]:
                on.append((node, left))
        if token < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        on.append((0, self.leads_to[token]))
        state = (token, *on)
        to = self._states.get(state)
        if to is None:
            to = self._states[state] = len(self.ends)
            self.ends.append(token)
            self.under_way.append(tuple(on))
        self.arcs[at << 8 | byte] = to
        return to

    def _walk(self, word: bytes) -> list[int]:
        """The state after each byte."""
        at, out, arcs = 0, [], self.arcs
        for byte in word:
            to = arcs.get(at << 8 | byte)
            at = self._arc(at, byte) if to is None else to
            out.append(at)
        return out

    def encode(self, word: bytes) -> list[int]:
        if len(self.arcs) >= self.compiled + TABLE_ENTRIES:
            self._compile()
        states, labels, ends = self._walk(word), self.labels, self.ends
        out, at = [], len(word)
        while at:
            token = ends[states[at - 1]]
            out.append(token)
            at -= len(labels[token])
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.labels[i] for i in ids])


class Splitter:
    """Cuts a text at special tokens, then by the pre-tokenizer's pattern."""

    def __init__(self, pattern: str, specials: dict[str, int]):
        self.pieces = regex.compile(pattern).findall
        self.specials = specials
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")").split if specials else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.specials):
            return self.pieces(text)
        out: list[str] = []
        for part in self.cut(text):
            if part in self.specials:
                out.append(part)
            elif part:
                out += self.pieces(part)
        return out


def read_vocabulary(path: str) -> tuple[MergeAutomaton, dict[str, int]]:
    """The automaton and the special tokens of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    model, letters = stored["model"], byte_letters()
    specials = {t["content"]: t["id"] for t in stored["added_tokens"] if t["special"]}

    def raw(token: str) -> bytes:
        return bytes(map(letters.__getitem__, token))

    ids = {token: i for token, i in model["vocab"].items() if token not in specials}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merges = [(ids[u], ids[v], ids[u + v]) for u, v in pairs]
    return MergeAutomaton({raw(token): i for token, i in ids.items()}, merges), specials


class PieceCache(dict):
    """piece -> value in two generations: what is in use outlives a refill."""

    def __init__(self, compute: Callable[[str], object], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, piece: str):
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = self.compute(piece)
        if len(piece) <= 64:
            self[piece] = value
        return value


class Coder:
    """Encodes and decodes whole texts with one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        self.automaton, self.specials = read_vocabulary(path)
        self.split = Splitter(pattern, self.specials)
        self.special_labels = {i: s.encode() for s, i in self.specials.items()}
        self.cache = PieceCache(self._piece)

    def _ids(self, piece: str) -> list[int]:
        special = self.specials.get(piece)
        return [special] if special is not None else self.automaton.encode(piece.encode("utf-8", "surrogatepass"))

    def _piece(self, piece: str) -> tuple[str, int, bytes]:
        ids = self._ids(piece)
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self._ids(piece)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        labels, special = self.automaton.labels, self.special_labels
        return b"".join([labels[i] if i in labels else special[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        got = list(map(self.cache.__getitem__, self.split(text)))
        ids = ",".join([g[0] for g in got])
        back = b"".join([g[2] for g in got]).decode("utf-8", "replace")
        return sum([g[1] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """A worker's coder; the automaton is built once in a process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            ids = pa.array([code.encode(t or "") for t in texts(batch)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``.

    A null text counts as empty: no ids, and the digests of the empty string.
    Reads doc_id and text only; equal rows give equal rows; ids may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [code.digest(t or "") for t in texts(part)]
                n, ids, back = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
