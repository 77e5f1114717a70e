"""Words and word hashes, shared by the operators on texts.

A word is ``[^\\x20\\x09-\\x0D]+``.  ``bytes.split()`` cuts at exactly those
six bytes and ``bytes.lower()`` changes exactly A-Z, so both work on UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Entries a worker's cache of word hashes may hold before it starts anew.
CACHE_ENTRIES = 250_000
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class HashCache(dict):
    """word -> 64-bit hash; a pure function, so clearing it changes nothing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive words.

    The polynomial is built by doubling, so its cost grows with log2(size).
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, done, power, length = None, 0, hashes.astype(np.uint64), 1
    rest, base = size, _ODD
    while rest:
        if rest & 1:
            part = power[done : done + n]
            if total is None:
                total = part.copy()
            else:
                total = total * np.uint64(base) + part
            done += length
        rest >>= 1
        if rest:
            power = power[:-length] * np.uint64(base) + power[length:]
            base = base * base & _MASK
            length *= 2
    return mix(total)


def shingle_set(text: str | None, size: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a lower-cased text.

    Fewer words than ``size`` make one shingle of the whole sequence; no word, none.
    """
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words, cache)
    if len(words) < size:
        # the length tells a short sequence from a longer one with equal polynomial
        return mix(window_hashes(hashes, len(words)) ^ np.uint64(len(words)))
    return np.unique(window_hashes(hashes, size))


def as_signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per part, without a Python object per value."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
