"""Vectorised word and shingle hashing of whole Arrow string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text; other ASCII
characters separate words.  A word's hash is a polynomial over its bytes modulo 2**64, got from prefix sums, and mixed.
Bytes are taken in pieces cut between words, so that temporary arrays stay small for texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

WORD, MARK, SPACE = 1, 2, 0
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = WORD
_CLASS[[0, *range(9, 14), 32]] = SPACE

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def pieces(column: pa.Array, limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each (a longer text is a range of its own), to bound temporary arrays."""
    size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    out, a = [], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(size, size[a] + limit, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """hash: of each token, in text order; offset: of the first token of each text, and their number."""

    hash: np.ndarray
    offset: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.offset)


def tokens(column: pa.Array | pa.ChunkedArray, marks: bool = False) -> Tokens:
    """Hash the words of each text (null: no words); with ``marks`` also runs of other non-space ASCII characters."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = pc.utf8_lower(pc.fill_null(arr.cast(pa.large_string()), ""))
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    kinds = _CLASS[data]
    if not marks:
        kinds[kinds == MARK] = SPACE
    cut = np.zeros(len(data) + 1, bool)  # a token can begin here
    if len(data):
        cut[0] = True
        cut[1:-1] = kinds[1:] != kinds[:-1]
        cut[off] = True
    at = 0
    starts, hashes = [], []
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            while not cut[at + 1 : end + 1].any() and end < len(data):
                end = min(end + PIECE, len(data))
            if end < len(data):
                end = at + 1 + int(np.flatnonzero(cut[at + 1 : end + 1])[-1])
        s = np.flatnonzero(cut[at:end])
        e = np.append(s[1:], end - at)
        used = kinds[at + s] != SPACE
        s, e = s[used], e[used]
        n = end - at
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[at:end].astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=total[1:])
        starts.append(s + at)
        hashes.append(mix((total[e] - total[s]) * _power(INVERSE, n + 1)[s] + (e - s).astype(np.uint64)))
        at = end
    first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Tokens(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(first, off))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    size = len(h) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = (total + h[k : k + size]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(total)


def ngrams(t: Tokens, n: int, short: bool = False) -> Tokens:
    """n-grams within each text.  With ``short``, a text of 1 to n - 1 words has one gram of all its words."""
    count = t.count
    size = np.maximum(count - n + 1, 0)
    if len(t.hash) >= n:
        ok = np.ones(len(t.hash), bool)
        for k in range(1, n):
            last = t.offset[1:] - k
            ok[last[last >= t.offset[:-1]]] = False
        grams = _grams(t.hash, n)[ok[: len(t.hash) - n + 1]]
    else:
        grams = np.zeros(0, np.uint64)
    offset = np.append(0, np.cumsum(size))
    if short and (few := np.flatnonzero((count > 0) & (count < n))).size:
        extra = np.array([mix(np.array([_short(t.hash[t.offset[i] : t.offset[i + 1]])], np.uint64))[0] for i in few], np.uint64)
        grams = np.insert(grams, offset[few], extra)
        size[few] = 1
        offset = np.append(0, np.cumsum(size))
    return Tokens(grams, offset)


def _short(h: np.ndarray) -> int:
    total = len(h)
    for x in h:
        total = (total * 0x100000001B3 + int(x)) & 0xFFFFFFFFFFFFFFFF
    return total


def permutations(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd multipliers of k hash functions on 32-bit values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32), rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(grams: Tokens, k: int, seed: int = 1) -> np.ndarray:
    """(texts, k) minimum hash values; a text without grams has the largest value throughout."""
    masks, factors = permutations(k, seed)
    out = np.full((len(grams.count), k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(grams.count)
    x = (grams.hash >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(full):  # slices of texts that fit the processor's cache
        j = max(i + 1, int(np.searchsorted(grams.offset[full], grams.offset[full[i]] + (1 << 16))))
        part = full[i:j]
        a, b = grams.offset[part[0]], grams.offset[part[-1] + 1]
        at = grams.offset[part] - a
        v = x[a:b]
        for q in range(k):
            out[part, q] = np.minimum.reduceat((v ^ masks[q]) * factors[q], at)
        i = j
    return out


def fold(values: np.ndarray) -> np.ndarray:
    """Fold the last axis of uint32 values into one int64 hash."""
    total = np.full(values.shape[:-1], 0x51ED270B, np.uint64)
    for q in range(values.shape[-1]):
        total = (total ^ values[..., q].astype(np.uint64)) * np.uint64(BASE)
    return mix(total).view(np.int64)
