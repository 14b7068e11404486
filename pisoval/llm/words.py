"""Word and shingle hashes of whole Arrow batches, computed on the UTF-8 bytes with NumPy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Multipliers of the places of a shingle.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                   np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


#: The most powers that a worker keeps; longer rows, which only very long texts need, are made anew.
_KEPT = (1 << 22) + 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_POWERS.get("up", ())):
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = {}
    for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        made[name] = np.cumprod(p)
    if n <= _KEPT:
        _POWERS.update(made)
    return made["up"][:n], made["down"][:n]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` text bytes at the most (one row at the least), so that working arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def word_hashes(texts: pa.Array, marks: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text). A word is a run of bytes other than ASCII white space and
    `marks`; a null text has no words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0])
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    between = np.zeros(256, bool)
    between[[9, 10, 11, 12, 13, 32, *marks]] = True
    word = ~between[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _PLACES[0])
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts


def text_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text's sequence of words."""
    n = len(hashes)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    ends = np.cumsum(counts)
    starts = ends - counts
    return mix((sums[ends] - sums[starts]) * down[starts] + mix(counts.astype(np.uint64) + np.uint64(7)))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of k words, its text). A text of fewer words has one shingle, of all of them; one without
    words has none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + starts[text]
    left = ends[text] - at
    out = np.zeros(len(text), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        out += np.where(j < left, padded[at + j] * _PLACES[j % 5] + np.uint64(j), np.uint64(0))
    return mix(out), text


def multisets(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in that order, with how often each occurs: (hashes, texts, weights)."""
    if not len(hashes):
        return hashes, text, np.empty(0, np.int64)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))
