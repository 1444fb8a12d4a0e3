"""Vectorised 64-bit hashes of words and word n-grams over a block of concatenated texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
#: Words up to this many bytes are hashed eight bytes at a time over all words at once, longer ones one by one.
_SHORT = 64
#: Masks that keep the first 0..8 bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

#: Which bytes are white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with full avalanche (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(salt << 32)) * U64(_GOLDEN))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place of data, as numbers; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of byte ranges; lanes are independent of one another.

    Eight bytes after eight are added by exclusive or and mixed by a bijection, so ranges of one length that differ
    within their first eight bytes only never collide. Ranges over _SHORT bytes take a keyed BLAKE2b.
    """
    n = ends - starts
    out = mix(n.astype(U64) * U64(_GOLDEN) + U64(lane + 1))
    eight, long = eights(data), n > _SHORT
    live = np.flatnonzero(~long & (n > 0))
    for at in range(0, _SHORT, 8):
        if not len(live):
            break
        part = eight[starts[live] + at] & _KEEP[np.minimum(n[live] - at, 8)]
        out[live] = mix(out[live] ^ part)
        live = live[n[live] > at + 8]
    for k in np.flatnonzero(long).tolist():
        made = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=bytes([lane]))
        out[k] = int.from_bytes(made.digest(), "little")
    return out


def same_spans(one: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of `one` from each of starts are those of `other` from others."""
    same = np.ones(len(n), bool)
    left, right = eights(one), eights(other)
    live = np.flatnonzero((n > 0) & (n <= _SHORT))
    for at in range(0, _SHORT, 8):
        if not len(live):
            break
        part = (left[starts[live] + at] ^ right[others[live] + at]) & _KEEP[np.minimum(n[live] - at, 8)]
        same[live[part != 0]] = False
        live = live[(n[live] > at + 8) & (part == 0)]
    for k in np.flatnonzero(n > _SHORT).tolist():
        same[k] = np.array_equal(one[starts[k] : starts[k] + n[k]], other[others[k] : others[k] + n[k]])
    return same


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its number among the distinct ones, in order of appearance, and where each of these comes first."""
    places = pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(int(places.max()) + 1 if len(places) else 0, np.int64)
    first[places[::-1]] = np.arange(len(places) - 1, -1, -1)
    return places, first


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """numbered() of byte ranges, told apart by their bytes: hashes group them, and each is held against its group's first."""
    places, first = numbered(span_hashes(data, starts, ends) if hashes is None else hashes)
    n, lead = ends - starts, first[places]
    if ((n == n[lead]) & same_spans(data, starts, data, starts[lead], np.minimum(n, n[lead]))).all():
        return places, first
    known: dict[bytes, int] = {}  # two ranges share a hash
    raw = data.tobytes()
    return numbered(np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked bytes that do not cross the row borders `at`."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    borders = at[at < n]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[borders[borders > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def ngrams(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of each n consecutive entries; len(words) - n + 1 of them."""
    by = seeds(n, 7 + lane) | U64(1)
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.full(m, U64(n))
    for k in range(n):
        total += words[k : k + m] * by[k]
    return mix(total)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, starts and ends of their words, and the number of words before each row."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[low], at)
    return low, starts, ends, np.searchsorted(starts, at)


def _rows(first: np.ndarray, n: int, whole, short) -> list:
    """For each row whole(a, last) of its shingles, or short(a, b) of fewer than n words, from word a on."""
    return [whole(a, b - n + 1) if b - a >= n else short(a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each row, as hashes.

    A-Z is lowered; words are runs of bytes other than 0x20 and 0x09-0x0D. A row of fewer than n words
    has its whole sequence as its one shingle; a row without words has none.
    """
    return [x for x, _ in shingle_sums(data, at, n, sums=False)]


def shingle_sums(data: np.ndarray, at: np.ndarray, n: int = 5, sums: bool = True) -> list[tuple[np.ndarray, tuple[int, int]]]:
    """shingle_sets() with a 128-bit hash of each set: sums over its members in two lanes of hashes of their bytes."""
    low, starts, ends, first = _words(data, at)
    lanes = [span_hashes(low, starts, ends, lane) for lane in range(1 + sums)]
    grams = [ngrams(x, n, lane) for lane, x in enumerate(lanes)]

    def total(x: np.ndarray) -> int:
        return int(mix(x).sum(dtype=U64))

    def whole(a: int, last: int):
        if not sums:
            x = np.sort(grams[0][a:last])
            return x[np.concatenate(([True], x[1:] != x[:-1]))], (0, 0)
        order = np.argsort(grams[0][a:last])
        x = grams[0][a:last][order]
        fresh = np.concatenate(([True], x[1:] != x[:-1]))
        return x[fresh], (total(x[fresh]), total(grams[1][a:last][order[fresh]]))

    def short(a: int, b: int):
        some = [ngrams(x[a:b], b - a, lane) if b > a else x[:0] for lane, x in enumerate(lanes)]
        return some[0], (total(some[0]), total(some[-1]))

    return _rows(first, n, whole, short)


def exact_shingles(data: np.ndarray, at: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each row as numbers that are equal only for equal words, in this call."""
    low, starts, ends, first = _words(data, at)
    places, lead = distinct_spans(low, starts, ends)
    grams = places
    for k in range(1, n):  # a gram and the word after it are a pair of numbers, which are numbered anew
        if len(places) > k:
            grams = numbered(grams[:-1] * len(lead) + places[k:])[0]
    few: dict[tuple, int] = {}

    def short(a: int, b: int) -> np.ndarray:
        key = tuple(places[a:b].tolist())
        return np.array([-1 - few.setdefault(key, len(few))] if key else [], np.int64)

    return _rows(first, n, lambda a, last: np.unique(grams[a:last]), short)
