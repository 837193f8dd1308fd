"""Words of many texts at once, as 64-bit codes.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. They are
found and hashed over an Arrow column's bytes as they stand, without a Python object for a text or
a word. Equal words have equal codes; null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: So many bytes of text are hashed at a time; a longer text or word is taken whole.
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPACE = 32
#: Each byte as it counts: white space as one kind of space, A-Z lower-cased.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = _SPACE
_PLAIN[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and their inverses, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        rows = []
        for factor in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n + 1, SEGMENT + 1), factor, np.uint64)
            x[0] = 1
            rows.append(np.multiply.accumulate(x))
        _powers[base] = tuple(rows)
    return _powers[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each begins and the last ends)"""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def by_bytes(batches, column: int, most: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most so many bytes together, or one row."""
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words, text after text; number of words of each text)"""
    data, at = text_bytes(column)
    x = _PLAIN[data]
    inside = x != _SPACE
    fresh = np.zeros(len(x) + 1, bool)  # no word goes on from one text into the next
    fresh[at] = True
    before = np.zeros(len(x), bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.zeros(len(x), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    out, k = np.empty(len(begin), np.uint64), 0
    while k < len(begin):
        low = begin[k]
        m = max(k + 1, int(np.searchsorted(begin, low + SEGMENT)))
        piece = x[low : end[m - 1]]
        up, down = powers(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        b, e = begin[k:m] - low, end[k:m] - low
        out[k:m] = (sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        k = m
    return mixed(out), np.diff(np.searchsorted(begin, at))


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _grams(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n words from each place."""
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h += w[at + k] * _MULTIPLIERS[k]
        h ^= h >> np.uint64(31)
    h *= _MULTIPLIERS[0]
    return h ^ (h >> np.uint64(32))


def gram_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct codes of each text's word n-grams, text after text; where each text's begin
    and the last's end). With fewer words than `width` the whole sequence is the one n-gram."""
    w, words = word_codes(column)
    first = np.cumsum(words) - words
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    begin = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint64)
    full = np.flatnonzero(words >= width)
    count = n[full]
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out[np.repeat(begin[full], count) + step] = _grams(w, np.repeat(first[full], count) + step, width)
    for short in range(1, width):
        own = np.flatnonzero(words == short)
        out[begin[own]] = _grams(w, first[own], short)
    new = np.ones(len(out), bool)
    for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new[1:] = out[1:] != out[:-1]
    new[begin[n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[np.append(begin, len(out))]
