"""Vectorised word scanning over Arrow string batches (runs in tasks).

Texts stay in Arrow's byte buffers: no Python string per word.  A batch is
worked off in slices of a few MB of text, so memory is bounded by the slice
or by one text, whichever is longer: about six bytes a byte of text and 24 a
word (words are hashed piece by piece).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MULT = 0x9E3779B97F4A7C15


def byte_class(word: str) -> np.ndarray:
    """Table of the bytes that belong to a word.  ``visible``: all but space
    and \\x09-\\x0D; ``alnum``: digits, lower-case ASCII letters and every
    byte of a non-ASCII character."""
    t = np.zeros(256, dtype=bool)
    if word == "visible":
        t[:] = True
        t[0x20] = False
        t[0x09:0x0E] = False
    elif word == "alnum":
        t[0x30:0x3A] = True
        t[0x61:0x7B] = True
        t[0x80:] = True
    else:
        raise ValueError(word)
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


PIECE_BYTES = 1 << 20
_BASE = 0x2545F4914F6CDD1D


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte spans, worked off in pieces of about
    ``PIECE_BYTES``, so that the eight-byte arrays stay small however long a
    text is."""
    out = np.zeros(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    inv = pow(_BASE, -1, 1 << 64)
    widest = min(len(data), PIECE_BYTES)
    up, down = powers(widest, _BASE), powers(widest, inv)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(int(np.searchsorted(ends, lo + widest, side="right")), i + 1)
        if int(ends[j - 1]) - lo <= widest:
            part = data[lo: int(ends[j - 1])]
            run = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=run[1:])
            s = starts[i:j] - lo
            out[i:j] = (run[ends[i:j] - lo] - run[s]) * down[s]
        else:  # one word longer than a piece
            total = 0
            for s in range(lo, int(ends[i]), widest):
                part = data[s: min(s + widest, int(ends[i]))]
                one = int(((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)]).sum(dtype=np.uint64))
                total += one * pow(_BASE, s - lo, 1 << 64)
            out[i] = np.uint64(total % (1 << 64))
        i = j
    return out


class Words:
    """Words of a slice of texts: byte spans, hashes, and ``first`` (of each
    text the index of its first word; one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashes: bool = True,
                 lower: bool = True):
        n = len(data)
        if lower:
            data = lower_table()[data]
        inside = table[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True  # a text's end also ends a word
        begin = inside & edge[:n]
        begin[1:] |= inside[1:] & ~inside[:-1]
        end = inside & edge[1:]
        end[:-1] |= inside[:-1] & ~inside[1:]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashes:
            h = _word_hashes(data, self.starts, self.ends)
            self.hash = mix64(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(_MULT))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and off[-1] else np.zeros(0, dtype=np.uint8)
    return off - off[0], data[off[0]: off[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (a, b) of texts of about ``limit`` bytes together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def word_slices(texts: pa.Array, table: np.ndarray, hashes: bool = True, lower: bool = True,
                limit: int = SLICE_BYTES):
    """(a, b, Words) over a batch of texts, slice by slice."""
    off, data = buffers(texts)
    for a, b in slices(off, limit):
        yield a, b, Words(data[off[a]: off[b]], off[a: b + 1] - off[a], table, hashes, lower)
