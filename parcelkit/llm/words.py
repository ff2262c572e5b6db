"""Words as 64-bit numbers, from Arrow text columns, without a Python object per word.

A word is a run of bytes other than blanks (0x20, 0x09-0x0D), with A-Z lower-cased. Its number is a
polynomial in the bytes modulo 2 ** 64, mixed at the end. Among a billion different words the chance
that any two share a number is about 3 %; what follows from a clash is stated by each operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 19

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, from 0 to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        n = 1 << n.bit_length()
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 2**64), np.uint64)], dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words in ``raw`` (uint8), where each begins and where it ends; worked in blocks that end at blanks."""
    numbers, begins, ends, at = [], [], [], 0
    while at < len(raw):
        to = min(at + _BLOCK, len(raw))
        while to < len(raw) and not _BLANK[raw[to - 1]]:  # a word is not cut; one beyond a block makes its block longer
            more = np.flatnonzero(_BLANK[raw[to : to + 4096]])
            to = to + int(more[0]) + 1 if len(more) else min(to + 4096, len(raw))
        part = raw[at:to]
        blank = _BLANK[part]
        edges = np.flatnonzero(np.diff(np.r_[True, blank, True]))
        begin, end = edges[::2], edges[1::2]
        powers, inverses = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * powers[: len(part)], out=sums[1:])
        numbers.append(mix((sums[end] - sums[begin]) * inverses[begin]))
        begins.append(begin + at)
        ends.append(end + at)
        at = to
    if not numbers:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.concatenate(begins), np.concatenate(ends)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string or binary column; a null row is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with a blank after each, and where each row's blank is."""
    raw, at = buffers(column)
    out = np.full(len(raw) + len(at) - 1, 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    blanks = at[1:] + np.arange(len(at) - 1)
    keep[blanks] = False
    out[keep] = raw
    return out, blanks


def of_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows one after another, and each row's offsets into them (n + 1)."""
    raw, blanks = spaced(column)
    numbers, _, ends = of_bytes(raw)
    return numbers, np.r_[0, np.searchsorted(ends, blanks, side="right")]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch with about ``most`` bytes of text at most (one row at least)."""
    _, at = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


class Numbering:
    """Finds word numbers in a fixed set, by an open hash table: the place of each in ``known``, or -1."""

    def __init__(self, known: np.ndarray):
        self.known = np.append(known.astype(np.int64), 0)  # the last one stands for an empty slot, never found
        self.mask = (1 << int(2 * len(known) + 1).bit_length()) - 1
        self.slots = np.full(self.mask + 1, len(known), np.int32)
        waiting, place = np.arange(len(known), dtype=np.int32), self._start(known.astype(np.int64))
        while len(waiting):
            free = self.slots[place] == len(known)
            self.slots[place[free]] = waiting[free]
            rest = self.slots[place] != waiting
            waiting, place = waiting[rest], place[rest] + 1 & self.mask

    def _start(self, values: np.ndarray) -> np.ndarray:
        return (values ^ (values >> 29)) & self.mask

    def find(self, values: np.ndarray) -> np.ndarray:
        none = len(self.known) - 1
        place = self._start(values)
        out = self.slots.take(place)
        waiting = np.flatnonzero((self.known.take(out) != values) & (out != none))
        out[(out != none) & (self.known.take(out) != values)] = none
        place = place[waiting]
        while len(waiting):
            place = place + 1 & self.mask
            found = self.slots.take(place)
            hit = (found != none) & (self.known.take(found) == values[waiting])
            out[waiting[hit]] = found[hit]
            rest = ~hit & (found != none)
            waiting, place = waiting[rest], place[rest]
        return np.where(out == none, -1, out)
