"""Vectorised words: where they start in a batch of UTF-8 texts, and a 64-bit hash of each, without an object for each word.

A word's hash is the sum over its bytes of T[byte] * R[position], finished by a mixer; T and R hold fixed random odd
numbers. Words may be as long as they like: R is used again after its 4096 entries, times a number for each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

_random = np.random.Generator(np.random.PCG64(0x6D617267))
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _random.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(table: np.ndarray = BYTE) -> np.ndarray:
    """A byte table that gives A-Z the numbers of a-z."""
    out = table.copy()
    out[0x41:0x5B] = table[0x61:0x7B]
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the n + 1 offsets of its texts. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't breaks (a bool for each of 256 bytes); none crosses texts."""
    inside = ~breaks[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~inside[1:] | edge[1:]
    return starts, np.flatnonzero(inside & after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Of data[start:end] for each of the ascending, disjoint segments, none empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    at = place + np.repeat(starts, lengths)
    value = table[data[at]] * PLACE[place & 4095]
    if lengths.max() > 4096:
        value *= np.uint64(2) * (place >> 12).astype(np.uint64) + np.uint64(1)
    return mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending starts lie in each text."""
    return np.diff(np.searchsorted(starts, offsets))
