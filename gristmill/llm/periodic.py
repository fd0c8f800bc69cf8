"""Periodic runs of words: found by Main and Lorentz's division, in what repeated k-grams leave of each text.

A run is a stretch of consecutive words with smallest period q, at least `least` words and `times` periods long, that no
neighbouring word extends. Words q apart are equal in it, so all but its first q words and all but its last q words are
the same string, of at least k = overlap(least, times) words: every word of a run stands in a k-gram that the document
holds twice. Words outside such k-grams are masked, and no run crosses one. k-grams are compared by 64-bit hashes, which
can only leave too much; what is left, in segments, is searched on the words themselves. A segment is halved again and
again, and the runs across its middle are told from the longest common prefixes and suffixes (Z arrays) of the halves
and their shifts, n log n in all; shifts go no further than a `times`-th of the segment.

Everything happens within a document, so nothing is shuffled, and a lost task is one split read again.

Defined results: a null or blank text has no words, no run and an empty collapsed text; a null doc_id stays null and its
text is never edited; repeated rows are each answered; texts may be as long as they like (memory is linear in the longest
text); an empty table gives an empty table; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, text_rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words that a run shares with itself shifted by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(ids: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which words of several documents, end to end, stand in a k-gram that their document holds more than once."""
    out = np.zeros(len(ids) + 1, np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.arange(len(ids)) + k <= ends[doc]) if len(ids) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(len(ids), bool)
    gram = mix64(doc[at].astype(np.uint64) + np.uint64(1))
    for i in range(k):
        gram = mix64(gram + ids[at + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    np.add.at(out, at[again], 1)
    np.add.at(out, at[again] + k, -1)
    return np.cumsum(out)[:-1] > 0


def prefixes(s: Sequence[int], count: int) -> list[int]:
    """How far s agrees with itself from each of the first places on."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (count - 1)
    for i in range(1, count):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def matches(p: Sequence[int], z: Sequence[int], s: Sequence[int], count: int) -> list[int]:
    """How far p, whose prefixes() are z, agrees with s from each of its first places on."""
    out, m, n, left, right = [0] * count, len(p), len(s), 0, 0
    for i in range(count):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while k < m and i + k < n and p[k] == s[i + k]:
            k += 1
        out[i], left, right = k, i, i + k
    return out


def runs_in(s: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of s, by start and period."""
    found: dict[tuple[int, int], int] = {}
    parts = [(0, len(s))]
    while parts:
        low, high = parts.pop()
        if high - low < max(2, least):
            continue
        mid, longest = (low + high) // 2, (high - low) // times
        parts += [(low, mid), (mid, high)]
        before, after = s[low:mid][::-1], s[mid:high]
        one, two = min(longest, len(after)), min(longest, len(before))
        width = 1 + max(one, two)
        z_after, z_before = prefixes(after, min(width, len(after))), prefixes(before, min(width, len(before)))
        # a period right of the middle: what follows agrees with what lies q further on, and so does what comes before
        back = matches(before, z_before, s[low : mid + one][::-1], one)
        for q in range(1, one + 1):
            a, b = back[one - q], z_after[q] if q < len(after) else 0
            if a + b >= (times - 1) * q:
                keep(found, s, mid - a, mid + q + b, q, least)
        forth = matches(after, z_after, s[mid - two : high], two)
        for q in range(1, two + 1):
            a, b = z_before[q] if q < len(before) else 0, forth[two - q]
            if a + b >= (times - 1) * q:
                keep(found, s, mid - q - a, mid + b, q, least)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def keep(found: dict[tuple[int, int], int], s: list[int], a: int, b: int, q: int, least: int) -> None:
    """Note a stretch unless a neighbour extends it, as where the part that was halved cuts it off; the smallest period stays."""
    if b - a >= least and not (a and s[a - 1] == s[a - 1 + q]) and not (b < len(s) and s[b] == s[b - q]):
        found[a, b] = min(q, found.get((a, b), q))


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        return self.setdefault(word, len(self))


def searched(words: list[list[str]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each document's words."""
    number = Numbers().__getitem__
    ids = [list(map(number, own)) for own in words]
    sizes = np.array([len(x) for x in ids], np.int64)
    left = repeated(np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes, overlap(least, times))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], left, [False])).astype(np.int8)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    firsts = np.cumsum(sizes) - sizes
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        # documents stand end to end: segments of two that touch are parted where the second begins
        doc = int(np.searchsorted(firsts, a, "right")) - 1
        while a < b:
            first = int(firsts[doc])
            end = min(b, first + int(sizes[doc]))
            if end - a >= least:
                out[doc] += [(a - first + x, n, q) for x, n, q in runs_in(ids[doc][a - first : end - first], least, times)]
            a, doc = max(a, end), doc + 1
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by a space, without those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    gone = bytearray(len(words))
    for start, length, q in runs:
        gone[start + q : start + length] = b"\1" * (length - q)
    return " ".join(w for w, x in zip(words, gone, strict=True) if not x)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's test text: in one of ten documents, told by the id, the words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each document; runs are (start, length, period) in words, by start and period.

    `edit` may change the words of a text before they are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [WORD.findall(t) for t in texts(batch.column(1))]
            if edit:
                words = [edit(i, own) for i, own in zip(batch.column(0).to_pylist(), words, strict=True)]
            found = searched(words, least, times)
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found]
            short = [collapsed(own, r) for own, r in zip(words, found, strict=True)]
            sizes = pa.array([len(own) for own in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(rows, pa.list_(RUN)), pa.array(short, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's row for each document of find()."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("_top", longest)
    start, length, period = -F.col("_top.a"), F.col("_top.length"), -F.col("_top.q")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * _top.length div -_top.q").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
