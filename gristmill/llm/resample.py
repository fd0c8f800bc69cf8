"""Resampling towards a target distribution: importance weights from hashed n-grams, and an exact draw by external merging.

A text's features are its runs of one to three words, counted into buckets by CRC-32. Two passes read the texts: one
counts the buckets of the corpus and of the target (10,000 sums each, whatever the input), the next scores every text by
an array of the buckets' log ratios and adds Gumbel noise told from the id, so that the highest scores are a draw without
replacement. CRCs of joined words come from those of the words, by tables of the shift that a CRC takes for each length.

The draw keeps exactly the highest scores, in order. Splitters taken from the scores deal the rows near the top into
ranges; each input partition is sorted by Spark and stored as a run of blocks, none across a splitter. How many rows a
range has is known then, so only the ranges down to the one in which the draw ends are merged, each by a task of its own:
blocks come in order of their first key, a tournament tree holds one place for each run, a run's next block is taken in
when its first key is due, and merging stops with the last row to be drawn. A task holds one block for each run.
Ranges are bounded even where many rows have one score, as splitters go by the id too.

Defined results: a null text has no words; a null doc_id is noise of its own (as if the id were empty) and comes after
equal scores with an id; repeated rows are each scored and may each be drawn; an empty target counts nothing; an empty
table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, prepare, slices, text_rows
from .wordhash import counts, utf8, words

BUCKETS, LONGEST = 10_000, 3
#: Words that a text needs to be drawn, and what share of those is, in hundredths.
LEAST, SHARE, SEED = 20, 5, 42
BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Ranges at most, and keys that the blocks open in one task hold at most.
RANGES, OPEN = 256, 1 << 20


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte table of CRC-32, and what a CRC becomes by 0 to 63 and by 2^k zero bytes, for each of its bytes' values."""
    byte = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
    # without the inversion at both ends, a table for the empty register
    plain = byte ^ byte[0]
    unit = np.arange(256, dtype=np.uint32)
    now = np.stack([unit, unit << np.uint32(8), unit << np.uint32(16), unit << np.uint32(24)])
    few = [now]
    for _ in range(63):
        now = plain[now & 255] ^ (now >> np.uint32(8))
        few.append(now)
    power = [few[1]]
    for _ in range(40):
        power.append(shifted(power[-1], power[-1]))
    return plain, np.stack(few), np.stack(power)


def shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def advanced(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC, moved on by as many zero bytes."""
    _, few, power = tables()
    near = np.minimum(lengths, 63)
    # one gather for each byte of the registers; lengths above 63 go by their bits
    out = few[near, 0, crc & 255] ^ few[near, 1, crc >> 8 & 255] ^ few[near, 2, crc >> 16 & 255] ^ few[near, 3, crc >> 24]
    far = np.flatnonzero(lengths > 63)
    if len(far):
        value, rest = crc[far], lengths[far]
        for k in range(int(rest.max()).bit_length()):
            value = np.where(rest >> k & 1, shifted(value, power[k]), value)
        out[far] = value
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 64) -> np.ndarray:
    """The CRC-32 of each word."""
    plain, _, _ = tables()
    lengths = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(lengths, long + 1), kind="stable")
    sizes = lengths[order]
    top = int(np.searchsorted(-sizes, -long, "left"))
    for place in range(int(min(sizes[top], long)) if top < len(sizes) else 0):
        live = order[top : int(np.searchsorted(-sizes, -place, "left"))]
        crc = out[live]
        out[live] = plain[(crc ^ data[starts[live] + place]) & 255] ^ (crc >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[:top].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(column: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, the text it is of, words of each text)."""
    data, offsets = utf8(column)
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] |= 0x20
    starts, ends = words(lower, offsets, BREAK)
    sizes = counts(starts, offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    crc = word_crcs(lower, starts, ends)
    # a space in front of the word
    spaced = advanced(np.full(len(crc), zlib.crc32(b" "), np.uint32), ends - starts) ^ crc
    found, docs, joined = [crc % buckets], [doc], crc
    for k in range(1, longest):
        at = np.arange(len(joined) - 1) if len(joined) else np.zeros(0, np.int64)
        more = at + k
        joined = advanced(joined[:-1], (ends - starts + 1)[more]) ^ spaced[more] if len(at) else joined[:0]
        inside = more < last[at]
        found.append(joined[inside] % buckets)
        docs.append(doc[at][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(docs), sizes


def bucket_counts(docs: DataFrame, column: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends its sums alone."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            sums += np.bincount(features(batch.column(0))[0], minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    texts = docs.select(F.col(column).cast("string").alias("text"))
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds to a text's weight, in thousandths."""
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + BUCKETS)) / (float(a + 1) * float(t + BUCKETS)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bucket, doc, sizes = features(batch.column(1))
            sums = np.zeros(len(sizes) + 1, np.int64)
            # integers: bincount's doubles would round large sums
            np.add.at(sums, doc, gain[bucket])
            weight = sums[:-1]
            n = np.bincount(doc, minlength=len(sizes))
            score = weight + np.array([noise(i) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of matches over numbered places; the place with the least key wins. A place without a key is None."""

    def __init__(self, places: int):
        self.base = 1
        while self.base < places:
            self.base *= 2
        self.keys: list[tuple | None] = [None] * self.base
        self.winner = [0] * self.base + list(range(self.base))

    def put(self, place: int, key: tuple | None) -> None:
        self.keys[place] = key
        at = (self.base + place) // 2
        while at:
            a, b = self.winner[2 * at], self.winner[2 * at + 1]
            x, y = self.keys[a], self.keys[b]
            self.winner[at] = a if y is None or (x is not None and x <= y) else b
            at //= 2

    def top(self) -> tuple[int, tuple | None]:
        place = self.winner[1] if self.base > 1 else 0
        return place, self.keys[place]


FIELDS = ("score", "doc_id", "n_features", "weight")


def merged(blocks: Iterator[tuple[int, list[list]]], runs: int, wanted: int) -> Iterator[tuple[tuple, bool]]:
    """Rows of sorted runs, least first by (-score, no id, id): the wanted ones in order, the others as they come.

    blocks are (run, columns), in order of their first keys; (row, whether it is among the wanted).
    """
    tree, place, rows = Tournament(runs), {}, {}
    due = next(blocks, None)

    def key(columns: list[list], i: int) -> tuple:
        doc = columns[1][i]
        return -columns[0][i], doc is None, doc or 0

    while wanted:
        at, least = tree.top()
        while due is not None and (least is None or key(due[1], 0) <= least):
            # a run's blocks follow one another, so its place is empty or ends with the very key that is due
            where = place.setdefault(due[0], len(place))
            rows.setdefault(where, []).append([due[1], 0])
            if len(rows[where]) == 1:
                tree.put(where, key(due[1], 0))
            due = next(blocks, None)
            at, least = tree.top()
        if least is None:
            return
        columns, i = rows[at][0]
        yield tuple(c[i] for c in columns), True
        wanted -= 1
        if i + 1 < len(columns[0]):
            rows[at][0][1] = i + 1
            tree.put(at, key(columns, i + 1))
        else:
            rows[at].pop(0)
            tree.put(at, key(*rows[at][0]) if rows[at] else None)
    for queue in rows.values():
        for columns, first in queue:
            for i in range(first, len(columns[0])):
                yield tuple(c[i] for c in columns), False
    while due is not None:
        for i in range(len(due[1][0])):
            yield tuple(c[i] for c in due[1]), False
        due = next(blocks, None)


def splitters(rows: DataFrame, total: int, wanted: int, pieces: int, slack: float) -> list[tuple[int, int]]:
    """Descending (score, id) that part the highest rows into ranges; rows before one have a higher score, or its score and no higher id."""
    shares = [max(0.0, 1 - wanted * (j + 1) / (pieces * total)) for j in range(int(pieces * slack))]
    found = rows.agg(F.percentile_approx("score", shares, 200 * pieces * max(1, min(100, total // wanted)))).first()[0]
    top = (1 << 63) - 1
    heavy = {s for s in found if found.count(s) > 1}
    out = {(s, top) for s in found}
    if heavy:
        cuts = [i / RANGES for i in range(1, RANGES)]
        for r in rows.where(F.col("score").isin(*heavy)).groupBy("score").agg(F.percentile_approx("doc_id", cuts, 20 * RANGES).alias("ids")).collect():
            step = max(1, RANGES // found.count(r["score"]))
            out |= {(r["score"], i) for i in (r["ids"] or [])[step - 1 :: step]}
    return sorted(out, key=lambda e: (-e[0], e[1]))


BLOCK = "range int, run int, first_score long, first_doc long, " + ", ".join(f"{f} array<long>" for f in FIELDS)


def stored_runs(rows: DataFrame, edges: list[tuple[int, int]], size: int) -> DataFrame:
    """Each partition of rows, sorted, as blocks of at most `size` keys, cut where a range ends."""
    lows = np.array([-s for s, _ in edges], np.int64)
    docs = np.array([d for _, d in edges], np.int64)

    def ranges(score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The number of splitters that come before a row."""
        first, last = np.searchsorted(lows, -score, "left"), np.searchsorted(lows, -score, "right")
        out = first.copy()
        for i in np.flatnonzero(last > first).tolist():
            out[i] += np.searchsorted(docs[first[i] : last[i]], doc[i], "left")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            score, doc = batch.column(0).to_numpy(), batch.column(1).fill_null((1 << 63) - 1).to_numpy()
            where = ranges(score, doc)
            cuts = np.flatnonzero(np.diff(where)) + 1
            cuts = np.unique(np.concatenate((cuts, np.arange(0, len(where) + size, size).clip(max=len(where)), [0, len(where)])))
            first, sizes = cuts[:-1], pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(sizes, batch.column(i)) for i in range(len(FIELDS))]
            heads = [pa.array(where[first], pa.int32()), pa.array(np.full(len(first), number), pa.int32()), batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first))]
            yield pa.RecordBatch.from_arrays(heads + lists, ["range", "run", "first_score", "first_doc", *FIELDS])

    prepare(rows.sparkSession)
    return rows.select(*FIELDS).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id")).mapInArrow(run, BLOCK)


def drawn(rows: DataFrame, eligible: str, wanted: int, total: int) -> DataFrame:
    """rows (doc_id, n_features, weight, score, …) with a rank from 1 for the `wanted` highest of the eligible; others have none.

    rows should be a stored table, as it is read several times.
    """
    spark = rows.sparkSession
    unranked = F.lit(None).cast("long").alias("rank")
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if not wanted:
        return rows.select(*out, unranked)
    pieces = min(RANGES, partitions(spark))
    able = rows.where(eligible)
    slack = 1.1
    while True:
        edges = splitters(able, total, wanted, pieces, slack)
        score, doc = edges[-1]
        above = (F.col("score") > score) | ((F.col("score") == score) & (F.coalesce("doc_id", F.lit((1 << 63) - 1)) <= doc))
        blocks = materialize(stored_runs(able.where(above), edges, 1024), "resample-runs")
        found = blocks.groupBy("range").agg(F.sum(F.size("score")).alias("n"), F.countDistinct("run").alias("runs")).orderBy("range").collect()  # no more than splitters
        if sum(r["n"] for r in found) >= wanted:
            break
        slack *= 2
    plan, before = {}, 0
    for r in found:
        if before < wanted:
            plan[r["range"]] = (before, min(r["n"], wanted - before), r["runs"])
        before += r["n"]
    last = max(plan)
    beyond = blocks.where(F.col("range") > last)
    late = beyond.select(F.explode(F.arrays_zip(*[F.col(f) for f in FIELDS])).alias("r")).select(*[F.col(f"r.{f}").alias(f) for f in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, list[list]]]:
            for batch in batches:
                at = [batch.schema.get_field_index(f) for f in ("range", "run", *FIELDS)]
                for i in range(batch.num_rows):
                    where, number, *columns = (batch.column(c)[i].as_py() for c in at)
                    yield where, number, columns

        def packed(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], ["doc_id", "n_features", "weight", "score", "rank"])

        source = each()
        head = next(source, None)
        while head is not None:
            where, ahead = head[0], [head]

            def of_range(where: int = where, ahead: list = ahead) -> Iterator[tuple[int, list[list]]]:
                while ahead[0] is not None and ahead[0][0] == where:
                    yield ahead[0][1:]
                    ahead[0] = next(source, None)

            base, most, runs = plan[where]
            part: list[tuple] = []
            for n, ((s, doc_id, features_, weight), taken) in enumerate(merged(of_range(), runs, most)):
                part.append((doc_id, features_, weight, s, base + n + 1 if taken else None))
                if len(part) == 4096:
                    yield packed(part)
                    part = []
            if part:
                yield packed(part)
            head = ahead[0]

    near = blocks.where(F.col("range") <= last).repartitionById(last + 1, F.col("range"))
    ordered = near.sortWithinPartitions("range", F.desc("first_score"), F.asc_nulls_last("first_doc"))
    top = ordered.mapInArrow(run, "doc_id long, n_features long, weight long, score long, rank long")
    rest = rows.where(~(F.expr(eligible) & above)).select(*out, unranked)
    return top.unionByName(rest).unionByName(late.select(*out, unranked))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the drawn hundredths of the texts of `least` words or more have a rank from 1."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = materialize(scored(docs, gain), "resample-scores")
    total = rows.where(F.col("n_words") >= least).count()
    return drawn(rows, f"n_words >= {int(least)}", share * total // 100, total)
