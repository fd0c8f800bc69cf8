"""Removal of repeated byte strings: suffix arrays by Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search.

A byte goes if some string of LENGTH bytes that covers it starts anywhere else as well. To find those strings without
sorting the whole corpus:

1. Every start of LENGTH bytes is given the smallest hash of the GRAM-byte strings inside (winnowing): equal strings get
   equal minima. Starts in a row with one minimum are a run; its context is all bytes that its strings cover.
2. A run whose minimum is nowhere else can't hold a repeated string. Runs with equal contexts are repeated as a whole;
   one of them stands for all from here on, so large groups of copies end here. Contexts are equal if their 128-bit BLAKE2b
   digests are, which no text can be made to feign.
3. The remaining contexts are dealt into shards by their minimum, so equal strings meet. A shard's suffix array comes from
   prefix doubling that refines only unsettled groups; common prefixes come by Kasai's property (a suffix shares at least
   one byte less with its neighbour than the suffix before it), with direct comparison where it says nothing.
4. A minimum with more context than SHARD_BYTES is split over several shards. Each then writes the digests of its distinct
   strings in sorted slices, and slices of all its shards are merged by binary search. Strings of 400 bytes themselves would
   be 25 times as much.

Winnowing hashes only choose: a collision there brings strings together that are then told apart by their bytes.

No step holds more than a shard, a slice or a document. Defined results: a null text is empty; rows with the same doc_id
are documents of their own, and equal ones remove each other; texts under LENGTH bytes lose nothing; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, mix64, slices, text_rows
from .minhash import id_map, possible
from .wordhash import BYTE, utf8

LENGTH, GRAM = 400, 128
CHUNK = 1 << 20
#: Starts in a run, at most; longer runs (periodic text) are cut.
RUN = 4096
SHARD_BYTES = 1 << 20
LEAST = -(1 << 63)

#: Slices of a split minimum for each of its shards.
FINE = 16

BASE = int(np.random.Generator(np.random.PCG64(0x737566)).integers(1 << 40, 1 << 60)) * 8 + 5


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        _powers[base] = powers(base, max(n, 1 << 17))
    return _powers[base][:n]


def prefix_sums(raw: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * power(base, len(raw)), out=out[1:])
    return out


def ranged_hash(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes start..end, wherever they stand."""
    back = pow(base, -1, 1 << 64)
    return mix64((sums[end] - sums[start]) * power(back, len(sums))[start])


def sliding(x: np.ndarray, width: int, fold: np.ufunc, fill: int) -> np.ndarray:
    """The least (or largest) of every `width` neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = fold.accumulate(grid, axis=1).ravel()
    behind = fold.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(behind[: n - width + 1], ahead[width - 1 : n])


def digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """16 bytes for the bytes start..end."""
    view = memoryview(np.ascontiguousarray(raw))
    return np.frombuffer(b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.dtype("S16"))


def halves(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = digest.view("<i8").reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def runs(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimum, two halves of the context's digest, first start, starts, whether the minimum stands twice in it) of each run."""
    parts = [run_piece(raw[x : x + CHUNK + LENGTH - 1], x) for x in range(0, len(raw) - LENGTH + 1, CHUNK)]
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, bool))


def run_piece(raw: np.ndarray, offset: int) -> tuple[np.ndarray, ...]:
    width = LENGTH - GRAM + 1
    gram = np.arange(len(raw) - GRAM + 1)
    h = ranged_hash(prefix_sums(raw, BYTE, BASE), BASE, gram, gram + GRAM)
    low = sliding(h, width, np.minimum, (1 << 64) - 1)
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], change])
    count = np.diff(np.append(first, len(low)))
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(h == sliding(np.concatenate([pad, low, pad]), width, np.maximum, 0))
    fresh = np.flatnonzero(np.concatenate([[True], h[chosen][1:] != h[chosen][:-1]]))
    twice = np.diff(np.append(fresh, len(chosen))) > 1
    if len(twice) != len(first):
        twice = np.ones(len(first), bool)  # a hash of zero; then each run is looked at
    if count.max() > RUN:
        cut = -(-count // RUN)
        which = np.repeat(np.arange(len(first)), cut)
        step = np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)
        first, count, twice = first[which] + step * RUN, np.minimum(RUN, count[which] - step * RUN), twice[which]
    return low[first], *halves(digests(raw, first, first + count + LENGTH - 1)), first + offset, count, twice


RUNS = "m long, key long, thash long, c1 long, c2 long, start long, n long, twice boolean"


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of rows (key, thash, text)."""
    for batch in slices(batches, 128):
        data, offsets = utf8(batch.column(2))
        found = [runs(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = [len(f[0]) for f in found]
        m, c1, c2, start, n, twice = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.repeat(np.arange(len(sizes)), sizes)
        key, thash = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (m, key, thash, c1, c2, start, n, twice)], ["m", "key", "thash", "c1", "c2", "start", "n", "twice"])


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order: by eight bytes first, then groups that are still tied by the rank twice as far on."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    # zero padding ties with zero bytes: the shorter suffix is the smaller, and comes first by its length
    short = np.minimum(n - order, 8)
    order = order[np.lexsort((short, key[order]))] if n and (short < 8).any() else order
    key, short = key[order], np.minimum(n - order, 8)
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (short[1:] != short[:-1])]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.flatnonzero(fresh)
    sizes = np.diff(np.append(start, n))
    rank[order] = np.repeat(start, sizes)
    open_ = np.repeat(sizes > 1, sizes)
    h = 8
    while open_.any():
        at = np.flatnonzero(open_)
        some = order[at]
        pair = (rank[some] << 32) + rank[np.minimum(some + h, n)] + 1
        o = np.argsort(pair, kind="stable")
        some, pair = some[o], pair[o]
        order[at] = some
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        start = np.flatnonzero(fresh)
        sizes = np.diff(np.append(start, len(at)))
        rank[some] = np.repeat(at[start], sizes)
        open_[at] = np.repeat(sizes > 1, sizes)
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix in order shares with the one before it; 0 for the first."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    # a suffix whose left byte equals its neighbour's shares one byte less than the suffix before it in the text
    follows = (at > 0) & (before > 0)
    follows[1:] &= data[:-1] == data[np.maximum(before[1:] - 1, 0)]
    i = np.flatnonzero(~follows & (before >= 0))
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    left = i
    while len(left):
        x, y = left + shared[left], before[left] + shared[left]
        same = (eight[x] == eight[y]).astype(np.uint8)
        k = np.minimum(np.where(same.all(axis=1), 8, same.argmin(axis=1)), n - np.maximum(x, y))
        shared[left] += k
        left = left[(k == 8) & (np.maximum(x, y) + 8 < n)]
    # along the text, place + shared bytes stays what it was where Kasai's property decides
    total = np.where(follows, -1, at + shared)
    return (np.maximum.accumulate(np.where(follows, 0, total)) - at)[order] if n else shared


def repeated(contexts: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all starts (context after context): whether its string of LENGTH bytes starts twice here, its group, and its place in the joined contexts."""
    data = np.concatenate(contexts)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    starts = np.repeat(begin, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    order = suffix_array(data)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(common_prefixes(data, order) < LENGTH)
    own = group[starts]
    return np.bincount(own)[own] > 1, own, starts


SHARDED = "hot boolean, shard long, m long, parts int, key long, thash long, start long, n int, single boolean, body binary"
OWNER = np.dtype([("key", "<i8"), ("thash", "<i8"), ("start", "<i8")])
FOUND = "key long, thash long, start long, end long, m long, slice int, keys binary, owners binary"


def spans_of(flags: np.ndarray, counts: np.ndarray, context: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of flagged starts in each context: (context, first byte, end of what they cover)."""
    edge = np.cumsum(counts) - counts
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | (context[1:] != context[:-1])
    last = flags.copy()
    last[:-1] &= ~flags[1:] | (context[1:] != context[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(last)
    c = context[a]
    return list(zip(c.tolist(), (first[c] + a - edge[c]).tolist(), (first[c] + b - edge[c] + LENGTH).tolist(), strict=True))


def shard_spans(key, rows):
    """FOUND rows of a shard: spans of single contexts, and for a split minimum its distinct strings in sorted slices."""
    contexts = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows["body"]]
    counts = rows["n"].to_numpy().astype(np.int64)
    single, first = rows["single"].to_numpy(zero_copy_only=False), rows["start"].to_numpy()
    names = list(zip(rows["key"].to_pylist(), rows["thash"].to_pylist(), strict=True))
    flags, group, starts = repeated(contexts, counts)
    context = np.repeat(np.arange(len(contexts)), counts)
    out = [(*names[c], a, b, None, None, None, None) for c, a, b in spans_of(flags & single[context], counts, context, first)]
    if rows["hot"][0].as_py():
        one = np.unique(group, return_index=True)[1]
        names_ = digests(np.concatenate(contexts), starts[one], starts[one] + LENGTH)
        lone = ~flags[one] & single[context[one]]
        m, slices_ = rows["m"][0].as_py(), rows["parts"][0].as_py() * FINE
        place = first[context[one]] + one - (np.cumsum(counts) - counts)[context[one]]
        row = np.zeros(len(one), OWNER)
        for i, field in enumerate(("key", "thash")):
            row[field] = np.array([x[i] for x in names])[context[one]]
        row["start"] = np.where(lone, place, -1)
        where = (halves(names_)[0].view(np.uint64) % np.uint64(slices_)).astype(np.int64)
        order = np.lexsort((names_, where))
        for mine in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            out.append((None, None, None, None, m, int(where[mine[0]]), names_[mine].tobytes(), row[mine].tobytes()))
    return found_table(out)


def found_table(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("key", pa.int64()), ("thash", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("m", pa.int64()), ("slice", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary())])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def merge_slices(key, rows):
    """Strings that lie in several shards of one minimum: each shard's sorted list is looked up in the merged one."""
    lists = [np.frombuffer(x.as_buffer(), "S16") for x in rows["keys"]]
    merged = np.sort(np.concatenate(lists), kind="stable")
    out = []
    for own, who in zip(lists, rows["owners"], strict=True):
        times = np.searchsorted(merged, own, "right") - np.searchsorted(merged, own, "left")
        owner = np.frombuffer(who.as_buffer(), OWNER)
        hit = owner[(times > 1) & (owner["start"] >= 0)]
        out += [(int(k), int(t), int(s), int(s) + LENGTH, None, None, None, None) for k, t, s in hit]
    return found_table(out)


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHARDED rows from (text, wanted), wanted a list of contexts."""
    for batch in slices(batches, 128):
        rows = []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for w in wanted:
                rows.append((w["hot"], w["shard"], w["m"], w["parts"], w["key"], w["thash"], w["start"], w["n"], w["single"], raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]))
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SHARDED.split(", ")])


def repeats(docs: DataFrame) -> DataFrame:
    """(key, thash, spans): disjoint ascending byte spans to remove, of the documents that have any.

    key is the doc_id (LEAST for null) and thash a hash of the text; repeated rows share both, and their spans.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    every = materialize(rows.mapInArrow(run_rows, RUNS), "suffix-runs")
    anchors = every.groupBy("m").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("t")).where("k > 1 OR t").select("m")
    anchors = materialize(anchors, "suffix-anchors")
    bits = spark.sparkContext.broadcast(id_map(anchors))
    live = every.mapInArrow(possible(bits, True), every.schema).join(anchors, "m", "left_semi")
    live = materialize(live, "suffix-live")
    drop(every)
    classes = live.groupBy("c1", "c2").agg(F.min(F.struct("key", "thash", "start", "m", "n", "twice")).alias("rep"), F.count(F.lit(1)).alias("k"))
    classes = materialize(classes.select("c1", "c2", "k", "rep.*"), "suffix-classes")
    size = F.col("n") + F.lit(LENGTH - 1)
    groups = classes.groupBy("m").agg(F.count(F.lit(1)).alias("contexts"), F.sum(size).alias("bytes"), F.min("k").alias("least"), F.max("twice").alias("t"))
    groups = materialize(groups.where("(contexts > 1 OR t) AND least = 1").select("m", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int").alias("parts"), "bytes"), "suffix-groups")
    total = groups.agg(F.sum(F.when(F.col("parts") == 1, F.col("bytes")))).first()[0] or 0
    shards = total // (SHARD_BYTES // 2) + 1
    hot = F.col("parts") > 1
    shard = F.when(hot, F.xxhash64("m", F.pmod(F.xxhash64("c1"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("m"), F.lit(shards)))
    wanted = classes.join(groups, "m").select(hot.alias("hot"), shard.alias("shard"), "m", "parts", "key", "thash", "start", F.col("n").cast("int").alias("n"), (F.col("k") == 1).alias("single"))
    wanted = wanted.groupBy("key", "thash").agg(F.collect_list(F.struct(*wanted.columns)).alias("wanted"))
    wanted = materialize(wanted, "suffix-wanted")
    near = spark.sparkContext.broadcast(id_map(wanted.select("key")))
    texts = rows.mapInArrow(possible(near, True), rows.schema).join(wanted, ["key", "thash"]).dropDuplicates(["key", "thash"])
    sharded = texts.select("text", "wanted").mapInArrow(cut_contexts, SHARDED)
    found = materialize(sharded.groupBy("hot", "shard").applyInArrow(shard_spans, FOUND), "suffix-found")
    merged = found.where("keys IS NOT NULL").groupBy("m", "slice").applyInArrow(merge_slices, FOUND)
    whole = live.join(classes.where("k > 1").select("c1", "c2"), ["c1", "c2"], "left_semi").select("key", "thash", "start", (F.col("start") + size).alias("end"))
    spans = whole.unionByName(found.where("keys IS NULL").select("key", "thash", "start", "end")).unionByName(merged.select("key", "thash", "start", "end"))
    joined = spans.groupBy("key", "thash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return joined


def keyed(docs: DataFrame) -> DataFrame:
    rows = text_rows(docs)
    text = F.coalesce("text", F.lit(""))
    return rows.select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.xxhash64(text).alias("thash"), text.alias("text"))


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, spans, kept) from (key, text, spans)."""
    for batch in slices(batches):
        rows = []
        for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            gone = disjoint([(s["start"], s["end"]) for s in spans or []])
            kept, at = [], 0
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            rows.append((None if key == LEAST else key, len(raw), [{"start": a, "end": b} for a, b in gone], b"".join([*kept, raw[at:]])))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "spans", "kept"])


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the byte spans removed and the bytes left, of every document.

    Documents without repeats, which a bounded map of ids tells, are not shuffled.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    found = materialize(repeats(docs), "suffix-spans")
    bits = spark.sparkContext.broadcast(id_map(found.select("key")))
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    touched = rows.mapInArrow(possible(bits, True), rows.schema).join(found, ["key", "thash"], "left").select("key", "text", "spans").mapInArrow(cut_rows, schema)
    clear = rows.mapInArrow(possible(bits, False), rows.schema)
    none = F.array().cast("array<struct<start: long, end: long>>")
    clear = clear.select(F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    return touched.unionByName(clear)


def digest(removed: DataFrame) -> DataFrame:
    """The contract's row for each document, and how many bytes are left and whether any are gone."""
    left = F.octet_length("kept").cast("long")
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left.alias("n_kept"), (F.size("spans") > 0).alias("repeated"))
