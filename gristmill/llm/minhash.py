"""Near-duplicates by b-bit MinHash: banded candidates, estimates from packed low bits, exact confirmation on full sets.

1. Each document's distinct word shingles are hashed to 64 bits; HASHES minima are taken over them. Bands of whole
   minima give candidate keys; of each minimum B bits are kept, packed into the signature.
2. Documents with equal sets are one node, named by its smallest doc_id; large groups of copies end here.
3. Within a band's bucket each node is paired with a centre, at first the bucket's smallest node. Pairs whose collision-
   corrected estimate is more than MARGIN standard errors below the threshold are dropped, the others confirmed on the full
   sets, and the links contracted. Buckets that still hold several components are centred anew, on a node of their largest
   component, for the nodes outside of it, as long as that links at least every FRUITFUL-th of them.
4. What is still outside of its bucket's largest component is compared with the whole bucket: in blocks bounded by nodes and
   by bytes, by counting common shingles with matrix products. A block returns the links of a spanning forest.
5. Components of all links.

Step 4 costs the nodes outside of the largest component times the bucket, not the bucket squared: near copies that belong
together are one component by then. Every pair in a common bucket is thus either confirmed, refused on its full sets, or
already connected, but for pairs in step 3 that the estimate refuses in a bucket of two. A minimum is mixed before its low
bits are taken, so that bits of unequal minima agree by chance alone. The band's rows are chosen so that a pair at the
threshold misses all buckets with a probability of at most MISS; with MARGIN standard errors the estimate adds 1.3e-6.

Defined results: a null text or one without words has the empty set and is linked with nothing; rows with the same doc_id
and the same set are one document, with different sets they are documents of their own that bear the same name; a null
doc_id is in no group and is kept; empty tables work. Of other columns deduplicate() keeps all and groups() reads none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.plans.offsets import numbered

from .common import drop, drop_since, materialize, mix64, scratch_mark, slices, text_rows
from .components import components, contract
from .wordhash import counts, hashes, lowered, utf8, words

HASHES = 128
B = 2
MISS = 1e-6
MARGIN = 5
#: Nodes, and bytes of their sets, in a block on the average; buckets under SPREAD such blocks have SPREAD smaller ones,
#: down to a quarter of that, so that their cells spread over tasks.
BLOCK, BLOCK_BYTES, SPREAD = 1024, 4 << 20, 8
#: More centres are tried while they link at least every so-manieth node, CENTRES times at most.
FRUITFUL, CENTRES = 10, 4
#: Bits of the maps that tell documents which can't be candidates: sixteen for each id, within these bounds.
MAP_BITS = (1 << 20, 1 << 28)

_random = np.random.Generator(np.random.PCG64(0x6D696E))
FACTOR = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SHIFT = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
FOLD = _random.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_lower = lowered()


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold is missed with a probability of MISS at most."""
    for rows in range(16, 1, -1):
        bands = HASHES // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return bands, rows
    return HASHES, 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words, or of all its words if they are fewer."""
    starts, ends = words(data, offsets, _white)
    h = hashes(data, starts, ends, _lower)
    number = counts(starts, offsets)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        rolled += h[i : len(h) - k + 1 + i] * FOLD[i]
    rolled = mix64(rolled)
    out, at = [], 0
    for n in number.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            out.append(mix64((h[at : at + n] * FOLD[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
    low = None
    for i in range(0, len(s), 2048):
        part = (x[:, i : i + 2048] * FACTOR + SHIFT).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def low_bits(low: np.ndarray) -> np.ndarray:
    """B packed bits of each minimum, of a row of minima. A mixer goes first: the minima are affine in the shingles, and so are their own low bits."""
    x = (low ^ (low >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return np.packbits(((x[:, :, None] >> np.arange(B, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(x), -1), axis=1).view("<i8")


def sign(k: int, bands: int, rows: int):
    """(doc_id, thash, n_shingles, d1, d2, s0..s3, bands) of (doc_id, text, thash): the set's size and digest, the packed signature, the bands' keys."""
    names = ["doc_id", "thash", "n_shingles", "d1", "d2", *(f"s{i}" for i in range(HASHES * B // 64)), "bands"]
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*utf8(batch.column(1)), k)
            m = len(sets)
            low, digest = np.zeros((m, HASHES), np.uint32), np.zeros((m, 2), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    low[i] = minima(s)
                    digest[i] = s.sum(), mix64(s ^ FOLD[15]).sum()
            packed = low_bits(low)
            key = np.zeros((m, bands), np.uint64)
            for r in range(rows):
                key = mix64(key * np.uint64(31) + low[:, r : rows * bands : rows] + salt)
            full = np.array([len(s) > 0 for s in sets], bool)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]), pa.int32()), pa.array(key[full].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(digest[:, i].copy().view(np.int64)) for i in range(2)), *(pa.array(packed[:, i].copy()) for i in range(packed.shape[1])), keys], names)

    return run, f"doc_id long, thash long, n_shingles long, d1 long, d2 long, {', '.join(f's{i} long' for i in range(HASHES * B // 64))}, bands array<long>"


def agreeing(a: str, b: str) -> str:
    """SQL for the number of minima whose B = 2 low bits agree in two signatures."""
    differ = [f"bit_count(({a}.s{i} ^ {b}.s{i} | shiftrightunsigned({a}.s{i} ^ {b}.s{i}, 1)) & 6148914691236517205)" for i in range(HASHES * B // 64)]
    return f"({HASHES} - {' - '.join(differ)})"


def least_agreeing(threshold: float) -> int:
    """The count that a pair at the threshold reaches but for MARGIN standard errors.

    Two minima that differ agree in B bits by chance with 2^-B, so the expected share is t + (1 - t) 2^-B, and the
    estimate of the similarity is (share - 2^-B) / (1 - 2^-B).
    """
    p = threshold + (1 - threshold) / (1 << B)
    return int(np.floor(HASHES * p - MARGIN * np.sqrt(HASHES * p * (1 - p))))


def place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def id_map(ids: DataFrame) -> np.ndarray:
    """Packed bits, one set for the hash of each id: what the driver gets is bounded by MAP_BITS.

    A map of n ids lets one in sixteen of the others pass; beyond the upper bound (32 MB, some 16 million ids) it lets
    more of them pass, and what passes is settled by joins. Ids should be of a table that is cheap to count.
    """
    least, most = MAP_BITS
    n = min(most, max(least, 1 << (16 * max(1, ids.count()) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n // 64, np.uint64)
        for batch in batches:
            at = place(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64), n)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(bits)
        for at in np.array_split(some, -(-len(some) // 10000) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].view(np.int64))], ["at", "word"])

    out = np.zeros(n // 64, np.uint64)
    found = ids.mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return out


def possible(bits, inside: bool):
    """Keeps the rows whose id, in the first column, may be (or can't be) in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            ids = batch.column(0)
            at = place(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 64 * len(known))
            there = (known[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(there == inside))

    return run


def set_rows(k: int, bits):
    """(doc_id, thash, shingles) of the documents (doc_id, text, thash) that may be in the map; shingles are sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(possible(bits, True)(batches)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tobytes() for s in shingle_sets(*utf8(batch.column(1)), k)], pa.binary())], ["doc_id", "thash", "shingles"])

    return run


def confirm(threshold: float):
    """Keeps the pairs (a, b, x, y) whose sets x and y are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    return run


def enough(common, n, m, threshold: float):
    """Jaccard similarity at least the threshold, in whole hundredths."""
    return 100 * common >= round(100 * threshold) * (n + m - common)


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each of the left sets has in common with each of the right ones.

    Shingles in the same sets are one column, weighed by their number; most of what near copies share is.
    """
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    times = np.diff(np.append(first, len(every)))
    # two sums over the owners' marks name the set of owners
    marks = [mix64(np.arange(1 + i, len(sets) + 1 + i, dtype=np.uint64) + np.uint64(i << 32)) for i in (0, 7)]
    names = np.stack([np.add.reduceat(m[owner], first) for m in marks], axis=1)[times > 1]
    first, times = first[times > 1], times[times > 1]
    common = np.zeros((len(left), len(right)), np.float32)
    if not len(first):
        return common
    _, one, weight = np.unique(names, axis=0, return_index=True, return_counts=True)
    first, times = first[one], times[one]
    for at in range(0, len(first), 1024):
        part = slice(at, at + 1024)
        n = times[part]
        column = np.repeat(np.arange(len(n)), n)
        row = owner[np.repeat(first[part], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        x = np.zeros((len(sets), len(n)), np.float32)
        x[row, column] = 1
        common += x[left] @ (x[right] * weight[part].astype(np.float32)).T
    return common


def block_links(threshold: float):
    """Links of a spanning forest over a block of nodes that are outside (own i, side 0) and one of all nodes of a bucket (own j)."""

    def run(key, rows):
        nodes, labels, side = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["side"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        common = shared_counts(sets, left, right)
        parent = {x: x for x in labels.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for p, a in enumerate(left.tolist()):
            ok = enough(common[p].astype(np.int64), sizes[a], sizes[right], threshold) & (labels[right] != labels[a])
            for b in right[ok].tolist():
                x, y = root(int(labels[a])), root(int(labels[b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((nodes[a], nodes[b]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


SIGNATURE = [f"s{i}" for i in range(HASHES * B // 64)]


def named_classes(some: DataFrame) -> DataFrame:
    """(d1, d2, node, doc_id): the sets there are, each with its smallest doc_id and a number of its own.

    The number is that doc_id, unless it stands for several sets; then all but one of those are numbered beyond all ids.
    """
    classes = materialize(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")), "minhash-classes")
    twice = classes.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialize(twice.select("doc_id", "own"), "minhash-twice")
    if twice.isEmpty():
        return classes.select("d1", "d2", F.col("doc_id").alias("node"), "doc_id")
    top = classes.agg(F.max("doc_id")).first()[0]
    spare = classes.join(twice, "doc_id").where("d1 <> own.d1 OR d2 <> own.d2").select("d1", "d2")
    spare = numbered(materialize(spare, "minhash-spare"), "d1", "extra").select("d1", "d2", (F.col("extra") + F.lit(top + 1)).alias("node"))
    return materialize(classes.join(spare, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("node", "doc_id").alias("node"), "doc_id"), "minhash-named")


def confirmed(pairs: DataFrame, signs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links among distinct pairs (a, b): estimated from the signatures, then compared on the full sets."""
    near = (
        pairs.join(signs.select(F.col("node").alias("a"), F.struct(*SIGNATURE).alias("p")), "a")
        .join(signs.select(F.col("node").alias("b"), F.struct(*SIGNATURE).alias("q")), "b")
        .where(f"{agreeing('p', 'q')} >= {least_agreeing(threshold)}")
        .select("a", "b")
    )
    near = materialize(near, "minhash-near")
    checked = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return materialize(checked.select("a", "b", "x", "y").mapInArrow(confirm(threshold), "a long, b long"), "minhash-links")


def outside(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, most) of the buckets in which there are several components; most is the largest one's label."""
    marked = materialize(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "minhash-marked")
    counted = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    largest = materialize(largest.select("key", F.col("top.label").alias("most")), "minhash-largest")
    return materialize(marked.join(largest, "key"), "minhash-outside")


def signed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, thash)."""
    return text_rows(docs).withColumn("thash", F.xxhash64(F.coalesce("text", F.lit(""))))


def linked(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, thash, n_shingles, d1, d2, node, first, label) of every document: its set, the set's number and smallest
    doc_id, and the smallest number that links lead to."""
    spark = docs.sparkSession
    rows = signed_rows(docs)
    bands, depth = banding(threshold)
    run, schema = sign(shingle, bands, depth)
    signed = materialize(rows.mapInArrow(run, schema), "minhash-signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named_classes(some)
    # the class's own row: of the rows with its smallest doc_id the one with the smallest hash of text
    own = some.join(classes.select("d1", "d2", "node", F.col("doc_id").alias("first")), ["d1", "d2"]).where("doc_id = first")
    nodes = materialize(own.groupBy("node").agg(F.min(F.struct("thash", "doc_id", *SIGNATURE, "bands")).alias("r")).select("node", "r.*"), "minhash-nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(banded.join(materialize(buckets, "minhash-buckets"), "key"), "minhash-members")
    signs = nodes.select("node", *SIGNATURE)
    wanted = materialize(members.select("node").distinct().join(nodes.select("node", "doc_id", "thash"), "node"), "minhash-wanted")
    bits = spark.sparkContext.broadcast(id_map(wanted.select("doc_id")))
    sets = rows.mapInArrow(set_rows(shingle, bits), "doc_id long, thash long, shingles binary").dropDuplicates(["doc_id", "thash"])
    sets = materialize(sets.join(wanted, ["doc_id", "thash"]).select("node", "shingles"), "minhash-sets")
    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(confirmed(pairs, signs, sets, threshold))
    crowded = members.where("size > 2").select("key", "node")
    apart = outside(crowded, labels)
    for attempt in range(CENTRES):
        if apart.isEmpty():
            break
        centre = apart.where("label = most").groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(attempt), "node"), "node")).alias("c")).select("key", F.col("c.node").alias("a"))
        stray = apart.where("label <> most")
        tried = stray.select("node").distinct().count()
        links = confirmed(stray.join(centre, "key").select("a", F.col("node").alias("b")).distinct(), signs, sets, threshold)
        gained = links.select("b").distinct().count()
        if gained:
            labels = contract(labels, links)
            apart = outside(crowded, labels)
        if gained * FRUITFUL < tried:
            break
    found = materialize(cells(apart, sets).groupBy("key", "i", "j").applyInArrow(block_links(threshold), "a long, b long").distinct(), "minhash-more")
    if not found.isEmpty():
        labels = contract(labels, found)
    for used in (members, sets, nodes, apart):
        drop(used)
    out = signed.join(classes.withColumnRenamed("doc_id", "first"), ["d1", "d2"], "left").select("doc_id", "thash", "n_shingles", "d1", "d2", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"), "first")
    return out.join(labels, "node", "left").select("doc_id", "thash", "n_shingles", "d1", "d2", "node", "first", F.coalesce("label", "node").alias("label"))


def cells(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, i, j, side, node, label, shingles): blocks of the nodes outside their bucket's largest component (side 0) with blocks of all (side 1).

    A node goes to a block by its hash; there are so many that one has no more than BLOCK nodes and BLOCK_BYTES on the average.
    """
    sized = apart.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node")
    stray = F.col("label") != F.col("most")
    counted = sized.groupBy("key").agg(F.count_if(stray).alias("m"), F.sum(F.when(stray, F.col("bytes"))).alias("mb"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("nb"))
    share = lambda whole, most: F.greatest(F.lit(most / 4), F.least(F.lit(most), F.col(whole) / SPREAD))
    blocks = lambda n, b: F.greatest(F.ceil(F.col(n) / share("n", BLOCK)), F.ceil(F.col(b) / share("nb", BLOCK_BYTES))).cast("int")
    plan = materialize(counted.select("key", blocks("m", "mb").alias("m"), blocks("n", "nb").alias("n")), "minhash-plan")
    dealt = sized.join(plan, "key")
    whole = F.sequence(F.lit(0), F.col("m") - 1), F.sequence(F.lit(0), F.col("n") - 1)
    left = dealt.where(stray).select("key", "node", "label", F.lit(0).alias("side"), F.pmod(F.xxhash64("node"), "m").cast("int").alias("i"), F.explode(whole[1]).alias("j"))
    right = dealt.select("key", "node", "label", F.lit(1).alias("side"), F.explode(whole[0]).alias("i"), F.pmod(F.xxhash64("node"), "n").cast("int").alias("j"))
    return left.unionByName(right).join(sets, "node").select("key", "i", "j", "side", "node", "label", "shingles")


def groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    mark = scratch_mark()
    found = materialize(linked(docs, shingle, threshold).select("doc_id", "n_shingles", "first", "label"), "minhash-linked")
    drop_since(docs.sparkSession, mark, found)
    # numbers beyond all ids are no names: a component bears the smallest doc_id of its sets
    odd = materialize(found.groupBy("label").agg(F.min("first").alias("name")).where("name <> label"), "minhash-odd")
    if not odd.isEmpty():
        found = found.join(odd, "label", "left").withColumn("label", F.coalesce("name", "label"))
    out = found.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents with one of each group left: of the smallest doc_id, and there of the smallest hash of text.

    A row falls for its own text: rows with one doc_id and different texts are documents of their own. Of rows alike in
    both one stays. Only the rows that a bounded map of ids can't clear are shuffled.
    """
    spark = docs.sparkSession
    mark = scratch_mark()
    found = materialize(linked(docs, shingle, threshold).where("doc_id IS NOT NULL").select("doc_id", "thash", "label"), "minhash-found")
    drop_since(spark, mark, found)
    stays = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "thash")).alias("k"))
    fallen = found.join(stays, "label").where("doc_id <> k.doc_id OR thash <> k.thash").select("doc_id", "thash")
    twice = found.groupBy("doc_id", "thash").count().where("count > 1").select("doc_id", "thash")
    fallen = materialize(fallen.distinct(), "minhash-fallen")
    bits = spark.sparkContext.broadcast(id_map(materialize(fallen.unionAll(twice).select("doc_id").distinct(), "minhash-doubtful")))
    own, text = "_id", "_hash"
    while own in docs.columns or text in docs.columns:
        own, text = own + "_", text + "_"
    rows = docs.select(F.col("doc_id").cast("long").alias(own), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(text), *docs.columns)
    clear = rows.mapInArrow(possible(bits, False), rows.schema).drop(own, text)
    check = rows.mapInArrow(possible(bits, True), rows.schema)
    left = check.join(fallen.select(F.col("doc_id").alias(own), F.col("thash").alias(text)), [own, text], "left_anti").dropDuplicates([own, text]).drop(own, text)
    return clear.unionByName(left).select(docs.columns)
