"""Toxic passages by maximum-scoring segments over token log-odds.

Features of a token are the whole word and its first 4, 5 and 6 bytes, hashed to BUCKETS places; invented or inflected
forms of a stem are thus met as well. Features are counted by documents, copies once. A feature's weight is the lower
bound of its log-odds of being toxic, under a Dirichlet prior around the share of toxic documents whose strength follows
the feature's frequency in the whole corpus; a token has the largest weight of its features, each time that its word
stands in a text. Each token's score is its weight less DRIFT, so scores fall outside toxic passages, and all
maximal-scoring segments are found in one linear scan; a segment that repeats a word is scanned anew with the word's
first weight alone, and what it repeats after REST tokens or more is scanned by itself, so near repeats add nothing and a
passage that comes again is found again. The chance of a segment in clean text follows an
extreme-value law P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda and K are fitted to the tail of the scores in clean
labelled documents that gave no weights. What all segments of a document exceed their expectation by, repeats apart, is
summed and turned into a probability by a logistic curve.

What reaches the driver is bounded: SAMPLE labelled rows at most (chosen by a hash of doc_id), a number for each of them
however many segments it has, and BUCKETS counts.

Defined results: a null text is empty, has no segment and gets the score of a document without evidence; with no toxic
label the model knows nothing and every score is 0; labels that are null, or of documents that aren't there, are not
used; a document labelled twice counts as toxic if one label says so; rows that are alike are scored each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix64, prepare, slices, text_rows
from .wordhash import hashes, lowered, utf8, words

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 200_000
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
DRIFT = 0.25
#: Tokens after which a word that comes again begins a passage of its own.
REST = 16
#: Pseudo-counts of the prior over all documents, and standard errors below the estimate at which a weight is taken.
PRIOR, ERRORS = 2_000.0, 1.64
#: The histogram of clean segments' scores, and how many scores the law's tail is fitted on.
BIN, BINS = 1 / 32, 4096
TAIL, LEAST_TAIL = 200, 20
#: A feature seen less often in toxic documents can't have a positive lower bound.
LEAST = 3

_breaks = np.array([not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
_lower = lowered()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, buckets): of each token, and one row of its features' buckets; a short word repeats its own."""
    starts, ends = words(data, offsets, _breaks)
    columns = [hashes(data, starts, ends, _lower)]
    for n in PREFIXES:
        longer = ends - starts > n
        h = columns[0].copy()
        h[longer] = hashes(data, starts[longer], starts[longer] + n, _lower) + np.uint64(n)
        columns.append(h)
    return starts, ends, (np.stack(columns) & np.uint64(BUCKETS - 1)).astype(np.int32)


def segments(at: list[int], weight: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first token, last token), by Ruzzo and Tompa's linear scan.

    at are the ascending places of tokens with a positive weight; all others weigh nothing, and each token costs drift.
    """
    # sum before it, sum to its end, first, last, place in the stack of the nearest one before with a smaller sum before it
    stack: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for place, w in zip(at, weight, strict=True):
        total -= drift * (place - last - 1)
        last = place
        before, total = total, total + w - drift
        if total <= before:
            continue
        left, right, a, b, k = before, total, place, place, len(stack) - 1
        while True:
            while k >= 0 and stack[k][0] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= right:
                stack.append((left, right, a, b, k))
                break
            left, a, after = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = after
    return [(right - left, a, b) for left, right, a, b, _ in stack]


def damped(at: list[int], weight: list[float], word: list[int], drift: float) -> list[tuple[float, int, int]]:
    """All passages of parted(), in order."""
    once, again = parted(at, weight, word, drift)
    return sorted(once + again, key=lambda x: x[1:])


def parted(at: list[int], weight: list[float], word: list[int], drift: float) -> tuple[list[tuple[float, int, int]], list[tuple[float, int, int]]]:
    """The maximal segments, each searched anew with the weight of a word that it repeats taken once, where it is first; and its repeats.

    What a segment repeats at least REST tokens after the word stood there last is searched by itself, a round of repeats
    after the other, so that a passage that comes again is found again; nearer repeats add nothing.
    """
    once, more, k = [], [], 0
    for score, first, last in segments(at, weight, drift):
        while at[k] < first:
            k += 1
        begun, latest = k, {}
        rounds: list[tuple[list[int], list[float]]] = [([], []), ([], [])]
        again: set[int] = set()
        while k < len(at) and at[k] <= last:
            before = latest.get(word[k])
            latest[word[k]] = at[k]
            if before is not None and word[k] in again and at[k] - before >= REST:
                again = set()
                rounds.append(([], []))
            if before is None or at[k] - before >= REST:
                where, left = rounds[0 if before is None else -1]
                where.append(at[k])
                left.append(weight[k])
                if before is not None:
                    again.add(word[k])
            k += 1
        if len(rounds[0][0]) == k - begun:
            once.append((score, first, last))
            continue
        for i, (where, left) in enumerate(rounds):
            if where:
                found = segments([x - where[0] for x in where], left, drift)
                (more if i else once).extend((s, a + where[0], b + where[0]) for s, a, b in found)
    return once, more


@dataclass
class Model:
    """Weights of hashed features, and the calibration of segment scores."""

    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    drift: float = DRIFT
    scale: float = 1.0  # lambda
    chance: float = 1.0  # K
    intercept: float = -math.inf
    slope: float = 0.0

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.bucket] = self.weight
        return out

    def excess(self, scores: list[float], tokens: int) -> float:
        """Nats by which the segments exceed what a clean document of this length is expected to reach."""
        floor = math.log(max(self.chance * tokens, 1.0))
        return sum(max(0.0, self.scale * s - floor) for s in scores)

    def probability(self, scores: list[float], tokens: int) -> float:
        if self.intercept == -math.inf:
            return 0.0
        x = self.intercept + self.slope * self.excess(scores, tokens)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def significant(self, score: float, tokens: int, level: float = 0.01) -> bool:
        return -math.expm1(-self.chance * tokens * math.exp(-self.scale * score)) <= level


Segments = list[tuple[float, int, int]]


def found_in(batch: pa.Array, table: np.ndarray, drift: float) -> list[tuple[int, Segments, Segments, np.ndarray, np.ndarray]]:
    """Of each text: number of tokens, segments, those that repeat one, and all tokens' starts and ends in its bytes.

    Repeats are passages, but no further evidence on the document.
    """
    data, offsets = utf8(batch)
    starts, ends, buckets = features(data, offsets)
    weight = table[buckets[0]]
    for row in buckets[1:]:
        weight = np.maximum(weight, table[row])
    first = np.searchsorted(starts, offsets)
    hot = np.flatnonzero(weight > 0)
    bounds = np.searchsorted(hot, first)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        own = hot[bounds[i] : bounds[i + 1]]
        got = parted((own - a).tolist(), weight[own].tolist(), buckets[0][own].tolist(), drift) if len(own) else ([], [])
        out.append((int(b - a), *got, starts[a:b] - offsets[i], ends[a:b] - offsets[i]))
    return out


def crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def labelled(labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and labels of at most `sample` rows; the labels of every fifth, by another hash, are 2 higher.

    Those are for the calibration: it is fitted on documents that have given no weights.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    rows = (rows if usable is None else rows.where(usable)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # a share by hash first, so that the last sort sees little more than the sample however many labels there are
    share = 1.1 * sample / max(1, rows.count())
    span = 1 << 40
    at = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    got = (rows if share >= 1 else rows.where(at < int(share * span))).orderBy(at, "doc_id").limit(sample).toArrow()
    ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy()
    order = np.argsort(ids)
    later = mix64(ids[order].astype(np.int64).view(np.uint64)) % np.uint64(5) == 0
    return ids[order], toxic[order] + 2 * later


def known_rows(rows: DataFrame, labels: DataFrame, usable: Column | None, sample: int) -> DataFrame:
    """(doc_id, text, label) of the labelled sample, one document for each text, as copies are no further evidence.

    They are picked out of the corpus once and stored, so that fitting reads the corpus itself no more than once again.
    """
    ids, toxic = labelled(labels, usable, sample)
    # at most `sample` rows of two numbers
    known = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64()), "label": pa.array(toxic, pa.int32())})))
    found = materialize(rows.join(known, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label"), "toxicity-labelled")
    first = found.groupBy(F.xxhash64("text").alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    # no more ids than the sample has
    return found.join(F.broadcast(first), "doc_id", "left_semi")


def counted(texts: pa.Array, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text with each bucket that it has, once: numbers of texts, buckets."""
    data, offsets = utf8(texts)
    starts, _, buckets = features(data, offsets)
    return in_texts(np.searchsorted(offsets, starts, "right") - 1, buckets, mask)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from the labels that are usable, and from the counts of all documents."""
    sc = docs.sparkSession.sparkContext
    rows = text_rows(docs)
    known = known_rows(rows, labels, usable, sample)

    def toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Toxic documents with each bucket; at -1 how many there are."""
        count, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in slices(batches):
            documents += batch.num_rows
            some, n = np.unique(counted(batch.column(0))[1], return_counts=True)
            count[some] += n
        some = np.flatnonzero(count)
        for at in np.array_split(some, -(-len(some) // 50_000) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], ["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([documents])], ["bucket", "n"])

    def summed(rows: DataFrame, count: Callable, where: str = "true") -> dict[int, int]:
        """BUCKETS sums at most."""
        got = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(where).toArrow()
        return dict(zip(got["bucket"].to_pylist(), got["n"].to_pylist(), strict=True))

    bad = summed(known.where("label = 1"), toxic_counts, f"n >= {LEAST} OR bucket < 0")
    toxic_documents = bad.pop(-1, 0)
    if not bad:
        return Model()
    name = np.array(sorted(bad), np.int64)
    candidates = np.zeros(BUCKETS, bool)
    candidates[name] = True
    wanted = sc.broadcast(np.packbits(candidates))

    def all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(wanted.value).astype(bool)
        slot = np.cumsum(mask, dtype=np.int32) - 1
        count = np.zeros(int(mask.sum()) + 1, np.int64)  # last, how many documents there are
        for batch in slices(batches):
            count[-1] += batch.num_rows
            count += np.bincount(slot[counted(batch.column(0), mask)[1]], minlength=len(count))
        names = np.append(np.flatnonzero(mask), -1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int32()), pa.array(count[some])], ["bucket", "n"])

    good, every = summed(known.where("label = 0"), all_counts), summed(rows, all_counts)
    if not good.get(-1):
        return Model()
    clean, toxic, everywhere = (np.array([x.get(i, 0) for i in name.tolist()], np.float64) for x in (good, bad, every))
    total = {"clean": float(good[-1]), "toxic": float(toxic_documents), "all": float(every[-1])}
    # Beta posterior of the share of toxic uses, around the corpus's own share; commoner features get the stronger prior
    share = total["toxic"] / (total["toxic"] + total["clean"])
    prior = 1 + PRIOR * everywhere / total["all"]
    n = toxic + clean + prior
    p, z = (toxic + prior * share) / n, ERRORS
    least = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    low = np.log(least / (1 - least)) - math.log(share / (1 - share))
    keep = (low > DRIFT) & (toxic >= LEAST)
    model = Model(name[keep].astype(np.int32), low[keep].astype(np.float32))
    return calibrate(known, model)


def in_texts(text: np.ndarray, buckets: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text with each bucket that it has, once: numbers of texts, buckets."""
    pairs = []
    for row in buckets:
        some = slice(None) if mask is None else np.flatnonzero(mask[row])
        pairs.append(text[some].astype(np.int64) * BUCKETS + row[some])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // BUCKETS, pairs % BUCKETS


def calibrate(known: DataFrame, model: Model) -> Model:
    """Fit the extreme-value law on clean documents and the curve on all, of the labelled ones that gave no weights, over all their segments."""
    sc = known.sparkSession.sparkContext
    rows = known.where("label >= 2").select("text", (F.col("label") - 2).alias("label"))

    def found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[np.ndarray, list[tuple[int, list[float]]]]]:
        """Labels, and of each text the number of tokens and the segments' scores."""
        table = model.table()
        for batch in slices(batches):
            yield batch.column(1).to_numpy(), [(n, [s for s, _, _ in got]) for n, got, *_ in found_in(batch.column(0), table, model.drift)]

    weighed = sc.broadcast(model)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, tokens = np.zeros(BINS, np.int64), 0
        for label, texts in found(batches, weighed.value):
            for n, scores in (x for x, c in zip(texts, label == 0, strict=True) if c):
                tokens += n
                np.add.at(count, np.minimum((np.array(scores) / BIN).astype(np.int64), BINS - 1), 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(count[some], tokens), pa.int64())], ["bin", "n"])

    got = rows.mapInArrow(tails, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counted = dict(zip(got["bin"].to_pylist(), got["n"].to_pylist(), strict=True))
    tokens = counted.pop(-1, 0)
    model.scale, model.chance = tail(np.array([counted.get(i, 0) for i in range(BINS)]), tokens)
    fitted = sc.broadcast(model)

    def excesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, texts in found(batches, fitted.value):
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([fitted.value.excess(s, n) for n, s in texts], pa.float64())], ["label", "excess"])

    # one row for each labelled document of the bounded sample
    got = rows.mapInArrow(excesses, "label int, excess double").toArrow()
    label, x = got["label"].to_numpy(), got["excess"].to_numpy()
    model.intercept, model.slope = logistic(x, (label == 1).astype(float))
    return model


def tail(count: np.ndarray, tokens: int) -> tuple[float, float]:
    """lambda and K of the law from a histogram of the segments of clean text: from the scores over a threshold, the highest
    that TAIL of them, or a tenth if that is more, exceed.

    Over it the law expects K n exp(-lambda x) segments, so scores exceed it exponentially. lambda is taken from the
    median excess, which the few toxic passages in text that is labelled clean don't move.
    """
    beyond = np.append(np.cumsum(count[::-1])[::-1], 0)
    if beyond[0] < LEAST_TAIL or not tokens:
        return 1.0, min(1.0, (beyond[0] + 1) / max(1.0, float(tokens)))
    wanted = max(min(TAIL, beyond[0]), beyond[0] // 10)
    edge = int(np.flatnonzero(beyond >= wanted)[-1])
    n = beyond[edge]
    # the median, within its bin by proportion
    middle = int(np.flatnonzero(beyond > n / 2)[-1])
    at = (middle + (beyond[middle] - n / 2) / max(1, beyond[middle] - beyond[middle + 1])) * BIN
    scale = math.log(2) / max(at - edge * BIN, BIN / 4)
    return scale, float(n) / tokens * math.exp(min(700.0, scale * edge * BIN))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method, the slope held to be positive."""
    a, b = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([(y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b])
        hess = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], max(1e-3, b + step[1])
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): passages are the significant segments, with code points of the text and their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in slices(batches):
            out, where = [], []
            for text, (n, got, again, starts, ends) in zip(batch.column(1), found_in(batch.column(1), table, model.drift), strict=True):
                out.append(model.probability([s for s, _, _ in got], n))
                got = [g for g in sorted(got + again, key=lambda g: g[1:]) if model.significant(g[0], n)]
                raw = np.frombuffer(text.as_buffer(), np.uint8) if got else None
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if got else None
                where.append([{"start": int(points[starts[a]]), "end": int(points[ends[b]]), "score": s} for s, a, b in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(where, pa.list_(passage))], ["doc_id", "score", "passages"])

    rows = text_rows(docs)
    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<start: long, end: long, score: double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, as they were, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in slices(batches):
            got = found_in(batch.column(at), table, model.drift)
            good = [model.probability([s for s, _, _ in x[1]], x[0]) < threshold for x in got]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fitted without the labels of every fifth document by its crc32; (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels, F.pmod(crc(F.col("doc_id")), F.lit(5)) != 0)
    held = F.coalesce(F.pmod(crc(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
