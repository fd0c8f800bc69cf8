"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items, scanned once over each text.

A-Z are lower-cased and words are the runs of ASCII letters, ASCII digits and non-ASCII characters. An item's windows
are its runs of WINDOW words; an item of fewer words, but not none, is one window. Words of a document inside any
occurrence of a window are hit; the document is contaminated if they are at least a SHARE-th of its words.

The benchmark's words are numbered and the automaton runs over numbers, a state for each word of a window instead of one
for each letter; words that the benchmark hasn't are 0, which no window has. Items are held in chunks that overlap by a
window less a word. A benchmark of more than SHARD_BYTES of words is dealt over several automata: each is built alone in
its task, documents are scanned once for each, and what they have hit is united by document. Nothing is refused, and no
process holds more than one shard's automaton (88 MB for 1 MB of words of six bytes).

Defined results: null texts have no words; an item whose text has no words has no windows; items may repeat (an item_id
counts once); an item without an item_id marks the words that it hits and is in no list of items; rows that are alike are
judged each for itself; texts may be as long as they like, and are whole in memory one at a time; empty tables of either
kind work. Columns other than doc_id and text are passed through by clean() and not read by scan().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prepare, slices, text_rows, texts

WINDOW = 13
SHARE = 20
#: Words of items, in bytes, in one automaton, on the average if there are several; and words in a chunk of an item.
SHARD_BYTES = 2 << 20
CHUNK = 1 << 14

#: Maps bytes of UTF-8 to themselves, lower-cased, or to a space between words.
NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class Scanner:
    """The automaton over the windows of (item_id, words) chunks."""

    def __init__(self, chunks: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.sizes: list[int] = []
        self.owners: list[str | None | set[str]] = []
        for item, body in chunks:
            own = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in body.split())
            for i in range(max(1, len(own) - window + 1) if own else 0):
                self.add(own[i : i + window], item)
        self.least = min(self.sizes, default=0)
        if self.sizes:
            self.auto.make_automaton()

    def add(self, key: tuple[int, ...], item: str | None) -> None:
        at = self.auto.get(key, -1)
        if at < 0:
            self.auto.add_word(key, len(self.sizes))
            self.sizes.append(len(key))
            self.owners.append(item)
        elif item is not None and item != self.owners[at]:
            had = self.owners[at]
            self.owners[at] = {item} if had is None else {item, had} if isinstance(had, str) else had | {item}

    def hits(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of a text's words that are hit, ascending, and the items found."""
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.sizes or not own:
            return runs, items
        ids = np.fromiter(map(self.numbers.get, own, repeat(0)), np.int64, len(own))
        # no window has a 0, so the automaton reads the runs between them that are long enough for one
        edge = np.diff(np.concatenate([[False], ids > 0, [False]]).view(np.int8))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        found = []
        for i in np.flatnonzero(ends - begins >= self.least).tolist():
            a, b = int(begins[i]), int(ends[i])
            found += [(a + end + 1 - self.sizes[at], a + end + 1, at) for end, at in self.auto.iter(tuple(ids[a:b].tolist()))]
        for a, b, at in sorted(found):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
            names = self.owners[at]
            if names is not None:
                items |= {names} if isinstance(names, str) else names
        return runs, items


_scanners: dict[tuple[str, int], Scanner] = {}


def built(name: str, chunks, window: int) -> Scanner:
    """One at a time for each worker process, of the chunks in a broadcast."""
    if (name, window) not in _scanners:
        _scanners.clear()
        _scanners[name, window] = Scanner(chunks.value, window)
    return _scanners[name, window]


def spans(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as code points of the text as it was, end exclusive."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(points[begins[a]]), "end": int(points[ends[b - 1]])} for a, b in runs]


def contaminated(words: int, runs: list[tuple[int, int]], share: int) -> bool:
    hit = sum(b - a for a, b in runs)
    return hit > 0 and share * hit >= words


def chunks_of(window: int):
    """(item_id, words) of (item_id, text): chunks of CHUNK words, of which neighbours share all but the last word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = words(text)
                for i in range(0, max(1, len(own) - window + 1) if own else 0, CHUNK):
                    rows.append((item, b" ".join(own[i : i + CHUNK + window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "words"])

    return run


def shards(items: DataFrame, window: int) -> list[tuple[str, object]]:
    """Names and broadcasts of the chunks of each shard; one shard's chunks are on the driver at a time."""
    spark = items.sparkSession
    prepare(spark)
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    chunks = materialize(rows.mapInArrow(chunks_of(window), "item_id string, words binary"), "benchmark")
    total = chunks.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = -(-total // SHARD_BYTES) or 1
    out = []
    for i in range(n):
        own = chunks if n == 1 else chunks.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == i)
        got = own.toArrow()
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(list(zip(got["item_id"].to_pylist(), got["words"].to_pylist(), strict=True)))))
    return out


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<start: long, end: long>>"


def united(rows: DataFrame, known: list[tuple[str, object]], window: int) -> DataFrame:
    """(doc_id, thash, runs, items) of the rows (doc_id, text, thash) that any shard hits; runs are of words."""

    def scan_shard(name: str, chunks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = built(name, chunks, window)
            for batch in slices(batches):
                found = [scanner.hits(words(t)) for t in texts(batch.column(1))]
                some = pa.array([bool(runs) for runs, _ in found], pa.bool_())
                runs = pa.array([[{"start": a, "end": b} for a, b in runs] for runs, _ in found if runs], SPAN)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(2).filter(some), runs, pa.array([sorted(names) for runs, names in found if runs], pa.list_(pa.string()))], ["doc_id", "thash", "runs", "items"])

        return run

    parts = [rows.mapInArrow(scan_shard(name, chunks), f"doc_id long, thash long, runs {SPANS}, items array<string>").withColumn("shard", F.lit(i)) for i, (name, chunks) in enumerate(known)]
    hit = parts[0]
    for part in parts[1:]:
        hit = hit.unionByName(part)
    # rows that are alike have one result, so a group has a row for each shard at most
    once = hit.dropDuplicates(["doc_id", "thash", "shard"])
    return once.groupBy("doc_id", "thash").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def merged(runs: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Ascending runs, those that touch joined."""
    out: list[tuple[int, int]] = []
    for r in runs:
        if out and r["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(r["end"], out[-1][1]))
        else:
            out.append((r["start"], r["end"]))
    return out


def found_by(known: list[tuple[str, object]], window: int, text_at: int, runs_at: int):
    """Of a batch: each text, its words' number, its runs and items; from the one automaton, or from what united() has left in columns."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[tuple[int, int]], list[str]]]:
        if len(known) == 1:
            scanner = built(*known[0], window)
            for text in texts(batch.column(text_at)):
                own = words(text)
                runs, items = scanner.hits(own)
                yield text, len(own), runs, sorted(items)
        else:
            for text, runs, items in zip(texts(batch.column(text_at)), batch.column(runs_at).to_pylist(), batch.column(runs_at + 1).to_pylist(), strict=True):
                yield text, len(words(text)), merged(runs or []), items or []

    return run


def with_hits(docs: DataFrame, known: list[tuple[str, object]], window: int) -> DataFrame:
    """docs with two more columns, last: the runs and items of united(), null where nothing is hit."""
    hit = materialize(united(text_rows(docs).withColumn("thash", hashed()), known, window), "benchmark-hits")
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    rows = docs.withColumns({f"{mark}id": F.col("doc_id").cast("long"), f"{mark}hash": hashed()})
    found = hit.select(*[F.col(c).alias(mark + c) for c in hit.columns])
    joined = rows.join(found, F.col(f"{mark}id").eqNullSafe(F.col(f"{mark}doc_id")) & (F.col(f"{mark}hash") == F.col(f"{mark}thash")), "left")
    return joined.select(*docs.columns, f"{mark}runs", f"{mark}items")


def hashed(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) for each document; spans are code points of its text."""
    known = shards(items, window)
    rows = text_rows(docs)
    if len(known) > 1:
        rows = with_hits(rows, known, window)
    each = found_by(known, window, 1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [(n, sum(b - a for a, b in runs), found, spans(text, runs), contaminated(n, runs, share)) for text, n, runs, found in each(batch)]
            n, k, found, where, bad = map(list, zip(*got, strict=True)) if got else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(where, SPAN), pa.array(bad, pa.bool_())], ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}, contaminated boolean")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that aren't contaminated, as they were; without a shuffle if one automaton holds the benchmark."""
    known = shards(items, window)
    schema, at, rows = T.StructType(docs.schema.fields), docs.columns.index("text"), docs
    prepare(docs.sparkSession)
    if len(known) > 1:
        rows = with_hits(docs, known, window)
    each, width = found_by(known, window, at, len(docs.columns)), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = [not contaminated(n, runs, share) for _, n, runs, _ in each(batch)]
            yield batch.select(range(width)).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
