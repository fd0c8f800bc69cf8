"""Packing documents into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities.

A document's ids are cut into full sequences and one rest. Documents are dealt into randomised groups of about
GROUP_DOCS by a hash of their row, their partition and how many rows like them came before in it, so repeated rows spread
over the groups too, and a partition that is read again in another order deals the same. Each group is packed by itself,
so no task depends on the corpus; what a task holds beside a group is a counter for each row of its partition.
The tree holds the free room of each open bin at its leaves and the larger child's above; the leftmost bin with room for
a rest is found in log(bins) steps.

Defined results: a null text is empty, and a document always has its end id; rows that are alike are packed each for
itself; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, text_rows
from .encoders import WordEndEncoder, encoder
from .wordhash import utf8

GROUP_DOCS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Free room of bins 0..n-1, all empty at first; first(need) is the leftmost with that much, or -1."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.tree = [room] * (2 * self.leaves)
        for i in range(bins, self.leaves):
            self.tree[self.leaves + i] = 0
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self, need: int) -> int:
        tree, i = self.tree, 1
        if tree[1] < need:
            return -1
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        return i - self.leaves

    def take(self, leaf: int, need: int) -> int:
        """Use room in a bin; return how much was free before."""
        tree, i = self.tree, leaf + self.leaves
        free = tree[i]
        tree[i] = free - need
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return free


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each item; ties go in the order given."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree = Tournament(len(lengths), room)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        where[i] = leaf = tree.first(lengths[i])
        offset[i] = room - tree.take(leaf, lengths[i])
    return where, offset


def dealt(hashes: list[int], seen: Counter, partition: int, groups: int) -> list[int]:
    """A group for each row, by its hash; seen counts the rows of the partition so far."""
    before = np.empty(len(hashes), np.uint64)
    for i, h in enumerate(hashes):
        before[i] = seen[h]
        seen[h] += 1
    salt = mix64(before + np.uint64(partition << 32) + np.uint64(1))
    return (mix64(np.array(hashes, np.int64).view(np.uint64) ^ salt) % np.uint64(groups)).astype(np.int64).tolist()


def cut_rows(tokenizer: str, kind: type, end_id: int, room: int, groups: int):
    """Rows of pieces, in the documents' order, with their group: full sequences, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, partition = encoder(kind, tokenizer), Counter(), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4")
        for batch in slices(batches):
            ids, n = enc.encode(*utf8(batch.column(2)))
            ids, at, rows = ids.astype("<u4"), 0, []
            for doc, group, k in zip(batch.column(0).to_pylist(), dealt(batch.column(1).to_pylist(), seen, partition, groups), n.tolist(), strict=True):
                own = np.concatenate([ids[at : at + k], tail])
                at += k
                view = memoryview(own).cast("B")
                rows += [(doc, s, min(room, k + 1 - s), zlib.crc32(view[4 * s : 4 * (s + room)]), k + 1, group) for s in range(0, k + 1, room)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])

    return run


def pack_group(room: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = first_fit_decreasing(rows["length"].tolist(), room)
        return rows.assign(sequence_id=rows["grp"].to_numpy() * (1 << 32) + where, offset=offset).drop(columns="grp")

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 2048, group_docs: int = GROUP_DOCS, kind: type = WordEndEncoder) -> DataFrame:
    """Every id of every document in exactly one piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Only the pieces' places are shuffled, never text or ids.
    """
    rows = text_rows(docs)
    groups = rows.count() // group_docs + 1
    hashed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    cut = hashed.mapInArrow(cut_rows(tokenizer, kind, end_id, room, groups), PIECES + ", grp long")
    return cut.groupBy("grp").applyInPandas(pack_group(room), PIECES + ", sequence_id long, offset long")
