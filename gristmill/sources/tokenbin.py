"""Headerless token files: a Python data source for arrays of unsigned 16- or 32-bit ids, and NumPy shards.

Reading splits files into byte ranges, so one large file is many tasks, and makes a row of each block of ids, not of each
id. Filters on the file's name and the block's place reach the reader, which opens and reads nothing else. Labels that are
stored beside the ids are read at the same places by the same task. Writing makes one file for each part beside the
others and names it when the job is done; a lost task leaves nothing behind.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SIZES = {"uint16": 2, "uint32": 4, "int32": 4}
#: Ids in a read task, and in a row.
TASK_IDS, BLOCK = 4 << 20, 1 << 16


def dtype_for(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 65535 else "uint32"


def token_count(size: int, dtype: str) -> int:
    """Ids in a file of so many bytes."""
    if size % SIZES[dtype]:
        raise ValueError(f"{size} bytes are no whole number of {dtype} ids")
    return size // SIZES[dtype]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path or URI lies in, and the path there."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[pafs.FileInfo]:
    """The .bin files in a folder by name, or the file itself; nothing if there is neither."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.base_name.endswith(".bin") and not f.base_name.startswith(".")), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Ids [first, last) of a file; labels are in the file beside it, `after` has the files that an overlap reaches, with their ids."""

    path: str
    labels: str
    first: int
    last: int
    after: tuple[tuple[str, int], ...] = ()


class Bounds:
    """What is asked of a column by filters that were pushed down: a least and a greatest value, or a set of them."""

    def __init__(self):
        self.least, self.most, self.among = None, None, None

    def take(self, f: Filter) -> bool:
        """Whether the filter is taken over."""
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.among = values if self.among is None else self.among & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            least = f.value + isinstance(f, GreaterThan)
            self.least = least if self.least is None else max(self.least, least)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            most = f.value - isinstance(f, LessThan)
            self.most = most if self.most is None else min(self.most, most)
        else:
            return isinstance(f, IsNotNull)
        return True

    def holds(self, value: int | str) -> bool:
        return (self.least is None or value >= self.least) and (self.most is None or value <= self.most) and (self.among is None or value in self.among)

    def span(self, n: int) -> tuple[int, int]:
        """The places [a, b) of 0..n that may hold."""
        low = [x for x in (self.least, min(self.among, default=n) if self.among is not None else None) if x is not None]
        high = [x for x in (self.most, max(self.among, default=-1) if self.among is not None else None) if x is not None]
        return max([0, *low]), min([n, *(x + 1 for x in high)])


class TokenBinReader(DataSourceReader):
    """Rows (file, start, ids), a block of ids to a row; with `overlap`, a block's row also has as many of the ids that follow it.

    Filters on `file` and `start` are taken over: files and blocks that they rule out are not opened, not read, not sent.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.dtype = options["path"], options.get("dtype", "uint16")
        self.block, self.overlap = int(options.get("block", BLOCK)), int(options.get("overlap", 0))
        self.labels, self.labels_dtype = options.get("labels", ""), options.get("labelsdtype", "int32")
        per_task = int(options.get("idspertask", TASK_IDS))
        self.per_task = max(1, per_task // self.block) * self.block
        self.bounds = {"file": Bounds(), "start": Bounds()}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            # a start is compared with whole numbers, a name is only looked up
            known = name == "start" or (name == "file" and isinstance(f, (EqualTo, In, IsNotNull)))
            if not known or not self.bounds[name].take(f):
                yield f

    def partitions(self) -> list[Range]:
        out = []
        files = listed(self.path)
        beside = {f.base_name: f for f in listed(self.labels)} if self.labels else {}
        if self.labels and set(beside) != {f.base_name for f in files}:
            raise ValueError("tokens and labels have different files")
        for place, f in enumerate(files):
            n = token_count(f.size, self.dtype)
            if self.labels and token_count(beside[f.base_name].size, self.labels_dtype) != n:
                raise ValueError(f"tokens and labels differ in length: {f.base_name}")
            if self.bounds["file"].holds(f.base_name):
                a, b = self.bounds["start"].span(n)
                first = -(-a // self.block) * self.block
                after = self.reached(files, place)
                out += [Range(f.path, beside[f.base_name].path if self.labels else "", x, min(n, -(-b // self.block) * self.block, x + self.per_task), after) for x in range(first, b, self.per_task)]
        return out or [Range("", "", 0, 0)]

    def reached(self, files: list[pafs.FileInfo], place: int) -> tuple[tuple[str, int], ...]:
        """The files after one that its last block's overlap reaches, and their ids; the folder is listed once, not by each task."""
        out, wanted = [], self.overlap
        while wanted > 0 and (place := place + 1) < len(files):
            out.append((files[place].path, token_count(files[place].size, self.dtype)))
            wanted -= out[-1][1]
        return tuple(out)

    def following(self, fs: pafs.FileSystem, after: tuple[tuple[str, int], ...], wanted: int) -> np.ndarray:
        """The first ids of the files after this one."""
        parts = []
        for path, held in after:
            if wanted <= 0:
                break
            n = min(wanted, held)
            with fs.open_input_file(path) as source:
                parts.append(stored(source, 0, n, self.dtype))
            wanted -= n
        return np.concatenate(parts) if parts else np.zeros(0, np.dtype(self.dtype))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, name = opened(self.path)[0], partition.path.rpartition("/")[2]
        kind = pa.int64() if self.dtype == "uint32" else pa.int32()
        with ExitStack() as stack:
            source = stack.enter_context(fs.open_input_file(partition.path))
            other = stack.enter_context(opened(self.labels)[0].open_input_file(partition.labels)) if partition.labels else None
            total = token_count(source.size(), self.dtype)
            for a in range(partition.first, partition.last, self.block):
                if not self.bounds["start"].holds(a):
                    continue
                n = min(self.block, partition.last - a)
                end = min(total, a + n + self.overlap)
                ids = stored(source, a, end - a, self.dtype)
                if self.overlap and end == total:
                    ids = np.concatenate((ids, self.following(fs, partition.after, a + n + self.overlap - end)))
                columns = [pa.array([name]), pa.array([a], pa.int64()), one_list(ids, kind)]
                names = ["file", "start", "ids"]
                if other is not None:
                    columns.append(one_list(stored(other, a, n, self.labels_dtype), pa.int32()))
                    names.append("labels")
                yield pa.RecordBatch.from_arrays(columns, names)


def stored(source: pa.NativeFile, first: int, n: int, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype).newbyteorder("<")
    return np.frombuffer(source.read_at(n * kind.itemsize, first * kind.itemsize), kind)


def one_list(ids: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(kind.to_pandas_dtype())))


@dataclass
class Wrote(WriterCommitMessage):
    path: str
    name: str
    ids: int


class TokenBinWriter(DataSourceArrowWriter):
    """Rows (part, start, ids), where each task holds whole parts in order, as after repartition and sortWithinPartitions."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        written: dict[int, str] = {}
        limits, ids, at, out = np.iinfo(self.dtype), 0, None, None
        try:
            for batch in batches:
                parts = batch.column(batch.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
                lists = batch.column(batch.schema.get_field_index("ids"))
                for p in np.unique(parts).tolist():  # parts come in order, each in one stretch
                    if p != at:
                        if out is not None:
                            out.close()
                        at, written[p] = p, f"{root}/.part-{p:06d}-{uuid.uuid4().hex}"
                        out = fs.open_output_stream(written[p])
                    own = np.flatnonzero(parts == p)
                    tok = lists.slice(int(own[0]), len(own)).flatten().to_numpy(zero_copy_only=False)
                    if len(tok) and (tok.max() > limits.max or tok.min() < limits.min):
                        raise ValueError(f"an id doesn't fit into {self.dtype}")
                    out.write(tok.astype(np.dtype(self.dtype).newbyteorder("<")).tobytes())
                    ids += len(tok)
        finally:
            if out is not None:
                out.close()
        return Wrote("\n".join(written.values()), "\n".join(f"part-{p:06d}.bin" for p in written), ids)

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for a, b in zip(m.path.split("\n"), m.name.split("\n"), strict=True) if m and m.path else ():
                fs.move(a, f"{root}/{b}")

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            for a in m.path.split("\n") if m and m.path else ():
                if fs.get_file_info(a).type == pafs.FileType.File:
                    fs.delete_file(a)


class TokenBinStreamWriter(DataSourceStreamArrowWriter):
    """A micro-batch's rows (part, start, ids), where a part's rows are in one task, in any order: part-{part}-{batch}.bin.

    What a batch has written is named when all its tasks are done, and then noted under its number. A batch that comes
    again finds the note, and what it has written is dropped; without the note what is left of it is removed first. So
    each batch is there once. A task holds its rows of one micro-batch.
    """

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        limits, pieces = np.iinfo(self.dtype), []
        for batch in batches:
            part, start, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "start", "ids"))
            for i, (p, s) in enumerate(zip(part.to_pylist(), start.to_pylist(), strict=True)):
                ids = lists.slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.max() > limits.max or ids.min() < limits.min):
                    raise ValueError(f"an id doesn't fit into {self.dtype}")
                pieces.append((p, s, ids.astype(np.dtype(self.dtype).newbyteorder("<"))))
        paths, names = [], []
        pieces.sort(key=lambda x: x[:2])
        for p, own in groupby(pieces, key=lambda x: x[0]):
            paths.append(f"{root}/.part-{p:06d}-{uuid.uuid4().hex}")
            names.append(f"part-{p:06d}")
            with fs.open_output_stream(paths[-1]) as out:
                for _, _, ids in own:
                    out.write(ids.tobytes())
        return Wrote("\n".join(paths), "\n".join(names), sum(len(ids) for *_, ids in pieces))

    def commit(self, messages: list[Wrote | None], batchId: int) -> None:  # noqa: N803
        fs, root = opened(self.path)
        note = f"{root}/_batches/{batchId:09d}"
        if fs.get_file_info(note).type == pafs.FileType.File:
            self.abort(messages, batchId)
            return
        made = [x for m in messages if m and m.path for x in zip(m.path.split("\n"), m.name.split("\n"), strict=True)]
        if len({name for _, name in made}) < len(made):
            raise ValueError("a part's rows must be in one task")
        for f in listed(self.path):
            if f.base_name.endswith(f"-{batchId:09d}.bin"):
                fs.delete_file(f.path)
        for path, name in made:
            fs.move(path, f"{root}/{name}-{batchId:09d}.bin")
        fs.create_dir(f"{root}/_batches", recursive=True)
        with fs.open_output_stream(note) as out:
            out.write("\n".join(sorted(name for _, name in made)).encode())

    def abort(self, messages: list[Wrote | None], batchId: int) -> None:  # noqa: N803
        TokenBinWriter(self.path, self.dtype).abort(messages)


class TokenBin(DataSource):
    """format("tokenbin"): options path and dtype (uint16, uint32, int32); for reads also block (ids of a row), overlap (ids
    that a row has of what follows its block), labels and labelsDtype (a folder of files of the same names and lengths,
    read at the same places), idsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        ids = "bigint" if self.options.get("dtype") == "uint32" else "int"
        return f"file string, start bigint, ids array<{ids}>" + (", labels array<int>" if self.options.get("labels") else "")

    def reader(self, schema: StructType) -> TokenBinReader:
        return TokenBinReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> TokenBinWriter:
        path = self.options["path"]
        if old := listed(path):
            if not overwrite:
                raise FileExistsError(f"{path} isn't empty")
            for f in old:
                opened(path)[0].delete_file(f.path)
        return TokenBinWriter(path, self.options.get("dtype", "uint16"))

    def streamWriter(self, schema: StructType, overwrite: bool) -> TokenBinStreamWriter:
        return TokenBinStreamWriter(self.options["path"], self.options.get("dtype", "uint16"))


def write_stream(pieces: DataFrame, path: str, dtype: str, checkpoint: str):
    """Start a query that writes a stream of rows (part, start, ids), each micro-batch once."""
    register(pieces.sparkSession)
    dealt = pieces.select(F.col("part").cast("long").alias("part"), "start", "ids").repartition("part")
    return dealt.writeStream.format("tokenbin").option("dtype", dtype).option("checkpointLocation", checkpoint).start(path)


def register(spark: SparkSession) -> None:
    from gristmill.plans.shipping import ship

    ship(spark)
    spark.dataSource.register(TokenBin)
    # Spark asks sources in Python for filters only where it is told to
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pieces: DataFrame, path: str, dtype: str, overwrite: bool = False, ids: str = "ids") -> None:
    """Write rows (part, start, ids), a file for each part; a piece is shuffled to its part as an array, not id by id."""
    register(pieces.sparkSession)
    dealt = pieces.select("part", "start", F.col(ids).alias("ids")).repartition("part").sortWithinPartitions("part", "start")
    dealt.write.format("tokenbin").option("dtype", dtype).mode("overwrite" if overwrite else "append").save(path)


def read(spark: SparkSession, path: str, dtype: str, **options: str | int) -> DataFrame:
    """(file, start, ids) by blocks; with labels=folder also the labels at the same places. See TokenBin for options."""
    register(spark)
    return spark.read.format("tokenbin").options(dtype=dtype, **options).load(path)


def counts(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """(path, ids) from the files' sizes alone."""
    size = SIZES[dtype]
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    bad = F.raise_error(F.concat(F.lit("no whole number of ids: "), F.col("path")))
    return files.select("path", F.when(F.col("length") % size == 0, F.floor(F.col("length") / size)).otherwise(bad.cast("long")).alias("ids"))


def write_npy(shards: DataFrame, folder: str, prefix: str = "train") -> DataFrame:
    """Write rows (shard, tokens) to {prefix}-{shard:06d}.npy in a shared folder; (shard, file, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for shard, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.values.to_numpy(zero_copy_only=False)
                if len(ids) and ids.max() > 65535:
                    raise ValueError("an id doesn't fit into 16 bits")
                body, beside = io.BytesIO(), f"{root}/.{uuid.uuid4().hex}.npy"
                np.save(body, ids.astype(np.uint16))
                with fs.open_output_stream(beside) as out:
                    out.write(body.getvalue())
                fs.move(beside, f"{root}/{prefix}-{shard:06d}.npy")
                names.append(f"{prefix}-{shard:06d}.npy")
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(sizes, pa.int64())], ["shard", "file", "ids"])

    return shards.select(F.col("shard").cast("long").alias("shard"), "tokens").mapInArrow(run, "shard long, file string, ids long")


def read_npy(spark: SparkSession, folder: str, prefix: str = "train") -> DataFrame:
    """(file, ids) of the shards in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), one_list(np.load(io.BytesIO(content)), pa.int32())], ["file", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}-*.npy").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, ids array<int>")
