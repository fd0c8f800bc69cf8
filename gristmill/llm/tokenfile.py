"""Token-ID output: files of patched frame-of-reference blocks, in ascending document order, and their reader.

File format (little-endian): a header, then per document its id (and whether it is null) and token count, then per block
of 256 ids its minimum, bit width, place in the payload and place in the exception lists, then the exceptions (position
in the block, value above the width) and the payload. A block's values are taken relative to its minimum and packed at
the least costly of the widths that hold the chosen percentiles of them; wider values keep their low bits there and
their high bits in the exceptions. The index lets a reader decode any range of ids without the blocks before it.

Defined results: a null text is empty; every document has its end id; null doc_ids come first; rows with the same doc_id
are all kept, ordered by their ids; an empty table writes no file. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, materialize, partitions, range_bounds, scratch_path, slices, text_rows
from .encoders import ByteLevelEncoder, encoder
from .wordhash import utf8

BLOCK = 256
MAGIC = b"GRISTPF1"
HEADER = struct.Struct("<8sIIQQQQQ")  # magic, block size, zero, bucket, start in the bucket, documents, ids, exceptions
PERCENTILES = (0.9, 0.95, 0.99, 1.0)
#: Ids in a file, more only for the last document in it.
FILE_IDS = 4 << 20


def bit_width(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> dict[str, np.ndarray]:
    """The arrays of a file's blocks, of unsigned ids below 2^32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid = grid - low[:, None]
    ranked = np.sort(grid, axis=1)
    cost = np.full(blocks, 1 << 30)
    width = np.zeros(blocks, np.int64)
    for p in percentiles:
        w = bit_width(ranked[:, min(BLOCK - 1, int(p * BLOCK))]) if blocks else width
        over = (grid >> w[:, None].astype(np.uint32) > 0).sum(axis=1) if blocks else width
        bits = w * BLOCK + over * 40
        width, cost = np.where(bits < cost, w, width), np.minimum(cost, bits)
    size = width * BLOCK // 8
    payload = np.zeros(int(size.sum()), np.uint8)
    begin = np.cumsum(size) - size
    high = np.where(width[:, None] < 32, grid >> np.minimum(width, 31)[:, None].astype(np.uint32), 0)
    where, place = np.nonzero(high)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 4096)):
            bits = np.unpackbits(grid[part].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - w :]
            payload[begin[part][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(part), -1), axis=1)
    return {
        "low": low.astype("<u4"), "width": width.astype(np.uint8), "begin": begin.astype("<u8"), "patch": np.searchsorted(where, np.arange(blocks)).astype("<u8"),
        "place": place.astype(np.uint8), "high": high[where, place].astype("<u4"), "payload": payload,
    }


def unpack_blocks(f: dict[str, np.ndarray], first: int, last: int) -> np.ndarray:
    """All ids of blocks first <= b < last."""
    out = np.zeros((last - first, BLOCK), np.uint32)
    width, begin = f["width"][first:last].astype(np.int64), f["begin"][first:last].astype(np.int64)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 4096)):
            packed = f["payload"][begin[part][:, None] + np.arange(w * BLOCK // 8)]
            bits = np.zeros((len(part) * BLOCK, 32), np.uint8)
            bits[:, 32 - w :] = np.unpackbits(packed, axis=1).reshape(-1, w)
            out[part] = np.packbits(bits, axis=1).view(">u4").reshape(len(part), BLOCK)
    ends = np.append(f["patch"], len(f["place"])).astype(np.int64)
    a, b = ends[first], ends[last]
    row = np.searchsorted(ends, np.arange(a, b), "right") - 1
    out[row - first, f["place"][a:b]] |= f["high"][a:b] << f["width"][row].astype(np.uint32)
    return (out + f["low"][first:last, None]).ravel()


def to_file(bucket: int, start: int, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    f = pack_blocks(ids)
    head = HEADER.pack(MAGIC, BLOCK, 0, bucket, start, len(docs), len(ids), len(f["place"]))
    known = np.array([x is not None for x in docs], np.uint8)
    named = np.array([x or 0 for x in docs], "<i8")
    return b"".join([head, named.tobytes(), known.tobytes(), lengths.astype("<u8").tobytes(), *(f[k].tobytes() for k in ("low", "width", "begin", "patch", "place", "high", "payload"))])


class TokenFile:
    """Reads one file's bytes; ids(a, b) decodes only the blocks that it needs."""

    def __init__(self, content: bytes):
        magic, block, _, self.bucket, self.start, docs, self.n_ids, patches = HEADER.unpack_from(content)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a token file of this version")
        blocks, at = -(-self.n_ids // BLOCK), HEADER.size
        self.parts: dict[str, np.ndarray] = {}
        for key, dtype, n in (("docs", "<i8", docs), ("known", np.uint8, docs), ("lengths", "<u8", docs), ("low", "<u4", blocks), ("width", np.uint8, blocks), ("begin", "<u8", blocks), ("patch", "<u8", blocks), ("place", np.uint8, patches), ("high", "<u4", patches), ("payload", np.uint8, -1)):
            self.parts[key] = np.frombuffer(content, dtype, n, at) if n and at < len(content) else np.zeros(0, dtype)
            at += self.parts[key].nbytes
        self.docs = [int(x) if k else None for x, k in zip(self.parts["docs"], self.parts["known"], strict=True)]
        self.lengths = self.parts["lengths"].astype(np.int64)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n_ids if b is None else b
        if a >= b:
            return np.zeros(0, np.uint32)
        return unpack_blocks(self.parts, a // BLOCK, -(-b // BLOCK))[a - a // BLOCK * BLOCK : b - a // BLOCK * BLOCK]


def encode_rows(tokenizer: str, kind: type, end_id: int, bounds: list[int]):
    """Rows (bucket, doc_id, n, ids) of unordered documents; bucket is the doc_id's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, enc = np.array(bounds, np.int64), encoder(kind, tokenizer)
        for batch in slices(batches):
            ids, n = enc.encode(*utf8(batch.column(1)))
            ends = np.cumsum(n + 1)
            full = np.full(int(ends[-1]) if len(n) else 0, end_id, enc.dtype)
            keep = np.ones(len(full), bool)
            keep[ends - 1] = False
            full[keep] = ids
            doc = batch.column(0)
            bucket = np.searchsorted(cuts, doc.fill_null(0).to_numpy(zero_copy_only=False), "right")
            bucket = np.where(doc.is_null().to_numpy(zero_copy_only=False), 0, bucket)
            offsets = np.concatenate([np.zeros(1, np.int64), ends]) * enc.dtype.itemsize
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(full)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), doc, blob], ["bucket", "doc_id", "ids"])

    return run


def put(folder: str, name: str, content: bytes) -> None:
    """Write beside, then rename: a file is there whole or not at all, and a second attempt leaves the same bytes."""
    if "://" in folder or folder.startswith("file:"):
        fs, root = pafs.FileSystem.from_uri(folder)
    else:
        fs, root = pafs.LocalFileSystem(), folder
    fs.create_dir(root, recursive=True)
    import uuid

    beside = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as out:
        out.write(content)
    fs.move(beside, f"{root}/{name}")


def write_rows(folder: str, width: int, file_ids: int):
    """Writes sorted rows (bucket, doc_id, ids) to files; yields a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, start, seq, docs, parts, held = None, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal start, seq, docs, parts, held
            name = f"part-{bucket:07d}-{seq:05d}.tokens"
            lengths = np.array([len(p) for p in parts], np.int64)
            put(folder, name, to_file(bucket, start, docs, lengths, np.concatenate(parts)))
            row = pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64())], ["bucket", "file", "n_docs", "n_ids"])
            start, seq, docs, parts, held = start + held, seq + 1, [], [], 0
            return row

        for batch in batches:
            for b, doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket:
                    if docs:
                        yield flush()
                    bucket, start, seq = b, 0, 0
                ids = np.frombuffer(blob.as_buffer(), f"<u{width}")
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
                if held >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, kind: type = ByteLevelEncoder, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of documents (doc_id, text) to files in a folder that all executors reach; return (bucket, file, n_docs, n_ids).

    One shuffle, of packed ids; its ranges of doc_id are cut by the table's own quantiles, a task for each.
    """
    spark = docs.sparkSession
    rows = text_rows(docs)
    bounds = range_bounds(rows, "doc_id", partitions(spark))
    width = encoder(kind, tokenizer).dtype.itemsize
    found = (
        rows.mapInArrow(encode_rows(tokenizer, kind, end_id, bounds), "bucket int, doc_id long, ids binary")
        .repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "doc_id", "ids")
        .mapInArrow(write_rows(folder, width, file_ids), "bucket int, file string, n_docs long, n_ids long")
    )
    return materialize(found, "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, schema: str, each) -> DataFrame:
    """Apply each(file: TokenFile, base) -> RecordBatch to every file; base is the number of ids before the file.

    What goes to the driver is one sum for each bucket, of which there are no more than shuffle partitions.
    """
    sums = {r["bucket"]: r["n"] for r in manifest.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for bucket in sorted(sums):
        base[bucket], before = before, before + sums[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(content.as_py())
                yield each(f, base[f.bucket] + f.start)

    if not sums:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tokens").load(folder)
    return files.select("content").mapInArrow(run, schema)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digest(f: TokenFile, base: int) -> pa.RecordBatch:
    ids = f.ids().astype("<u4")
    ends = np.cumsum(f.lengths)
    view = memoryview(ids).cast("B")
    crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), f.lengths.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(f.docs, pa.int64()), pa.array(base + ends - f.lengths), pa.array(f.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents to token files and tell, from the files, each one's place, length and checksum."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer, end_id), DIGEST, digest)


__all__ = ["TokenFile", "delete_path", "pack_blocks", "read_tokens", "token_digest", "unpack_blocks", "write_tokens"]
