"""An unbounded stream over a bounded table: epoch after epoch, each in another order of blocks.

prepare() stores the table once as numbered blocks, where driver and executors reach them: files of BLOCK rows, in which
each smaller block is a row group. The stream's offset is the number of rows it has given, so it says epoch and row; a
micro-batch is the blocks, or parts of them, between two offsets. Where they are many a task reads several. The order of an epoch's blocks is a keyed permutation, told from its number: any
batch can be read again, after a failure or by a query that is resumed, and gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from gristmill.functions.permute import permuted
from gristmill.plans.offsets import numbered
from gristmill.sources.logs import read_manifest, write_manifest
from gristmill.sources.tokenbin import opened

#: Rows of a block, which is what an epoch's order shuffles, and of a micro-batch.
BLOCK, BATCH = 4096, 1 << 16
#: Tasks that a micro-batch has before any reads a second block, and rows of blocks that are read by one.
TASKS, TASK_ROWS = 32, 2 * BLOCK


def prepare(df: DataFrame, order: str, folder: str, block: int = BLOCK) -> int:
    """Store df by its order column as blocks in a new folder; the number of rows."""
    spark = df.sparkSession
    places = numbered(df.select(order), order, "_row")
    per = max(1, BLOCK // block)
    # a file has the number of its first block
    rows = df.join(places, order).withColumn("_block", F.expr(f"_row div {per * block} * {per}"))
    dealt = rows.repartition("_block").sortWithinPartitions("_block", "_row")
    dealt.write.partitionBy("_block").option("parquet.block.row.count.limit", block).parquet(f"{folder}/blocks")
    n = spark.read.schema(df.schema).parquet(f"{folder}/blocks").count()
    write_manifest(f"{folder}/table.json", {"rows": n, "block": block, "per": per, "schema": df.schema.json()})
    return n


@dataclass
class Part(InputPartition):
    epoch: int
    place: int
    block: int
    first: int
    last: int
    #: What the same task reads after it.
    more: tuple[Part, ...] = ()


class CycledReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.batch = int(options.get("rowsperbatch", BATCH))
        self.limit = int(options["rows"]) if options.get("rows") else None
        self.seed = int(options["seed"]) if options.get("seed") else None
        table = read_manifest(f"{self.folder}/table.json")
        self.rows, self.block, self.per = table["rows"], table["block"], table.get("per", 1)
        if not self.rows:
            raise ValueError("an empty table can't be cycled")
        # where the last query of this name stood: what Spark may have planned is never beyond it
        self.progress = f"{self.folder}/progress-{options.get('name', 'stream')}.json"
        self.at = read_manifest(self.progress).get("offset", 0)
        self.kept: tuple[int, Sequence[int]] = (-1, ())

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        at = self.at + self.batch
        at = at if self.limit is None else min(at, self.limit)
        if at != self.at:
            self.at = at
            write_manifest(self.progress, {"offset": at})
        return {"rows": at}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = max(self.at, end["rows"])
        parts = list(self.between(start["rows"], end["rows"]))
        each = max(1, min(len(parts) // TASKS, TASK_ROWS // self.block))
        return [replace(parts[i], more=tuple(parts[i + 1 : i + each])) for i in range(0, len(parts), each)]

    def between(self, start: int, end: int) -> Iterator[Part]:
        """The parts of blocks that rows [start, end) of the stream lie in."""
        blocks = -(-self.rows // self.block)
        for epoch in range(start // self.rows, -(-end // self.rows)):
            # all blocks but the last one are full, so places follow from where the epoch has that
            order = self.order(blocks, epoch)
            last, short = order.index(blocks - 1), blocks * self.block - self.rows
            low, high = max(0, start - epoch * self.rows), min(self.rows, end - epoch * self.rows)
            for slot in range(low // self.block, blocks):
                begin = slot * self.block - (short if slot > last else 0)
                size = self.block - (short if slot == last else 0)
                if begin >= high:
                    break
                if begin + size > low:
                    yield Part(epoch, begin, order[slot], max(low - begin, 0), min(size, high - begin))

    def order(self, blocks: int, epoch: int) -> Sequence[int]:
        """The blocks of an epoch in order, a number for each."""
        if self.seed is None:
            return range(blocks)
        if self.kept[0] != epoch:
            self.kept = epoch, [permuted(s, blocks, self.seed + epoch) for s in range(blocks)]
        return self.kept[1]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        at, files = -1, []
        with ExitStack() as stack:
            for p in (part, *part.more):
                if (first := p.block // self.per * self.per) != at:
                    stack.close()
                    at, files = first, self.files(first, stack)
                begin = (p.block - first) * self.block
                yield from self.stored_rows(files, p, begin + p.first, begin + p.last)

    def files(self, first: int, stack: ExitStack) -> list[pq.ParquetFile]:
        """What is stored from a block on, by name, open until the stack is closed."""
        fs, root = opened(f"{self.folder}/blocks/_block={first}")
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
        return [pq.ParquetFile(stack.enter_context(fs.open_input_file(path))) for path in found]

    def stored_rows(self, files: list[pq.ParquetFile], part: Part, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """Rows [first, last) of files that follow one another, from the row groups that have some of them."""
        at, place = 0, part.place + part.first
        for source in files:
            for group in range(source.num_row_groups):
                size = source.metadata.row_group(group).num_rows
                if at + size <= first or at >= last:
                    at += size
                    continue
                for batch in source.iter_batches(batch_size=1024, row_groups=[group], columns=self.columns):
                    low, high = max(first - at, 0), min(last - at, batch.num_rows)
                    at += batch.num_rows
                    if low >= high:
                        continue
                    n = high - low
                    body = [batch.column(batch.schema.get_field_index(c)).slice(low, n) for c in self.columns]
                    yield pa.RecordBatch.from_arrays([pa.array([part.epoch] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), *body], ["epoch", "place", *self.columns])
                    place += n


class Cycled(DataSource):
    """readStream.format("cycled"): path (of prepare()), rowsPerBatch, rows (where the stream ends; without it never), seed
    (of the orders; without it blocks keep theirs), name (of the query, for its progress)."""

    @classmethod
    def name(cls) -> str:
        return "cycled"

    def stored(self) -> StructType:
        return StructType.fromJson(json.loads(read_manifest(f"{self.options['path']}/table.json")["schema"]))

    def schema(self) -> StructType:
        return StructType([StructField("epoch", LongType()), StructField("place", LongType()), *self.stored().fields])

    def streamReader(self, schema: StructType) -> CycledReader:
        return CycledReader({k.lower(): v for k, v in self.options.items()}, [f.name for f in self.stored().fields])


def stream(spark: SparkSession, folder: str, **options: str | int) -> DataFrame:
    """(epoch, place, …) of a prepared table, without end unless `rows` says where."""
    from gristmill.plans.shipping import ship

    ship(spark)
    spark.dataSource.register(Cycled)
    return spark.readStream.format("cycled").options(**options).load(folder)
