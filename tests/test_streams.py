"""Streams: a table that is cycled, budgets in state, token files; stopped, resumed and run again."""

import os
import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gristmill.functions.permute import permuted, permuted_column
from gristmill.sources import cycled, tokenbin
from gristmill.streaming import budgets


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations_are_bijections_and_columns_agree(spark, n):
    for seed in (0, 5):
        want = [permuted(i, n, seed) for i in range(n)]
        assert sorted(want) == list(range(n))
        got = spark.range(n).select("id", permuted_column(F.col("id"), n, seed).alias("p")).orderBy("id").collect()
        assert [r.p for r in got] == want
    assert n < 10 or [permuted(i, n, 1) for i in range(n)] != [permuted(i, n, 2) for i in range(n)]


def table(spark, folder, n=50, block=8):
    df = spark.createDataFrame([(i * 3, f"t{i}") for i in range(n)], "doc_id long, text string").repartition(4)
    assert cycled.prepare(df, "doc_id", folder, block) == n


@pytest.mark.parametrize("seed", [None, 7])
def test_epochs_go_on_where_a_stopped_query_was(spark, tmp_path, seed):
    folder, out, check = (str(tmp_path / x) for x in ("table", "out", "check"))
    table(spark, folder)
    extra = {} if seed is None else {"seed": seed}
    for rows in (61, 61, 125):
        query = cycled.stream(spark, folder, rowsPerBatch=13, rows=rows, **extra).writeStream.format("parquet").option("checkpointLocation", check).start(out)
        query.processAllAvailable()
        query.stop()
    got = sorted((r.epoch, r.place, r.doc_id // 3, r.text) for r in spark.read.parquet(out).collect())
    assert [(e, p) for e, p, *_ in got] == [(i // 50, i % 50) for i in range(125)] and all(t == f"t{i}" for _, _, i, t in got)
    orders = [[i for e, _, i, _ in got if e == epoch] for epoch in range(3)]
    for order in orders[:2]:
        assert sorted(order) == list(range(50))
    # blocks of eight stay together; the seed tells their order
    blocks = list(range(7)) if seed is None else [permuted(s, 7, seed + 1) for s in range(7)]
    assert orders[1] == [i for b in blocks for i in range(8 * b, min(50, 8 * b + 8))]
    assert (orders[0] == orders[1]) == (seed is None)
    assert len(os.listdir(f"{check}/offsets")) >= 9


def test_an_unbounded_stream_has_no_end(spark, tmp_path):
    folder = str(tmp_path / "table")
    table(spark, folder)
    reader = cycled.CycledReader({"path": folder, "rowsperbatch": "40"}, ["doc_id", "text"])
    ends = [reader.latestOffset()["rows"] for _ in range(6)]
    assert ends == [40, 80, 120, 160, 200, 240]
    parts = reader.partitions({"rows": 40}, {"rows": 80})
    assert [(p.epoch, p.place + 0, p.block, p.first, p.last) for p in parts] == [(0, 40, 5, 0, 8), (0, 48, 6, 0, 2), (1, 0, 0, 0, 8), (1, 8, 1, 0, 8), (1, 16, 2, 0, 8), (1, 24, 3, 0, 6)]
    assert cycled.CycledReader({"path": folder, "rowsperbatch": "40"}, []).latestOffset() == {"rows": 280}
    with pytest.raises(ValueError):
        cycled.prepare(spark.createDataFrame([], "doc_id long"), "doc_id", str(tmp_path / "none"))
        cycled.CycledReader({"path": str(tmp_path / "none")}, [])


def looped(rows, train, validation):
    have, out = {}, []
    for key, epoch, place, n, held in rows:
        t, v = have.get(key, (0, 0))
        side = "validation" if held and v < validation else "train" if t < train else "validation" if v < validation else None
        start = {"train": t, "validation": v, None: 0}[side]
        written = min(n, {"train": train - t, "validation": validation - v, None: 0}[side])
        have[key] = (t + written * (side == "train"), v + written * (side == "validation"))
        out.append((key, epoch, place, side, start, written, n - written))
    return sorted(out, key=str)


def test_budgets_survive_restarts(spark, tmp_path):
    r = random.Random(1)
    folder, out, check = (str(tmp_path / x) for x in ("table", "out", "check"))
    rows = [(i, "hot" if r.random() < 0.5 else f"s{i % 4}", r.randint(1, 9), r.random() < 0.3) for i in range(60)]
    cycled.prepare(spark.createDataFrame(rows, "doc_id long, source string, n long, held boolean"), "doc_id", folder, 7)
    for end in (70, 150):
        stream = budgets.routed(cycled.stream(spark, folder, rowsPerBatch=25, rows=end), "source", ["epoch", "place"], 200, 30)
        query = stream.writeStream.format("parquet").option("checkpointLocation", check).start(out)
        query.processAllAvailable()
        query.stop()
    got = sorted((tuple(x[c] for c in ("source", "epoch", "place", "split", "start", "written", "skipped")) for x in spark.read.parquet(out).collect()), key=str)
    assert got == looped([(rows[i % 60][1], i // 60, i % 60, *rows[i % 60][2:]) for i in range(150)], 200, 30)
    assert {x[3] for x in got} == {"train", "validation", None}


def test_a_batch_that_comes_again_is_there_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("table", "out", "check"))
    df = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("part"), (F.col("id") * 5).alias("start"), F.expr("array(cast(id as int), 7, 7)").alias("ids"))
    cycled.prepare(df, "doc_id", folder, 6)

    def run(rows):
        stream = cycled.stream(spark, folder, rowsPerBatch=11, rows=rows).withColumn("start", F.col("start") + 1000 * F.col("epoch"))
        query = tokenbin.write_stream(stream, out, "uint16", check)
        query.processAllAvailable()
        query.stop()

    def stored():
        found = {}
        for r in tokenbin.read(spark, out, "uint16").orderBy("file", "start").collect():
            found.setdefault(int(r.file[5:11]), []).extend(r.ids)
        return found

    want = {p: [x for e in range(2) for i in range(40) if i % 3 == p and e * 40 + i < 60 for x in (i, 7, 7)] for p in range(3)}
    run(44)
    # as if the query had been lost after its sink had the last batch, before Spark noted it
    last = max(int(f) for f in os.listdir(f"{check}/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.remove(f"{check}/commits/{name}")
    run(60)
    assert stored() == want
    assert not [f for f in os.listdir(out) if f.startswith(".part")]


def test_what_is_left_of_a_batch_that_failed_is_removed(tmp_path):
    path = str(tmp_path / "bins")
    writer = tokenbin.TokenBinStreamWriter(path, "uint16")

    def batch(part, start, ids):
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([start]), pa.array([ids], pa.list_(pa.int32()))], ["part", "start", "ids"])

    first = [writer.write(iter([batch(0, 5, [3, 4]), batch(0, 0, [1, 2])])), writer.write(iter([batch(1, 0, [9])])), None]
    writer.commit(first, 0)
    assert sorted(os.listdir(path)) == ["_batches", "part-000000-000000000.bin", "part-000001-000000000.bin"]
    with open(f"{path}/part-000000-000000000.bin", "rb") as f:
        assert f.read() == bytes([1, 0, 2, 0, 3, 0, 4, 0])
    # the note is gone, and what stands there is another try's
    shutil.rmtree(f"{path}/_batches")
    writer.commit([writer.write(iter([batch(0, 0, [8])]))], 0)
    assert sorted(os.listdir(path)) == ["_batches", "part-000000-000000000.bin"]
    writer.commit([writer.write(iter([batch(0, 0, [5, 5])]))], 0)
    assert os.path.getsize(f"{path}/part-000000-000000000.bin") == 2
    twice = [writer.write(iter([batch(2, 0, [1])])), writer.write(iter([batch(2, 1, [1])]))]
    with pytest.raises(ValueError):
        writer.commit(twice, 1)
    writer.abort(twice, 1)
    assert not [f for f in os.listdir(path) if f.startswith(".")]
    with pytest.raises(ValueError):
        writer.write(iter([batch(0, 0, [70000])]))


def test_small_blocks_share_files_and_tasks(spark, tmp_path):
    folder = str(tmp_path / "table")
    n = cycled.BLOCK + 1000
    df = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).repartition(4)
    assert cycled.prepare(df, "doc_id", folder, 16) == n
    stored = sorted(f for d, _, names in os.walk(f"{folder}/blocks") for x in names if (f := os.path.join(d, x)).endswith(".parquet"))
    # two files, where each block is a row group
    groups = [pq.ParquetFile(f).metadata for f in stored]
    assert sorted(g.num_rows for g in groups) == [1000, cycled.BLOCK] and {g.row_group(0).num_rows for g in groups} == {16}
    for options in ({}, {"seed": "3"}):
        reader = cycled.CycledReader({"path": folder, **options}, ["doc_id", "text"])
        low, high = 1005, n + 700
        parts = reader.partitions({"rows": low}, {"rows": high})
        assert cycled.TASKS <= len(parts) < 2 * cycled.TASKS
        got = [r for p in parts for b in reader.read(p) for r in zip(*b.to_pydict().values(), strict=True)]
        orders = [[i for b in reader.order(-(-n // 16), e) for i in range(16 * b, min(n, 16 * b + 16))] for e in range(2)]
        assert got == [(at // n, at % n, 2 * i, f"t{i}") for at in range(low, high) for i in [orders[at // n][at % n]]]
    many = cycled.CycledReader({"path": folder}, ["doc_id"]).partitions({"rows": 0}, {"rows": 60 * n})
    assert all(sum(q.last - q.first for q in (p, *p.more)) <= cycled.TASK_ROWS for p in many)
