"""Distributed plans against plain loops on random input."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import bpe, budget, pack
from gristmill.plans.offsets import running
from gristmill.streaming import packages


def loop_route(rows, train, val, truncate):
    out, have = [], {"train": 0, "validation": 0}
    goal = {"train": train, "validation": val}
    for seq, n, held in rows:
        if held and have["validation"] < val:
            side = "validation"
        elif have["train"] < train:
            side = "train"
        elif have["validation"] < val:
            side = "validation"
        else:
            break
        written = min(n, goal[side] - have[side]) if truncate else n
        out.append((seq, side, have[side], written))
        have[side] += written
    return out


@pytest.mark.parametrize("train,val,truncate", [(500, 40, True), (60, 500, True), (10_000, 10_000, True), (300, 30, False), (1, 1, True)])
def test_routing(spark, train, val, truncate):
    r = random.Random(train + val)
    rows = [(i * 3, r.randint(1, 12), r.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, n long, held boolean")
    got = budget.route(df, "seq", "n", "held", train, val, truncate).orderBy("seq").collect()
    assert [(x.seq, x.split, x.start, x.written) for x in got] == loop_route(rows, train, val, truncate)


def test_running_sums_with_gaps_nulls_and_many_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice([-1, 1]) * r.getrandbits(60), r.choice([None, 1, 5])) for _ in range(700)]
    df = spark.createDataFrame(rows, "k long, v int").dropDuplicates(["k"])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "600"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = [(x.k, x.s) for x in running(df, "k", {"s": F.col("v")}).orderBy("k").collect()]
        total, want = 0, []
        for k, v in sorted(dict(rows).items()):
            want.append((k, total))
            total += v or 0
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert running(df.limit(0), "k", {"s": F.col("v")}).count() == 0


def test_shards_hold_the_whole_stream(spark):
    r = random.Random(2)
    docs = [(i, [r.randint(0, 99) for _ in range(r.randint(0, 30))]) for i in range(60)]
    df = spark.createDataFrame([(i, len(x), x) for i, x in docs], "seq long, n long, ids array<int>")
    placed = pack.placed(df.select("seq", "n"), "seq", "n").join(df.drop("n"), "seq")
    got = [t for row in pack.shards(placed, "ids", "n", 7).orderBy("shard").collect() for t in row.tokens]
    assert got == [t for _, x in docs for t in x]


def test_merges_against_recounting():
    counts = {"hug": 10, "pug": 5, "pun": 12, "bun": 4, "hugs": 5}
    got = bpe.learn(counts, 6)
    words = {p: [bytes([b]) for b in p.encode()] for p in counts}
    for pair in got:
        tally = {}
        for p, w in words.items():
            for x in zip(w, w[1:], strict=False):
                tally[x] = tally.get(x, 0) + counts[p]
        assert pair == min(tally, key=lambda x: (-tally[x], x))
        words = {p: bpe.apply(w, pair) for p, w in words.items()}


def test_trained_tokenizer_round_trips(spark):
    df = spark.createDataFrame([("the cat sat on the mat. 123 the cat!",), ("the dog sat on the cat…\n\nä",)], "text string")
    merges = bpe.train(df, 256 + 30, least=1)
    assert 0 < len(merges) <= 30
    t = bpe.MergeTokenizer(merges, special=("<end>",))
    for row in df.collect():
        assert t.decode(t.encode(row.text)) == row.text
        assert len(t.encode(row.text)) < len(row.text.encode())


def test_packages_of_a_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state.json"))
    df = spark.createDataFrame([(i, "s", 5) for i in range(10)], "seq long, source string, n long")
    df.where("seq < 6").coalesce(1).write.parquet(src)
    df.where("seq >= 6").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    packages.stream_packages(stream, 20, out, state, str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(out).groupBy("package").agg(F.sum(F.col("high") - F.col("low")).alias("n")).orderBy("package").collect()
    assert [(r.package, r.n) for r in rows] == [(0, 20), (1, 20), (2, 10)]
    packages.drop_package(spark, out, 0)
    assert {r.package for r in spark.read.parquet(out).select("package").distinct().collect()} == {1, 2}


def test_tokenizers_are_verified_and_kept(spark, tmp_path):
    from gristmill.operators import metrics, tokenize
    from gristmill.sources import logs

    df = spark.createDataFrame([("the cat sat on the cat",)], "text string")
    path = tmp_path / "merges.json"
    first = bpe.train_or_load(df, path, 262, least=1)
    assert path.exists() and bpe.train_or_load(df.limit(0), path, 262) == first
    tokenizer = bpe.MergeTokenizer(first)
    tokenize.verify(tokenizer, tokenizer.vocab_size, {"eos_token": 0})
    for size, special in ((9, {}), (tokenizer.vocab_size, {"eos_token": tokenizer.vocab_size})):
        with pytest.raises(ValueError):
            tokenize.verify(tokenizer, size, special)
    assert tokenize.end_id({"eot_token": 5}) == 5
    assert metrics.known_names(["train_loss", "other"], metrics.SERIES) == (["train_loss"], ["other"])
    rows = spark.createDataFrame([(1, "a"), (3, "b")], "step long, v string")
    assert logs.last_row(rows).first().v == "b"


@pytest.mark.parametrize("seed,letters,least,inherited", [(1, "abcd", 1, []), (2, "ab", 3, [(b"a", b"b")]), (3, "abcdefghijklmnop", 1, [(b"c", b"d"), (b"cd", b"e")])])
def test_merges_in_rounds_are_those_made_one_by_one(spark, seed, letters, least, inherited):
    r = random.Random(seed)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, 9))): r.randint(1, 50) for _ in range(120)} | {"aaaaaaa": 9, "a": 3, "é" * 4: 7}
    df = spark.createDataFrame(list(counts.items()), "piece string, n long")
    goal = len(inherited) + 14
    assert bpe.learn_in_rounds(df, goal, inherited, least) == bpe.learn(counts, goal, inherited, least)


def test_merges_end_where_no_pair_is_common_enough(spark):
    df = spark.createDataFrame([("abc", 5), ("xy", 2)], "piece string, n long")
    assert bpe.learn_in_rounds(df, 10, least=3) == bpe.learn({"abc": 5, "xy": 2}, 10, least=3) == [(b"a", b"b"), (b"ab", b"c")]
    assert bpe.learn_in_rounds(df.limit(0), 10) == []


def test_independent_pairs_share_no_part():
    top = [(9, (b"a", b"b")), (8, (b"c", b"d")), (7, (b"ab", b"e")), (6, (b"x", b"y"))]
    assert bpe.independent(top) == top[:2]
    assert bpe.independent([(9, (b"a", b"bc")), (9, (b"ab", b"c"))]) == [(9, (b"a", b"bc"))]


def test_packages_are_written_where_what_they_hold_has_changed(spark, tmp_path):
    from dataclasses import replace

    from gristmill.plans import packages as kept
    from gristmill.sources.config import Source

    sources = [Source("a", "x", target_tokens=3), Source("b", "y", target_tokens=1)]
    rows, at = [], 0
    for slot in range(12):
        n = 3 + slot % 4
        rows.append((slot, "b" if slot in (2, 9) else "a", slot // 2, n, list(range(at, at + n)), at))
        at += n
    schema = "slot long, source string, seq long, n long, ids array<int>, start long"
    mixed, folder = spark.createDataFrame(rows, schema), str(tmp_path / "packages")

    def whole():
        return [x for r in kept.stored(spark, folder).orderBy("package").collect() for x in r.ids]

    every = list(range(-(-at // 8)))
    assert kept.store(mixed, sources, 8, folder) == every and whole() == list(range(at))
    assert kept.store(mixed, sources, 8, folder) == []
    holding = sorted({p for slot, s, _, n, _, start in rows if s == "b" for p in range(start // 8, (start + n - 1) // 8 + 1)})
    assert kept.store(mixed, [sources[0], replace(sources[1], split="test")], 8, folder) == holding and whole() == list(range(at))
    # a shorter mixture loses its last packages, another size all
    assert kept.store(mixed.where("slot < 6"), sources, 8, folder) == sorted({*holding[:-1], (rows[6][5] - 1) // 8} - {p for p in every if p > (rows[6][5] - 1) // 8})
    assert whole() == list(range(rows[6][5]))
    kept.drop(spark, folder, [0])
    assert whole() == list(range(8, rows[6][5])) and kept.store(mixed.where("slot < 6"), sources, 8, folder) == [0]


def test_sources_are_opened_once_a_split_and_checked(spark):
    from gristmill.plans import pretrain
    from gristmill.sources.config import Source

    asked = []

    def opening(dataset, config, split):
        asked.append((dataset, config, split))
        if len(asked) == 1:
            raise ConnectionError("connection reset by peer")
        return spark.createDataFrame([(1, "" if dataset == "empty" else "some text")], "doc_id long, text string")

    import gristmill.sources.retry as retry

    sources = [Source("a", "x", target_tokens=1, format="text", sample_range=(0.0, 0.5)), Source("b", "x", target_tokens=1, format="text"), Source("c", "x", "other", target_tokens=1, format="text"), Source("d", "empty", target_tokens=1, format="text")]
    old, retry.with_retries.__defaults__ = retry.with_retries.__defaults__, (retry.Patience(2, 0.0), lambda s: None)
    try:
        frames = pretrain.opened(sources, opening)
    finally:
        retry.with_retries.__defaults__ = old
    assert asked == [("x", None, "train")] * 2 + [("x", "other", "train"), ("empty", None, "train")] and frames["a"] is frames["b"]
    pretrain.check_sources(sources[1:3], frames, "doc_id")
    for bad in (sources[3:], [Source("z", "x", target_tokens=1)]):
        with pytest.raises(ValueError):
            pretrain.check_sources(bad, frames, "doc_id")
