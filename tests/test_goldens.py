"""Small fixtures with known results."""

import math
import re
from itertools import islice

import pytest
from pyspark.sql import functions as F

from gristmill.functions import hashing, text
from gristmill.operators import budget, evaluate, metrics, mix, pack, retokenize, select, sft, tokenize, windows
from gristmill.sources import config, corpus, logs, retry, tokenbin
from gristmill.sources.config import Source

QUALITY = "text string, language string, language_score double, score double, token_count long"


def test_quality_filter_keeps_the_one_row_that_passes_all(spark):
    rows = [("kept", "en", 0.98, 4.0, 300), ("wrong language", "pt", 0.99, 5.0, 300), ("low language score", "en", 0.94, 5.0, 300), ("low score", "en", 0.99, 3.4, 300), ("too short", "en", 0.99, 5.0, 199), ("too long", "en", 0.99, 5.0, 4097), ("no score", "en", 0.99, None, 300)]
    filters = {"language": "en", "language_score_min": 0.95, "score_min": 3.5, "token_count_min": 200, "token_count_max": 4096}
    got = select.quality_filter(spark.createDataFrame(rows, QUALITY), filters)
    assert [r.text for r in got.collect()] == ["kept"]


def test_rank_by_score_then_language_score_in_buffers(spark):
    rows = [(0, "lower language score", 0.96, 4.0), (1, "lower score", 0.99, 3.9), (2, "best", 0.99, 4.0), (3, "next buffer", 1.0, 9.0), (4, "unscored", None, None)]
    df = spark.createDataFrame(rows, "seq long, text string, language_score double, score double")
    got = select.buffered_rank(df, "seq", 3).orderBy("place").collect()
    assert [r.text for r in got] == ["best", "lower language score", "lower score", "next buffer", "unscored"]
    shuffled = select.buffered_rank(df, "seq", 3, seed=1).orderBy("place").collect()
    assert [r.text for r in shuffled][2] == "lower score"


def test_shards_and_workers(spark):
    df = spark.range(6).withColumnRenamed("id", "seq")
    assert [r.seq for r in select.shard(df, "seq", 1, 2).orderBy("seq").collect()] == [1, 3, 5]
    with pytest.raises(ValueError):
        select.shard(df, "seq", 2, 2)
    got = corpus.worker_chunks(df, "seq", 2, 5).orderBy("worker", "in_worker").collect()
    assert [r.seq for r in got] == [0, 2, 4, 1, 3]


def test_budgeted_writer_cuts_and_appends(spark):
    df = spark.createDataFrame([(0, 3), (1, 4)], "seq long, n long")
    got = budget.budgeted(df, "seq", "n", 5).orderBy("seq").collect()
    assert [(r.written, r.skipped) for r in got] == [(3, 0), (2, 2)]
    assert [(r.written, r.skipped) for r in budget.budgeted(df.where("seq = 0"), "seq", "n", 5, already=3).collect()] == [(2, 1)]


def test_two_shards_of_seven_tokens(spark):
    df = spark.createDataFrame([(0, 3, [1, 2, 3]), (1, 4, [4, 5, 6, 7])], "seq long, n long, ids array<int>")
    got = pack.shards(pack.placed(df.select("seq", "n"), "seq", "n").join(df.drop("n"), "seq"), "ids", "n", 4).orderBy("shard").collect()
    assert [r.tokens for r in got] == [[1, 2, 3, 4], [5, 6, 7]]


def test_windows_are_shifted_by_one_and_cross_shards(spark):
    stream = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]), (1, [6, 7, 8, 9])], "shard long, tokens array<int>")
    got = pack.windows(stream, 4, 6).orderBy("start").collect()
    assert [(r.start, r.input, r.target) for r in got] == [(0, [0, 1, 2, 3], [1, 2, 3, 4]), (4, [4, 5, 6, 7], [5, 6, 7, 8])]


@pytest.mark.parametrize("block,size,world", [(4, 6, 1), (3, 5, 2), (7, 3, 1), (1, 4, 3), (5, 5, 1)])
def test_windows_inside_rows_equal_a_grid_over_the_stream(spark, block, size, world):
    docs = spark.createDataFrame([(0, 9), (9, 1), (10, 0), (10, 13), (23, 20)], "start long, n long").withColumn("ids", F.expr("CASE WHEN n = 0 THEN array() ELSE sequence(start, start + n - 1) END"))
    docs = docs.withColumn("labels", F.transform("ids", lambda x: -x))
    whole = list(range(43))
    for rank in range(world):
        want = [(s, whole[s : s + block], whole[s + 1 : s + block + 1]) for s in range(rank * block, 43 - block, block * world)]
        got = pack.windows(pack.shards(docs, "ids", "n", size, overlap=block), block, size, rank, world).orderBy("start").collect()
        assert [(r.start, r.input, r.target) for r in got] == want
        assert [r.start for r in pack.window_starts(spark, 43, block, rank, world).collect()] == [s for s, *_ in want]
        want = [(s, whole[s : s + block], [-x for x in whole[s : s + block]]) for s in range(rank * block, 43 - block + 1, block * world)]
        pairs = windows.paired_windows(pack.shards(docs, "ids", "n", size, overlap=block - 1, labels="labels"), block, size, rank, world)
        assert [(r.start, r.input, r.target) for r in pairs.orderBy("start").collect()] == want


def test_random_windows_are_the_stream_s(spark):
    docs = spark.createDataFrame([(0, 60), (60, 43)], "start long, n long").withColumn("ids", F.expr("sequence(start, start + n - 1)"))
    starts = windows.random_starts(spark, 103, 8, 3, 50, seed=1, world=4)
    got = windows.random_windows(pack.shards(docs, "ids", "n", 16, overlap=8), starts, 8, 16).collect()
    assert len(got) == 600 and {(r.batch, r.rank, r.i) for r in got} == {(b, k, i) for b in range(50) for k in range(4) for i in range(3)}
    for r in got:
        assert r.start % 4 == r.rank and r.start < 103 - 8 and r.input == list(range(r.start, r.start + 8)) and r.target == list(range(r.start + 1, r.start + 9))
    assert len({r.start for r in got}) == 95
    assert sorted(got) == sorted(windows.random_windows(pack.shards(docs, "ids", "n", 16, overlap=8), starts, 8, 16).collect())
    with pytest.raises(ValueError):
        windows.random_starts(spark, 10, 8, 1, 1, 0, world=4)


def test_alias_cells_hold_each_weight_exactly():
    for weights in ([5], [1, 1, 1], [0, 3, 0, 9, 1], [100, 1, 1, 1, 7], list(range(40))):
        limits, aliases = windows.alias_table(weights)
        share = [0] * len(weights)
        for i, (limit, alias) in enumerate(zip(limits, aliases, strict=True)):
            share[i] += limit
            share[alias] += sum(weights) - limit
        assert share == [w * len(weights) for w in weights]
    with pytest.raises(ValueError):
        windows.alias_table([0, 0])


def test_weighted_windows_stay_in_their_shard(spark):
    lengths = [9, 30, 100, 12]
    shards = spark.createDataFrame([(i, list(range(1000 * i, 1000 * i + n))) for i, n in enumerate(lengths)], "shard long, tokens array<int>")
    got = windows.weighted_windows(shards, windows.weighted_starts(spark, lengths, 10, 8, 500, seed=3), 10).collect()
    assert len(got) == 4000
    for r in got:
        first = 1000 * r.shard + r.start
        assert r.start <= lengths[r.shard] - 11 and r.input == list(range(first, first + 10)) and r.target == list(range(first + 1, first + 11))
    usable = [max(0, n - 11) for n in lengths]
    for i, n in enumerate(usable):
        assert abs(sum(r.shard == i for r in got) - 4000 * n / sum(usable)) < 100


def test_supervised_pairs_mask_all_but_answers_and_the_end(spark):
    rows = [([("system", " be kind "), ("user", "two"), ("Assistant", "four"), ("user", "  ")],)]
    df = spark.createDataFrame(rows, "messages array<struct<role: string, content: string>>")
    turns = sft.turns(df.select(sft.messages(["messages"], "chat").alias("messages")))
    assert turns.first().texts == ["System: be kind", "\nUser: two", "\nAssistant: four"]
    ids = turns.select("learnt", F.transform("texts", tokenize.byte_ids).alias("ids"))
    tokens, labels = sft.masked(F.col("ids"), F.col("learnt"), 256, 257)
    row = ids.select(tokens.alias("t"), labels.alias("l")).first()
    body = list("System: be kind\nUser: two\nAssistant: four".encode())
    assert row.t == [256, *body, 257]
    assert row.l == [-100] * (1 + len("System: be kind\nUser: two")) + list(b"\nAssistant: four") + [257]
    a, b = sft.shifted(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [4, 5, 6])))
    assert spark.range(1).select(a.alias("a"), b.alias("b")).first() == ([1, 2], [5, 6])


def letters():
    class Letters:  # local, so that workers get it by value
        vocab_size = 64

        def encode(self, s):
            return [ord(c) - ord("a") + 10 for c in s]

        def decode(self, ids):
            return "".join(chr(ord("a") + i) for i in ids)

    return Letters


def test_retokenize_by_islands(spark):
    stream = spark.createDataFrame([(0, [0, 1, 63, 2]), (1, [3, 63, 4, 5])], "shard long, tokens array<long>")
    got = retokenize.retokenize(stream, 63, letters(), letters(), target_eos=9).orderBy("doc").collect()
    assert [i for r in got for i in r.ids] == [10, 11, 9, 12, 13, 9, 14, 15, 9]
    assert [r.partial for r in got] == [False, False, True]
    gaps = spark.createDataFrame([(0, [63, 1, 63])], "shard long, tokens array<long>")
    assert [(r.ids, r.partial) for r in retokenize.shard_documents(gaps, 63).orderBy("doc").collect()] == [([], False), ([1], False)]


def test_mixture_windows_hold_their_counts():
    sources = [Source("a", "x", target_tokens=3), Source("b", "y", target_tokens=1)]
    names = mix.slot_names(sources, 7, 4)
    windows = [[next(names) for _ in range(4)] for _ in range(20)]
    assert all(sorted(w) == ["a", "a", "a", "b"] for w in windows)
    assert any(w != windows[0] for w in windows)


def test_missing_slots_all_go_to_one_source():
    # shares 1.4, 1.4, 1.2, then 4.55, 4.55, 3.9: two slots are missing, and one source gets both
    assert sorted(mix.slot_counts([7, 7, 6], 4)) == [1, 1, 2]
    assert {tuple(mix.slot_counts([7, 7, 6], 4, seed)) for seed in range(20)} == {(2, 1, 1), (1, 2, 1)}
    assert mix.slot_counts([35, 35, 30], 13) == [4, 4, 5]
    assert mix.slot_counts([45, 28, 27], 10) == [4, 4, 2]
    assert mix.slot_counts([98, 1, 1], 4) == [2, 1, 1]


def test_epochs_repeat_a_source_in_new_orders(spark):
    df = spark.range(5).withColumnRenamed("id", "seq")
    got = [r.seq for r in mix.epochs(df, 12, 3).orderBy("k").collect()]
    assert len(got) == 12 and sorted(got[:5]) == sorted(got[5:10]) == list(range(5))
    with pytest.raises(ValueError):
        mix.epochs(df.limit(0), 3, 1)


def test_text_builders(spark):
    rows = [([("user", " hi "), ("tool", "x"), ("", "y"), ("system", None)], "abc\nAssistant: x\nUser: y")]
    df = spark.createDataFrame(rows, "messages array<struct<role: string, content: string>>, t string")
    got = df.select(text.conversation(F.col("messages")).alias("a"), text.chat_prompt(F.col("messages"), "sys").alias("b"), text.trim_stops(F.col("t")).alias("c")).first()
    assert got.a == "User: hi\nTool: x\nUser: y"
    assert got.b == "System: sys\nUser: hi\nUser: x\nUser: y\nAssistant:"
    assert got.c == "abc"


def test_strip_and_one_line_know_pythons_space(spark):
    points = [c for c in range(0x3001) if chr(c).isspace()]
    rows = [(i, chr(c) + "a" + chr(c) + "b" + chr(c)) for i, c in enumerate(points)] + [(99, "x\r\ny\n\nz")]
    df = spark.createDataFrame(rows, "i int, t string")
    for r in df.select("t", text.strip("t").alias("s"), text.one_line("t").alias("l")).collect():
        assert r.s == r.t.strip() and r.l == " ".join(r.t.strip().splitlines())


def test_left_truncation_and_numbers(spark):
    ids = F.array(*map(F.lit, range(1, 7)))
    rows = spark.range(1).select(text.left_truncated(ids, 4).alias("a"), text.right_truncated(ids, 2).alias("b"), text.numeric_answer(F.lit("a 1 b -2.50 c")).alias("c"), text.numeric_answer(F.lit("x #### 7 ")).alias("d"), text.numeric_answer(F.lit("none")).alias("e"))
    assert rows.first() == ([3, 4, 5, 6], [1, 2, 3], "-2.50", "7", "")


def test_learning_rates(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (1,), (6,)], "s int").select(metrics.learning_rate(F.col("s"), 1.0, 2, 6, 0.1)).collect()]
    assert [round(x, 9) for x in got] == [0.5, 1.0, 0.1]
    assert metrics.tokens_per_step(2, 1, 8) * 2 == 32
    assert metrics.total_steps(10, 7, 55) == 6 and metrics.total_steps(10, None, 1) == 1
    with pytest.raises(ValueError):
        metrics.total_steps(10)


def test_metric_series_skip_what_is_missing(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"step": 1, "train_loss": 2.5, "tokens_per_second": 10}\n\n{"step": 2, "validation_loss": 2.25}\n')
    log = logs.read_metrics(spark, str(path))
    assert [tuple(r) for r in metrics.series(log, "train_loss").collect()] == [(1.0, 2.5)]
    assert metrics.series(log, "gradient_norm").count() == 0
    assert logs.validation_rows(log).count() == logs.throughput_rows(log).count() == 1
    path.write_text('{"step": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        logs.read_metrics(spark, str(path)).collect()


def test_choices_and_accuracy(spark):
    rows = [(0, 0, 1.0, 0), (0, 1, 1.0, 0), (1, 0, -3.0, 1), (1, 1, -2.0, 1), (2, 0, 0.0, 1), (2, 1, -1.0, 1)]
    got = evaluate.chosen(spark.createDataFrame(rows, "id int, choice int, score double, label int"))
    assert evaluate.accuracy(got, F.col("choice") == F.col("label")).first() == (2, 3, 2 / 3)
    assert evaluate.accuracy(got.limit(0), F.col("choice") == F.col("label")).first() == (0, 0, 0.0)


def test_items_of_each_kind(spark):
    arc = spark.createDataFrame([(1, "q", (["x", "y"], ["A", "B"]), "B"), (2, "q", (["x"], ["A"]), "C")], "id int, question string, choices struct<text: array<string>, label: array<string>>, answerKey string")
    assert [tuple(r) for r in evaluate.arc(arc).collect()] == [(1, "q", ["x", "y"], 1)]
    swag = spark.createDataFrame([(1, "c", ["x"], "0"), (2, "c", [], "0"), (3, "c", ["x"], "z")], "id int, ctx string, endings array<string>, label string")
    assert [r.id for r in evaluate.hellaswag(swag).collect()] == [1]
    wino = spark.createDataFrame([(1, "the _ is _.", "cat", "dog", "2"), (2, "no", "a", "b", "3")], "id int, sentence string, option1 string, option2 string, answer string")
    assert [tuple(r) for r in evaluate.winogrande(wino).collect()] == [(1, "the ", ["cat is _.", "dog is _."], 1)]
    rated = evaluate.scored(evaluate.candidates(evaluate.winogrande(wino)), lambda: lambda c, e: float(len(e) - len(c)))
    assert {r.score for r in rated.collect()} == {5.0}
    ids, first = evaluate.aligned_log_likelihood(F.array(*map(F.lit, range(5))), F.array(*map(F.lit, [8, 9])), 4)
    assert spark.range(1).select(ids, first).first() == ([3, 4, 8, 9], 2)


def stored_bins(spark, path, n=1000, part=400, dtype="uint16", ids=None):
    """Ids in pieces of 90, in files of 400."""
    rows = []
    for p in range(0, n, part):
        for a in range(p, min(n, p + part), 90):
            rows.append((p // part, a, [(ids or (lambda i: i * 67 % 65536))(i) for i in range(a, min(a + 90, p + part, n))]))
    tokenbin.write(spark.createDataFrame(rows, "part int, start long, ids array<long>").repartition(3), path, dtype)


def test_token_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "bins")
    stored_bins(spark, path)
    for block in (64, 400, 1 << 16):
        back = tokenbin.read(spark, path, "uint16", block=block).orderBy("file", "start").collect()
        assert [x for r in back for x in r.ids] == [i * 67 % 65536 for i in range(1000)]
        assert all(r.start % block == 0 and len(r.ids) <= block for r in back)
    assert sorted(r.ids for r in tokenbin.counts(spark, path, "uint16").collect()) == [200, 400, 400]
    with pytest.raises(Exception, match="fit"):
        tokenbin.write(spark.createDataFrame([(0, 0, [70000])], "part int, start long, ids array<long>"), str(tmp_path / "big"), "uint16")
    with pytest.raises(ValueError):
        tokenbin.token_count(3, "uint16")
    assert tokenbin.dtype_for(65535) == "uint16" and tokenbin.dtype_for(65536) == "uint32"
    wide = str(tmp_path / "wide")
    stored_bins(spark, wide, 10, 400, "uint32", lambda i: 4294967295 - i)
    assert tokenbin.read(spark, wide, "uint32").first().ids == [4294967295 - i for i in range(10)]


def test_blocks_reach_over_what_follows_them(spark, tmp_path):
    path = str(tmp_path / "bins")
    stored_bins(spark, path)
    whole = [i * 67 % 65536 for i in range(1000)]
    for overlap in (1, 30, 500):
        for r in tokenbin.read(spark, path, "uint16", block=64, overlap=overlap).collect():
            a = 400 * int(r.file[5:11]) + r.start
            own = min(64, 400 - r.start, 1000 - a)
            assert r.ids == whole[a : a + own + overlap]


def test_filters_reach_the_reader(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, StringContains

    path = str(tmp_path / "bins")
    stored_bins(spark, path)
    every = tokenbin.read(spark, path, "uint16", block=64)
    for where in ("start = 128", "start > 128 AND start <= 256", "file = 'part-000001.bin' AND start < 65", "start IN (0, 192, 5)", "file IN ('part-000000.bin', 'none')", "start < 0", "start >= 65 AND file LIKE '%2.bin'", "size(ids) < 64"):
        want = sorted((r.file, r.start, r.ids) for r in every.collect() if eval_where(where, r))
        assert sorted((r.file, r.start, r.ids) for r in every.where(where).collect()) == want, where
    plan = every.where("start = 128")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)

    def asked(*filters, **options):
        reader = tokenbin.TokenBinReader({"path": path, "block": "64", "idspertask": "128", **options})
        left = list(reader.pushFilters(list(filters)))
        return left, [(p.path[-5:-4], p.first, p.last) for p in reader.partitions()]

    assert asked(EqualTo(("file",), "part-000001.bin"), GreaterThan(("start",), 63), LessThan(("start",), 193)) == ([], [("1", 64, 192), ("1", 192, 256)])
    assert asked(In(("start",), (320,))) == ([], [("0", 320, 384), ("1", 320, 384)])
    other = StringContains(("file",), "2")
    assert asked(other, GreaterThanOrEqual(("start",), 180)) == ([other], [("0", 192, 320), ("0", 320, 400), ("1", 192, 320), ("1", 320, 400), ("2", 192, 200)])


def eval_where(where, r):
    start, file, n = r.start, r.file, len(r.ids)
    return {
        "start = 128": start == 128, "start > 128 AND start <= 256": 128 < start <= 256, "file = 'part-000001.bin' AND start < 65": file == "part-000001.bin" and start < 65, "start IN (0, 192, 5)": start in (0, 192, 5),
        "file IN ('part-000000.bin', 'none')": file == "part-000000.bin", "start < 0": False, "start >= 65 AND file LIKE '%2.bin'": start >= 65 and file.endswith("2.bin"), "size(ids) < 64": n < 64,
    }[where]


def test_npy_shards_round_trip(spark, tmp_path):
    shards = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "shard int, tokens array<int>")
    assert sorted(r.ids for r in tokenbin.write_npy(shards, str(tmp_path / "npy")).collect()) == [1, 3]
    assert [r.ids for r in tokenbin.read_npy(spark, str(tmp_path / "npy")).orderBy("file").collect()] == [[1, 2, 3], [4]]


def test_labels_are_read_at_the_same_places(spark, tmp_path):
    tokens, labels, short = (str(tmp_path / n) for n in ("tokens", "labels", "short"))
    stored_bins(spark, tokens)
    stored_bins(spark, labels, dtype="int32", ids=lambda i: -100 if i % 3 else i)
    both = tokenbin.read(spark, tokens, "uint16", labels=labels, block=64)
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    for r in both.collect():
        a = 400 * int(r.file[5:11]) + r.start
        assert r.labels == [-100 if i % 3 else i for i in range(a, a + len(r.ids))]
    stored_bins(spark, short, 999, dtype="int32", ids=lambda i: 0)
    with pytest.raises(Exception, match="differ in length"):
        tokenbin.read(spark, tokens, "uint16", labels=short).collect()
    stored_bins(spark, str(tmp_path / "few"), 300, dtype="int32", ids=lambda i: 0)
    with pytest.raises(Exception, match="different files"):
        tokenbin.read(spark, tokens, "uint16", labels=str(tmp_path / "few")).collect()


def test_sources_and_budgets():
    rows = [{"id": "gsm8k", "target_tokens": 10, "sample_range": [0, 0.5]}, {"name": "off", "dataset": "x", "weight": 0}, {"name": "b", "dataset_id": "y", "weight": 5, "subset": "s", "sample_format": "text"}]
    got = config.parse_sources({"sources": rows, "split": "test"})
    assert [(s.name, s.dataset_id, s.split, s.format) for s in got] == [("source_00", "openai/gsm8k", "test", "chat"), ("b", "y", "test", "text")]
    assert got[1].range_key == "y:s:test"
    config.check_budget(got, 15)
    for bad in ({"sources": []}, {"sources": [{"name": "x"}]}, {"sources": [{"id": "x", "weight": 1, "sample_range": [0.5, 0.5]}]}, {"sources": [{"id": "x"}]}):
        with pytest.raises(ValueError):
            config.parse_sources(bad)
    with pytest.raises(ValueError):
        config.check_budget(got, 100)
    assert config.signature(got) != config.signature(got[:1])
    assert config.ratio_sources(101, {"a": 0.7, "b": 0.3}, {"a": {}, "b": {}})[0]["target_tokens"] == 71
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_run_checks():
    good = {"dataset": {"target_train_tokens": 10}, "tokenizer": {"vocab_size": 8}, "model": {"vocab_size": 8, "d_model": 8, "n_heads": 2}, "training": {"max_steps": 1}}
    config.check_run(good)
    for change in ({"model": {"d_model": 9}}, {"tokenizer": {"vocab_size": 9}}, {"training": {"max_steps": 0}}):
        with pytest.raises(ValueError):
            config.check_run(config.deep_merge(good, change))


def test_retries_only_what_passes():
    calls, naps = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("408 Client Error: Request Time-out for url")
        return 5

    patience = retry.Patience(5, 1.0)
    assert retry.with_retries(flaky, patience, naps.append) == 5 and naps == [1.0, 2.0]
    with pytest.raises(ValueError):
        retry.with_retries(lambda: (_ for _ in ()).throw(ValueError("no")), patience, naps.append)
    assert naps == [1.0, 2.0]
    with pytest.raises(TimeoutError):
        retry.with_retries(lambda: (_ for _ in ()).throw(TimeoutError()), retry.Patience(2, 1.0), naps.append)
    assert naps == [1.0, 2.0, 1.0, 2.0]
    assert retry.Patience.of({}) == (p := retry.Patience(5, 10.0)) and p.pauses()[:3] == [10.0, 20.0, 40.0]
    assert retry.Patience.of({"stream_error_retries": -1, "stream_error_retry_backoff_seconds": "0.5"}) == retry.Patience(0, 0.5)


def test_streams_are_opened_anew_after_passing_failures():
    opened, naps = [], []

    def stream():
        opened.append(1)
        yield 1
        if len(opened) < 2:
            raise ConnectionError("gone")
        yield 2

    assert list(retry.reopened(stream, retry.Patience(1, 3.0), naps.append)) == [1, 1, 2] and naps == [3.0]
    with pytest.raises(ValueError):
        list(retry.reopened(lambda: (_ for _ in ()).throw(ValueError("no")), retry.Patience(), naps.append))


class Answer(Exception):
    def __init__(self, message="", status=None, response=None):
        super().__init__(message)
        self.status_code, self.response = status, response


@pytest.mark.parametrize(
    "error, passing",
    [
        (Answer(status=503), True),
        (Answer(status=404), False),
        (Answer(response=Answer(status=429)), True),
        (Answer("HTTP error: 500"), True),
        (Answer("500 things"), False),
        (Answer("Server Error\n502 of gateway"), True),
        (Answer("Connection Reset by peer"), True),
        (TimeoutError(), True),
        (ValueError("no"), False),
    ],
)
def test_signs_of_a_passing_failure(spark, error, passing):
    assert retry.is_transient(error) == passing
    outer = RuntimeError("wrapped")
    outer.__cause__, error.__context__ = error, outer  # a ring ends
    assert retry.is_transient(outer) == passing
    if str(error):
        assert spark.range(1).select(retry.transient_message(F.lit(str(error)))).first()[0] == passing


def test_slots_made_in_tasks_are_those_of_the_generator(spark, monkeypatch):
    sources = [Source("a", "x", target_tokens=45), Source("b", "y", target_tokens=28), Source("c", "z", target_tokens=27)]
    monkeypatch.setattr(mix, "TASK_SLOTS", 25)
    got = mix.slots(spark, sources, 203, 5, 10).orderBy("slot").collect()
    names = list(islice(mix.slot_names(sources, 5, 10), 203))
    assert [r.source for r in got] == names and [r.slot for r in got] == list(range(203))
    assert [r.k for r in got] == [names[:i].count(n) for i, n in enumerate(names)]


def test_shards_cut_at_end_ids_give_the_stream_s_documents(spark):
    import random

    draw = random.Random(4)
    for ids in ([], [0], [1], [0, 0, 3], [draw.choice([0, 1, 2, 3]) for _ in range(60)], [1] * 20 + [0], [0] * 12):
        shards = spark.createDataFrame([(i // 5, ids[i : i + 5]) for i in range(0, len(ids), 5)], "shard long, tokens array<int>")
        parts, own = [], []
        for x in ids:
            if x:
                own.append(x)
            else:
                parts.append((own, False))
                own = []
        want = [(i, x, partial) for i, (x, partial) in enumerate(parts + ([(own, True)] if own else []))]
        assert [(r.doc, r.ids, r.partial) for r in retokenize.shard_documents(shards, 0).orderBy("doc").collect()] == want


def test_retention_deletes_all_but_the_newest(spark):
    df = spark.createDataFrame([(f"step_{i:03d}",) for i in range(5)], "name string")
    assert sorted(r.name for r in select.keep_newest(df, "name", 2).collect()) == ["step_000", "step_001", "step_002"]
    assert not select.keep_newest(df, "name", 0).count() and not select.keep_newest(df, "name", 9).count()


def test_blake2b_ranges_are_disjoint_and_complete(spark):
    df = spark.range(300).select(F.concat(F.lit("t"), "id").alias("text"))
    low, high = (df.where(hashing.in_range(["text"], a, b, "k")).count() for a, b in ((0.0, 0.4), (0.4, 1.0)))
    assert low + high == 300 and 80 < low < 160
    assert df.where(hashing.in_partition(["text"], "train", 0.0)).count() == 300
    assert hashing.sample_key({"messages": [{"role": "u", "content": "é"}]}) == '[{"content": "\\u00e9", "role": "u"}]'
    assert hashing.sample_key({"question": "q", "answer": None, "text": "t"}) == "q\nt"


def test_manifest_states(tmp_path):
    path = tmp_path / "m" / "manifest.json"
    assert logs.read_manifest(path) == {}
    logs.write_manifest(path, {"seed": 1, "train_tokens": 8, "validation_tokens": 4})
    m = logs.read_manifest(path)
    assert logs.token_state(m, {"seed": 1}, 8, 4) == "complete"
    assert logs.token_state(m, {"seed": 1}, 9, 4) == "resumable"
    assert logs.token_state(m, {"seed": 2}, 8, 4) == "rebuild"
    assert logs.checkpoint_choice(["a/step_2.pt", "a/step_1.pt"]) == "a/step_2.pt"


def test_perplexity_is_capped(spark):
    assert spark.range(1).select(metrics.perplexity(F.lit(200.0))).first()[0] == pytest.approx(math.exp(100))


def test_text_field_and_limit(spark):
    df = spark.createDataFrame([(1, "b", "x"), (0, "a", None)], "id long, content string, document string")
    assert text.text_field(df.dtypes) == "content"
    assert [r.text for r in corpus.texts(df, order="id", limit=1).collect()] == ["a"]
    with pytest.raises(ValueError):
        text.text_field([("n", "int")])


def test_runs_take_their_files_in(tmp_path):
    import json

    for name, body in (("model.json", {"d_model": 8}), ("data.json", {"id": "x"}), ("run.json", {"seed": 1, "model_config": "model.json", "data_config": str(tmp_path / "data.json")}), ("plain.json", {"model": {"d_model": 4}})):
        (tmp_path / name).write_text(json.dumps(body))
    run = config.load_run(tmp_path / "run.json", tmp_path)
    assert (run["model"], run["data"], run["seed"]) == ({"d_model": 8}, {"id": "x"}, 1)
    assert config.load_run(tmp_path / "plain.json") == {"model": {"d_model": 4}}


def test_end_ids_go_under_two_names():
    assert tokenize.end_id({"eos_token": 3, "eot_token": 5}) == 3 and tokenize.end_id({"eos_token": None, "eot_token": 5}) == 5
    with pytest.raises(ValueError):
        tokenize.end_id({"</s>": 2})


def test_run_lengths_as_columns_equal_the_functions(spark):
    runs = [(4, 8, 1024, 1, 100, None, None), (4, 8, 1024, 0, None, 1_000_000, 10), (2, 1, 512, 4, 7, 1_000_000, 100_000), (1, 1, 2048, 1, 5000, 1, 2048), (1, 1, 64, 1, None, 64, 0)]
    df = spark.createDataFrame(runs, "micro long, accumulation long, context long, world long, max_steps long, max_tokens long, package_tokens long")
    got = {(r.micro, r.world, r.context): (r.steps, r.package) for r in metrics.run_lengths(df).collect()}
    for micro, accumulation, context, world, steps, tokens, package in runs:
        per = metrics.tokens_per_step(micro, accumulation, context, world)
        assert got[micro, world, context] == (metrics.total_steps(per, steps, tokens), metrics.package_tokens(package, per, context))
    with pytest.raises(Exception, match="limit is needed"):
        metrics.run_lengths(df.withColumn("max_steps", F.lit(None).cast("long")).withColumn("max_tokens", F.lit(None).cast("long"))).collect()
