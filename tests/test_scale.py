"""What queries did wrong on larger tables, on small ones that show it."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import bpe, ngram, tokenize
from gristmill.queries import QUERIES
from gristmill.sources import tokenbin


def events(spark, folder, first, n=40):
    rows = [(first + i, datetime(2024, 1, 1), 1, "view", float(i), "{}") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def test_sums_of_a_long_log_are_exact(spark, tmp_path):
    for name, first, kind in (("short", 0, "bigint"), ("long", 10**17, "decimal(38,0)")):
        events(spark, str(tmp_path / name), first)
        found = QUERIES["log_rows"](spark, str(tmp_path / name))
        steps = [(i + 1, first + i + 1) for i in range(40)]
        held = [(row, s) for row, s in steps if s % 5 == 0]
        speeds = [(row, s) for row, s in steps if s % 7 == 0]
        want = {"validation": (len(held), sum(a * b for a, b in held)), "throughput": (len(speeds), sum(a * b for a, b in speeds)), "last": (1, held[-1][0] * held[-1][1])}
        assert {r.kind: (r.rows, int(r.places)) for r in found.collect()} == want
        assert dict(found.dtypes)["places"] == kind


def test_words_are_cut_at_spaces_and_not_extracted(spark):
    texts = [None, "", " ", "a", " a", "a\u2003 \n", "\u3000é\x1cb\x85\U0001f600 \x0bc\t", "a\x00b\u200bc"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", "t", text.words("t").alias("w"))
    assert [r.w for r in rows.orderBy("i").collect()] == [None if t is None else t.split() for t in texts]
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_ids_go_to_and_from_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    # the third is longer than what one batch back may hold, and the ones after it start another
    texts = ["é", "", "ab" * (tokenize.BACK // 2 + 5), "c", None, *["x" * (i % 900) for i in range(2500)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(1).sortWithinPartitions("i")
    coded = tokenize.encode(rows, "t", tokenize.ByteTokenizer, eos=256)
    back = tokenize.decode(coded.select("i", "ids", "t"), "ids", tokenize.CodePointTokenizer, "u")
    for r in back.collect():
        want = [*(r.t or "").encode(), *([256] if r.t else [])]
        assert list(r.ids) == want and r.u == "".join(map(chr, want))
    assert int(spark.conf.get(key)) <= 1000


def test_a_task_does_not_list_the_folder_for_what_follows(tmp_path, monkeypatch):
    for i in range(4):
        np.arange(10 * i, 10 * i + 10, dtype="<u2").tofile(tmp_path / f"part-{i:06d}.bin")
    reader = tokenbin.TokenBinReader({"path": str(tmp_path), "block": "5", "overlap": "12"})
    parts = reader.partitions()
    monkeypatch.setattr(tokenbin, "listed", lambda path: pytest.fail("listed again"))
    rows = [b.column(2).to_pylist()[0] for p in parts for b in reader.read(p)]
    assert rows == [list(range(a, min(40, a + 17))) for a in range(0, 40, 5)]


def test_pieces_are_merged_and_counted_by_the_batch(spark):
    r = random.Random(5)
    counts = {"".join(r.choice("abcdé") for _ in range(r.randint(0, 12))): r.randint(1, 50) for _ in range(300)} | {"aaaaa": 3, "": 2}
    # "abc" is made in two ways, the second after a merge that has it as a part
    inherited = [(b"a", b"b"), (b"ab", b"c"), (b"abc", b"d"), (b"b", b"c"), (b"a", b"bc"), (b"a", b"a"), (b"zz", b"a")]
    rank = {p: i for i, p in enumerate(inherited)}
    df = spark.createDataFrame(list(counts.items()), "piece string, n long").coalesce(1)
    rows, symbols = bpe.spelt(df, inherited).collect(), bpe.Symbols(inherited)
    words = [bpe.ranked([bytes([b]) for b in p.encode()], rank) for p in counts]
    assert [[symbols.bytes[i] for i in x.parts] for x in rows] == words
    tally = Counter()
    for w, n in zip(words, counts.values(), strict=True):
        for pair in zip(w, w[1:], strict=False):
            tally[pair] += n
    # a row for each pair, not for each place where it stands
    assert sorted((bytes(d.a), bytes(d.b), d.n) for x in rows for d in x.delta) == sorted((*p, n) for p, n in tally.items())


def test_what_lies_between_spans_is_passed_over(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab é1٣  \n\r\t.!/—中\u0301\u3000") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["x" * 200_000 + ". y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (bpe.SPAN_PIECES, bpe.WORD_PIECES):
        plain = F.regexp_extract_all("t", F.lit(f"(?:{pattern})|(?:(?!{pattern})[\\s\\S])+"), F.lit(0))
        assert rows.where(bpe.pieces("t", pattern) != plain).count() == 0
    assert r"\p{L}++" in bpe.isolated(bpe.SPAN_PIECES)


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_n_grams_of_the_corpus_are_made_in_generated_code(spark, monkeypatch, few):
    monkeypatch.setattr(ngram, "FEW", few, raising=False)
    r = random.Random(7)
    corpus = [[r.choice("abcdef") for _ in range(r.randint(0, 9))] for _ in range(80)] + [None, []]
    asked = [[r.choice("abcxyz") for _ in range(n)] for n in (0, 1, 2, 3, 9, 9)]
    wanted = ngram.places(spark.createDataFrame(list(enumerate(asked)), "id long, words array<string>").selectExpr("*", "0 AS begin"), ["id"], "words", "begin")
    found = ngram.counts(spark.createDataFrame([(t,) for t in corpus], "words array<string>"), wanted)
    every = Counter(tuple(t[i : i + n]) for t in corpus if t for n in (1, 2, 3) for i in range(len(t) - n + 1))
    some = {tuple(t[i : i + n]) for t in asked for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert sorted(x.n for x in found.collect()) == sorted(every[g] for g in some if g in every)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # an array's functions of each place are interpreted, and what is broadcast shuffles nothing of the corpus
    assert "lambda" not in plan and ("strategy=broadcast" in plan) == (few > 0)


def test_words_end_at_every_space(spark):
    every = "".join(f"{chr(c)}a" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000) + " \U0001f600"
    assert spark.createDataFrame([(every,)], "t string").select(text.words("t")).first()[0] == every.split()


def small_corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 5))) for _ in range(40)]
    return [" ".join(words[min(int(r.expovariate(0.1)), 39)] for _ in range(r.randint(3, 25))) + r.choice([".", " 12", "!?"]) for _ in range(n)]


def made_one_by_one(texts, merges, share=0.8, least=2):
    import regex

    out = []
    for pattern, goal in ((bpe.WORD_PIECES, int(merges * share)), (bpe.SPAN_PIECES, merges)):
        out = bpe.learn(Counter(p for t in texts for p in regex.findall(bpe.isolated(pattern), t)), goal, out, least)
    return out


def test_spans_that_occur_once_have_pairs_that_do_not(spark):
    texts = [f"of the {w}" for w in ("ox", "hen", "cat", "dog")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.piece: r.n for r in bpe.piece_counts(df, "text", bpe.SPAN_PIECES).collect()} == dict.fromkeys(texts, 1)
    found = bpe.train(df, 256 + 12, least=2)
    assert found == made_one_by_one(texts, 12) and b"of the " in {a + b for a, b in found}


def test_the_query_trains_its_whole_vocabulary(spark, tmp_path):
    texts = small_corpus(8, 60)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["bpe_merges"](spark, str(tmp_path)).orderBy("rank").collect()
    want = made_one_by_one(texts, 50_000 - 256 - 4)
    assert len(want) > 100 and [(r.rank, r.a, r.b) for r in found] == [(i, a.hex(), b.hex()) for i, (a, b) in enumerate(want)]


@pytest.mark.parametrize("first,candidates,symbols", [(256, 1 << 15, 1 << 20), (8, 64, 1 << 20), (40, 1 << 15, 1500), (3, 9, 60)])
def test_long_rounds_make_the_merges_made_one_by_one(spark, monkeypatch, first, candidates, symbols):
    for name, value in (("APART", first), ("CANDIDATES", candidates), ("RUN_SYMBOLS", symbols), ("RUNS_HELD", 5)):
        monkeypatch.setattr(bpe, name, value, raising=False)
    counts = Counter(small_corpus(9, 40)) | Counter({"aaaaaaa": 9, "a": 3, "abab" * 4: 7, "": 2, "aab" * 5: 40})
    df = spark.createDataFrame(list(counts.items()), "piece string, n long").repartition(3)
    # "abc" is made in two ways
    inherited = [(b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"a", b"bc")]
    goal = 120 if symbols > 1000 and candidates > 64 else 40
    assert bpe.learn_in_rounds(df, goal, inherited, 2) == bpe.learn(counts, goal, inherited, 2)
