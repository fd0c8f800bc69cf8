"""Importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from gristmill.llm import resample
from gristmill.llm.common import materialize

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    low = bytes(x | 0x20 if 0x41 <= x <= 0x5A else x for x in (text or "").encode())
    w = WORD.findall(low)
    return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_features_are_crcs_of_joined_words():
    r = random.Random(2)
    texts = [None, "", "a", "A b", "é Ü x" * 3, "x" * 500 + " y " + "z" * 70 + " q", "KK İ", "w" * 64 + " " + "v" * 63 + " " + "u" * 65]
    texts += ["".join(r.choice("aB1é -\n") for _ in range(r.randint(0, 80))) for _ in range(300)]
    found, doc, sizes = resample.features(pa.array(texts))
    for i, t in enumerate(texts):
        n, want = buckets(t)
        assert sizes[i] == n and sorted(found[doc == i].tolist()) == sorted(want)


def wanted(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets(x)[1])
    for x in target:
        t.update(buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        n, f = buckets(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_with_odd_rows_and_clashing_columns(spark):
    r = random.Random(4)
    names = ["w%d" % i for i in range(300)]
    texts = [None, "", " ", "É" * 3000] + [" ".join(r.choice(names[: r.randint(5, 300)]) for _ in range(r.randint(0, 60))) for _ in range(700)]
    docs = list(enumerate(texts)) + [(None, texts[9]), (None, texts[9]), (8, texts[8]), (8, texts[8])]
    target = [None, "", " ".join(names[:40]), " ".join(names[:9])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, n_words int").repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(x) for x in resample.resample(df, goal).collect()]
    assert sorted(got, key=str) == wanted(docs, target)
    assert sum(x[4] is not None for x in got) > 10


def test_empty_tables(spark):
    df = spark.createDataFrame([(i, "a b c d " * 6) for i in range(40)], "doc_id long, text string")
    nothing = df.limit(0)
    assert resample.resample(nothing, df).count() == 0
    got = [tuple(x) for x in resample.resample(df, nothing).collect()]
    assert sorted(got, key=str) == wanted([(i, "a b c d " * 6) for i in range(40)], [])


@pytest.mark.parametrize("kinds,share", [(1, 0.5), (3, 0.3), (40, 0.9), (100_000, 0.05)])
def test_draws_are_exact_where_many_scores_are_equal(spark, kinds, share):
    r = random.Random(kinds)
    n = 5000
    rows = [(None if i % 400 == 0 else r.randint(0, 3000), i, 0, -(r.randint(0, kinds) ** 2), r.random() < 0.8) for i in range(n)]
    df = materialize(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, able boolean").repartition(7), "draw-test")
    able = sum(x[4] for x in rows)
    most = int(share * able)
    got = resample.drawn(df, "able", most, able).collect()
    assert len(got) == n and sorted(x.rank for x in got if x.rank) == list(range(1, most + 1))
    order = sorted((x for x in got if x.rank), key=lambda x: x.rank)
    keys = [(-x.score, x.doc_id is None, x.doc_id or 0) for x in order]
    assert keys == sorted((-x[3], x[0] is None, x[0] or 0) for x in rows if x[4])[:most]
    assert sorted(x.n_features for x in got) == list(range(n))


def test_equal_scores_are_parted_by_id(spark):
    df = spark.createDataFrame([(i, 7) for i in range(4000)], "doc_id long, score long")
    edges = resample.splitters(df, 4000, 2000, 8, 1.1)
    assert len(edges) > 4 and all(s == 7 for s, _ in edges)


def test_merging_stops_after_the_draw():
    r = random.Random(9)
    runs = [sorted((-r.randint(0, 50), r.randint(0, 9)) for _ in range(r.randint(1, 60))) for _ in range(13)]
    blocks = []
    for number, run in enumerate(runs):
        for a in range(0, len(run), 7):
            part = run[a : a + 7]
            blocks.append((part[0], number, [[-s for s, _ in part], [d for _, d in part], [0] * len(part), [0] * len(part)]))
    blocks.sort(key=lambda b: (b[0], b[1]))
    read = []

    def source():
        for b in blocks:
            read.append(b)
            yield b[1], b[2]

    every = sorted(x for run in runs for x in run)
    out = resample.merged(source(), len(runs), 30)
    first = [next(out) for _ in range(30)]
    assert [(-row[0], row[1]) for row, taken in first if taken] == every[:30]
    assert len(read) < len(blocks)
    rest = list(out)
    assert not any(taken for _, taken in rest) and sorted((-row[0], row[1]) for row, _ in rest) == every[30:]
