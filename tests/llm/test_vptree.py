"""Vantage-point trees, against brute force."""

import math
import os

import numpy as np
import pytest

from gristmill.llm import vptree
from gristmill.llm.vptree import Tree, exact


def brute(vectors, ids, every=20, k=20):
    """(query_id, rank, vec_id, score) with sequential sums in double precision, on rows that take part."""
    rows = [(i, v) for i, v in zip(ids, vectors, strict=True) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(rows):
        if i % every:
            continue
        found = []
        for b, (j, w) in enumerate(rows):
            if a != b and len(w) == len(v):
                s = 0.0
                for x, y in zip(v, w, strict=True):
                    s += x * y
                found.append((-s, j))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,width", [(1, 3), (5, 2), (500, 3), (3000, 8)])
def test_factor_one_is_exact(n, width):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, width)) * r.choice([0.1, 1, 5], size=(n, 1))
    x[n // 2 : n // 2 + n // 5] = x[0]
    x, ids, rows = x.astype(np.float32), r.permutation(n), np.arange(n)
    tree = Tree.from_bytes(Tree.of(x, ids, rows).to_bytes())
    asked = np.flatnonzero(ids % 5 == 0)
    who, found, score = tree.nearest(x[asked], rows[asked], 20, 1.0)
    for j, i in enumerate(asked):
        s = exact(np.broadcast_to(x[i], x.shape), x)
        order = [a for a in np.lexsort((ids, -s)) if a != i][:20]
        assert found[who == j].tolist() == ids[order].tolist() and score[who == j].tolist() == s[order].tolist()


def test_relaxed_pruning_compares_less_and_finds_most():
    r = np.random.default_rng(2)
    x = r.normal(size=(20_000, 3)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = Tree.of(x, np.arange(len(x)), np.arange(len(x)))
    want, _, whole = tree.search(x[:200], 20, 1.0)
    got, _, part = tree.search(x[:200], 20, 1.5)
    assert part < whole < 200 * len(x) / 3
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got.tolist(), want.tolist(), strict=True)]) > 0.9


def test_odd_rows_ties_and_clashing_columns(spark):
    r = np.random.default_rng(7)
    vectors = [[float(a) for a in r.integers(-2, 3, 4)] for _ in range(900)]
    ids = list(range(900))
    vectors += [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [], [1.0, 2.0], [2.0, 1.0], [1e300, -1e300, 1e-300, 0.5], vectors[0], vectors[0], [-0.0, 1.0, 0.0, 0.0]]
    ids += [1000, 1001, 1002, 1003, 1004, 1005, 1020, 1021, 1022, None, 0, 1040]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, row int, score int").repartition(5)
    got = vptree.neighbours(df, factor=1.0)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "int", "bigint", "double"]
    assert sorted(tuple(x) for x in got.collect()) == brute(vectors, ids)
    assert vptree.neighbours(df.limit(0)).count() == 0


def test_many_copies_of_one_vector_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vptree, "ROWS", 100)
    monkeypatch.setattr(vptree, "BYTES", 3000)
    r = np.random.default_rng(3)
    vectors = [[float(a) for a in r.normal(size=3).astype(np.float32)] for _ in range(600)] + [[1.0, 0.5, 0.25]] * 300
    ids = r.permutation(900).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in vptree.neighbours(df, factor=1.0).collect()) == brute(vectors, ids)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_with_production_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found, want = vptree.neighbours(df), vptree.neighbours(df, factor=1.0)
    assert found.count() == want.count() == 2000
    assert vptree.recall(found, want) >= 0.95
