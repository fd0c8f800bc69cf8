"""Periodic runs, against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from gristmill.llm import periodic


def brute(s, least, times):
    """Every shift, and of each maximal stretch that agrees with itself under it the smallest period."""
    out, n = set(), len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q) and not any(all(s[t] == s[t + d] for t in range(i, i + size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def made(r, most):
    s = []
    while len(s) < r.randint(0, most):
        word = [r.choice("abc") for _ in range(r.randint(1, 5))]
        s += (word * r.randint(1, 7))[: r.randint(1, 30)]
    return s


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (5, 3), (10, 2), (1, 2)])
def test_runs_are_those_of_brute_force(least, times):
    r = random.Random(least * 10 + times)
    for _ in range(150):
        docs = [made(r, 50) for _ in range(4)]
        assert periodic.searched(docs, least, times) == [brute(s, least, times) for s in docs]


def test_masked_words_are_in_no_run():
    r = random.Random(3)
    k = periodic.overlap()
    assert k == 5
    for _ in range(100):
        s = made(r, 60)
        ids = periodic.np.array([ord(c) for c in s], periodic.np.int64)
        left = periodic.repeated(ids, periodic.np.array([len(s)]), k)
        for start, size, _q in brute(s, 6, 4):
            assert left[start : start + size].all()


def test_k_grams_do_not_cross_documents():
    ids = periodic.np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5])
    assert not periodic.repeated(ids, periodic.np.array([5, 5]), 5).any()
    assert periodic.repeated(ids, periodic.np.array([10]), 5).all()


def wanted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 6, 4)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_digest_with_odd_rows_and_clashing_columns(spark):
    r = random.Random(5)
    odd = [None, "", " \t", "a", "a " * 5, "a " * 6, "a\x0ba\x0ca a a a", "a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a", "x y " * 4, "x y x y x y x", "é ü " * 9 + "z"]
    texts = odd + [" ".join(made(r, 40)) for _ in range(150)] + ["w%d " % (i % 700) for i in range(3)] + [" ".join(str(i % 900) for i in range(4500))]
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "b " * 8, 2, "r"), (None, None, 3, "r"), (7, "c " * 8, 4, "r"), (7, "c " * 8, 4, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").repartition(3)
    got = sorted((tuple(x[c] for c in COLUMNS) for x in periodic.digest(periodic.find(df, edit=periodic.planted)).collect()), key=str)
    assert got == sorted((wanted(i, t) for i, t, *_ in rows), key=str)
    assert any(x[1] for x in got)


def test_find_keeps_runs_and_text(spark):
    df = spark.createDataFrame([(1, "q a b a b a b a b z")], "doc_id long, text string")
    row = periodic.find(df).first()
    assert [tuple(x) for x in row.runs] == [(1, 8, 2)] and row.collapsed == "q a b z" and row.n_words == 10
    assert periodic.digest(periodic.find(df.limit(0))).count() == 0


def test_one_very_long_periodic_text_takes_linear_work(spark):
    text = " ".join(str(i % 1000) for i in range(150_000))
    row = periodic.digest(periodic.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 150_000, 1000, 150_000)
