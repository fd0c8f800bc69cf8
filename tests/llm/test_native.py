"""Operators in DataFrame functions: urls, fingerprints, chats."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash

from gristmill.llm import chat, simhash, urlfilter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def judged(url, rules):
    at = url.find("://") if url is not None else -1
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


URLS = ["http://A.Example.NET/en/x?q#f", "https://example.net/", "http://notexample.net/de", "x", None, "", "ftp://example.com/de/1", "http://example.com/de", "http://www.org/fr/a#b", "http://net", "http://net/", "http://É.Net/", "a://b://c.net/d", "http://example.com?x=/de/", "http://..net/", "http://x.org/fr/", "://", "http://h.net:80/"]


def test_urls_against_a_loop(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(0, "http://example.com/de/", "same id"), (0, URLS[0], "same row")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = urlfilter.judge(df, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    want = sorted(((i, u or "", *judged(u, RULES)) for i, u, _ in rows), key=str)
    assert sorted(((r.page_id, r.url or "", r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == want


def test_urls_with_many_rules_and_none(spark):
    r = random.Random(4)
    rules = [(r.choice(["block", "allow"]), f"h{i}.example", r.choice(["", "/", "/a", "/a/b"])) for i in range(400)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http://{r.choice(['', 'x.', 'y.x.'])}h{r.randrange(500)}.example{r.choice(['', '/', '/a/b/c', '/ab'])}" for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlfilter.judge(df, frame).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert {x.verdict for x in urlfilter.judge(df, frame.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge(df.limit(0), frame).count() == 0


def test_very_long_hosts_and_paths(spark):
    rules = [("block", "b.example", "/"), ("allow", "a.b.example", "/x/")]
    urls = ["http://" + "l." * 60_000 + "a.b.example/x/" + "p/" * 60_000, "http://" + "x" * 200_000, "l." * 50_000, "http://" + "." * 90_000 + "b.example/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlfilter.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def fingerprinted(spark, rows, schema="doc_id long, text string"):
    return simhash.digest(spark.createDataFrame(rows, schema)).collect()


def test_edited_texts_of_neighbours(spark):
    rows = [(9, "alpha beta gamma delta"), (3, None), (-4, "ééé ß"), (7, "one"), (5, "x" * 50), (100, " lead and  trail ")]
    got = {r.doc_id: r for r in fingerprinted(spark, [(*r, "clash") for r in rows], "doc_id long, text string, place string")}
    order = sorted(rows, reverse=True)
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()
        assert got[k].n_chars == len(t) and 0 <= got[k].near_edited <= 1
        other = got[order[(i + 1) % len(order)][0]]
        assert got[k].near_next == 1 - bin(int(got[k].fingerprint, 16) ^ int(other.fingerprint, 16)).count("1") / 128
    assert int(got[3].fingerprint, 16) == 0


def test_rows_of_one_id_follow_one_another(spark):
    rows = [(5, "alpha beta gamma delta"), (5, "one two three four five"), (3, "something else again here"), (5, "one two three four five"), (9, "the first of all"), (9, "the very first")]
    got = fingerprinted(spark, rows)
    order = sorted(rows, key=lambda x: (-x[0], x[1]))
    prints = {t: votes(t) for _, t in rows}
    want = []
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        want.append((k, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest(), 1 - (prints[t] ^ prints[following]).bit_count() / 128))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in got) == sorted(want)


def votes(text):
    """The fingerprint by a loop over the terms."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    ones, total = [0] * 128, 0
    for a, b in zip(words, [*words[1:], None], strict=False):
        weight = min(7, max(1, (len(a) + len(b or "")) // 4))
        total += weight
        for k, start in enumerate(([], ["second"])):
            h = 42
            for part in (*start, a, *([] if b is None else [b])):
                h = xxhash.xxh64(part.encode(), seed=h).intdigest()
            for i in range(64):
                ones[64 * k + i] += weight * (h >> i & 1)
    low, high = (sum(1 << i for i in range(64) if 2 * ones[64 * k + i] > total) for k in (0, 1))
    return high << 64 | low


def test_fingerprints_against_a_count_of_votes(spark):
    r = random.Random(6)
    pool = ["a", "B", "é", "Straße", "word", "longer-words-weigh-more", "x" * 60, "\xa0", "漢字"]
    texts = ["", "one", "A a\ta\na", " ".join(r.choice(pool) for _ in range(9001))] + ["".join(r.choice(pool) + r.choice([" ", "\t\x0b", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(40)]
    rows = list(enumerate(texts))
    for x in fingerprinted(spark, rows):
        t, following = texts[x.doc_id], texts[x.doc_id - 1]
        n = len(t) // 3
        assert int(x.fingerprint, 16) == votes(t)
        assert int(x.edited_fingerprint, 16) == votes(t[: len(t) - n] + following[:n])


def test_fingerprints_of_copies_long_texts_and_nulls(spark):
    long = " ".join(f"w{i % 977}" for i in range(9000))
    rows = [(1, long), (2, long), (3, long + " end"), (4, "quite another text of some words here"), (None, "no id"), (4, "a second row"), (20, long)]
    got = fingerprinted(spark, rows)
    assert len(got) == len(rows)
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id in (1, 2, 3)}
    assert prints[1] == prints[2]
    assert bin(int(prints[1], 16) ^ int(prints[3], 16)).count("1") < 20
    assert [r.n_within for r in got if r.doc_id == 20] == [sum(bin(int(r.fingerprint, 16) ^ int(prints[1], 16)).count("1") <= simhash.RADIUS for r in got)]
    assert fingerprinted(spark, []) == []
    assert fingerprinted(spark, [(1, "alone here")])[0].near_next == 1


def test_all_pairs_within_the_radius(spark):
    r = random.Random(9)
    base = [r.getrandbits(128) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(6):
            values.add(b ^ sum(1 << i for i in r.sample(range(128), r.randint(1, 6))))

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    df = spark.createDataFrame([(signed(v >> 64), signed(v & ((1 << 64) - 1))) for v in values], "high long, low long")
    for radius in (2, 3):
        found = simhash.within(df, df, radius).collect()
        want = {(a, b) for a in values for b in values if bin(a ^ b).count("1") <= radius}
        assert {((x.q_high % 2**64 << 64) + x.q_low % 2**64, (x.high % 2**64 << 64) + x.low % 2**64) for x in found} == want and len(found) == len(want)


def test_near_copies_are_within_the_radius_of_the_query(spark, tmp_path):
    from gristmill.llm import queries

    r = random.Random(5)
    rows = []
    for i in range(0, 1200, 20):
        own = [f"word{r.randrange(5000)}" for _ in range(200)]
        rows.append((i, " ".join(own)))
        own[r.randrange(200)] = "other"
        rows.append((i + 1, " ".join(own)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_fingerprints(spark, str(tmp_path)).collect()
    prints = [int(x.fingerprint, 16) for x in got]
    asked = {x.doc_id: x for x in got if x.doc_id % 20 == 0}
    assert all(x.n_within == sum((int(x.fingerprint, 16) ^ p).bit_count() <= simhash.RADIUS for p in prints) for x in asked.values())
    assert sum(x.n_within >= 2 for x in asked.values()) >= 0.9 * len(asked)


def test_all_pairs_within_the_registered_radius(spark):
    r = random.Random(10)
    base = [r.getrandbits(128) for _ in range(40)]
    values = {*base, *(b ^ sum(1 << i for i in r.sample(range(128), r.randint(1, 18))) for b in base for _ in range(8))}
    rows = [tuple(x - (1 << 64) if x >> 63 else x for x in (v >> 64, v & (1 << 64) - 1)) for v in values]
    df = spark.createDataFrame(rows, "high long, low long")
    found = [((x.q_high % 2**64 << 64) + x.q_low % 2**64, (x.high % 2**64 << 64) + x.low % 2**64) for x in simhash.within(df, df).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in values for b in values if (a ^ b).bit_count() <= simhash.RADIUS}


def collapsed(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, v in lists.items():
        if any(len(w) > len(v) and w[: len(v)] == v for w in lists.values()):
            continue
        same = [x for x, w in lists.items() if w == v]
        if c == min(same, key=lambda x: (x is None, x or 0)):
            out[c] = (len(v), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v))
    return out


def test_chats_against_a_loop(spark):
    r = random.Random(3)
    rows = []
    for c in range(60):
        for i in range(r.randint(1, 5)):
            rows.append((c, i, "user" if i % 2 == 0 else "assistant", r.choice("ab") if i < 2 else r.choice("abc")))
    rows += [(100, 1, None, "x"), (100, None, "user", None), (101, 0, "user", "a"), (101, 0, "user", "a"), (102, 5, "user", "same turn"), (102, 5, "user", "twice")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, place string")
    got = {x.conv_id: (x.n_turns, x.n_copies, x.rendered) for x in chat.collapse(df).collect()}
    assert got == collapsed(rows)
    assert chat.collapse(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "   ", "\n"])
def test_texts_without_words_have_no_votes(spark, text):
    assert int(fingerprinted(spark, [(1, text)])[0].fingerprint, 16) == 0


def test_keys_widen_with_the_table():
    """What a query meets by chance grows far slower than the table: by less than the root of it, over six powers of ten."""
    met = []
    for n in (10**5, 10**7, 10**9, 10**11):
        blocks, slips = simhash.plan(n)
        width = 128 // blocks
        assert (slips + 1) * blocks > simhash.RADIUS
        met.append(blocks * sum(math.comb(width, i) for i in range(slips + 1)) * n / 2**width)
    assert all(b <= 12 * a for a, b in zip(met, met[1:], strict=False)) and met[-1] < 1000 * met[0]


@pytest.mark.parametrize("n", [10**4, 10**7, 10**9])
def test_all_pairs_within_the_radius_by_the_tables_of_any_size(spark, n):
    r = random.Random(n)
    base = [r.getrandbits(128) for _ in range(12)]
    values = {b ^ sum(1 << i for i in r.sample(range(128), k)) for b in base for k in (0, 1, 6, 12, 13, 14, 15)} | {b ^ ((1 << 13) - 1 << r.randint(0, 115)) for b in base}
    signed = [((v >> 64) - ((v >> 127) << 64), v % 2**64 - ((v >> 63 & 1) << 64)) for v in values]
    df = spark.createDataFrame(signed, "high long, low long")
    found = [((x.q_high % 2**64 << 64) + x.q_low % 2**64, (x.high % 2**64 << 64) + x.low % 2**64) for x in simhash.within(df, df.limit(30), n=n).collect()]
    asked = [((x.high % 2**64) << 64) + x.low % 2**64 for x in df.limit(30).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in asked for b in values if (a ^ b).bit_count() <= simhash.RADIUS}


def test_rows_of_one_id_are_dealt_over_ranges(spark):
    rows = [(None, f"text {i}") for i in range(1500)] + [(7, f"other {i}") for i in range(900)] + [(i, f"more {i}") for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = simhash.neighbours(df).collect()
        sizes = Counter(x.part for x in got)
        assert len(sizes) >= 10 and max(sizes.values()) < 600
        # one ring through all rows: ids descend, and the text that follows is the next row's
        place = {(x.part, x.place): x for x in got}
        at, seen = got[0], []
        for _ in got:
            seen.append(at)
            after = place[at.next_part, at.next_place]
            assert at.next_text == after.text
            at = after
        assert at == got[0] and sorted(x.text for x in seen) == sorted(t for _, t in rows)
        assert sum(a.key < b.key for a, b in zip(seen, [*seen[1:], seen[0]], strict=True)) == 1
        assert len(simhash.digest(df).collect()) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_no_documents_no_fingerprints(spark):
    assert simhash.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_a_conversation_are_each_one(spark):
    rows = [(None, i % 3, "user", f"text {i}") for i in range(3000)] + [(None, 0, "user", "twice")] * 2 + [(1, 0, "user", "text 0"), (2, 0, "user", "text 3"), (2, 1, "user", "on"), (None, None, None, None), (3, 0, "user", "long " * 200_000)]
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    named = {x.conv_id: (x.n_turns, x.n_copies) for x in got if x.conv_id is not None}
    # text 0 stands with an id and without, text 3 begins a longer conversation
    assert named == {1: (1, 2), 2: (2, 1), 3: (1, 1)}
    alone = [x for x in got if x.conv_id is None]
    assert len(alone) == 3000 + 2 - 2 and {x.n_turns for x in alone} == {1}
    assert max(len(x.rendered) for x in got) > 1_000_000
