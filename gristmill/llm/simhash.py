"""Document fingerprints by SimHash, and all pairs within a Hamming radius by block tables, in DataFrame functions alone.

Terms are pairs of neighbouring words and the last word by itself, weighted by length: long terms are rare. Each term's two
64-bit hashes vote with its weight for the ones among 128 bits. Votes are counted in packed registers, four bits of the
hash to a long of four 16-bit counters, so a term costs 32 sums in generated code; texts are taken in chunks of CHUNK
terms, which the counters can't overflow, and the chunks' counters are added up. A bit is set if more than half of the
weight has voted for it.

Near copies are RADIUS of 128 bits apart at most: of texts with a hundredth of their words replaced (at least one word),
95 % are that near (11 % are within 3 bits), with a fiftieth 76 %, with a twentieth 20 %; unrelated texts are about 64 bits
apart (measured on 1,500 texts of the 0.1 GB table). The search within the radius loses nothing.

Defined results: a null text is empty; a text without words has the fingerprint of zeros; rows with the same doc_id are
all kept and follow one another by text, or by a hash of it where they are very many; a null doc_id comes after all
others; a single document is its own next one; an empty table gives an empty table.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions
from .urlfilter import lower_ascii

CHUNK = 4096
WEIGHT = 7
#: Puts the four low bits of x at bits 0, 16, 32 and 48: (x * SPREAD) & ONES.
SPREAD, ONES = 1 | 1 << 15 | 1 << 30 | 1 << 45, 1 | 1 << 16 | 1 << 32 | 1 << 48
LEAST = -(1 << 63)
CUTS = 256
#: Rows that one range may always hold, whatever their ids.
FEW = 1000
#: Bits that near copies differ in at most.
RADIUS = 13


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), "")


def fingerprints(rows: DataFrame, keys: list[str], carry: list[str], texts: list[str]) -> DataFrame:
    """keys, carry (longs), and for each text column a struct (high, low, weight) named after it with an f before.

    keys identify a row and should be what rows are partitioned by, so that nothing is shuffled.
    """
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("body")) for i, c in enumerate(texts)]))
    # the words are a column of their own, or each use of them would split the text anew
    each = rows.select(*keys, *carry, which.alias("t")).select(*keys, *carry, "t.which", words(F.col("t.body")).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("b"))
    spread = each.select(*keys, *carry, "which", F.posexplode_outer(pairs).alias("at", "term")).select(*keys, *carry, "which", "at", "term.a", "term.b")
    length = F.length("a") + F.coalesce(F.length("b"), F.lit(0))
    voted = spread.select(
        *keys, *carry, "which", F.expr(f"coalesce(at, 0) div {CHUNK}").alias("chunk"), F.xxhash64("a", "b").alias("h0"), F.xxhash64(F.lit("second"), "a", "b").alias("h1"),
        F.when(F.col("a").isNull(), 0).otherwise(F.least(F.lit(WEIGHT), F.greatest(F.lit(1), F.floor(length / 4)))).cast("long").alias("w"),
    )
    registers = [F.expr(f"sum(((shiftrightunsigned(h{k}, {4 * i}) & 15L) * {SPREAD}L & {ONES}L) * w)").alias(f"r{k}_{i}") for k in (0, 1) for i in range(16)]
    parts = voted.groupBy(*keys, "which", "chunk").agg(*[F.max(c).alias(c) for c in carry], F.sum("w").alias("w"), *registers)
    # two 32-bit counters to a long for the sums over chunks
    halves = [F.expr(f"sum(shiftrightunsigned(r{k}_{i}, {s}) & 281470681808895L)").alias(f"c{k}_{i}_{s}") for k in (0, 1) for i in range(16) for s in (0, 16)]
    added = parts.groupBy(*keys, "which").agg(*[F.max(c).alias(c) for c in carry], F.sum("w").alias("w"), *halves)

    def word(k: int) -> Column:
        bits = [f"shiftleft(cast(2 * (shiftrightunsigned(c{k}_{b // 4}_{16 * (b % 2)}, {32 * (b % 4 // 2)}) & 4294967295L) > w as bigint), {b})" for b in range(64)]
        return F.expr(" | ".join(bits))

    marked = added.select(*keys, *carry, "which", word(0).alias("low"), word(1).alias("high"))
    per = [F.max(F.when(F.col("which") == i, F.col(part))).alias(f"{part}_{c}") for i, c in enumerate(texts) for part in ("high", "low")]
    return marked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], *per)


def written(high: str, low: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The share of equal bits."""
    return F.expr(f"1 - (bit_count({a[0]} ^ {b[0]}) + bit_count({a[1]} ^ {b[1]})) / 128D")


def cuts(rows: DataFrame, key: str, pieces: int) -> tuple[list[tuple[int, int]], list[int], tuple[int, int] | None]:
    """(edges, heavy, span): ascending (key, tie) that deal rows into ranges of like size, keys that fill more than one
    range by themselves, and the least and greatest key.

    Reads the keys alone. A heavy key's rows are dealt over ranges by their tie, a hash; there are no more edges than twice
    the ranges, and CUTS of them.
    """
    wanted = min(pieces, CUTS)
    shares = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx(F.col(key), shares, max(1000, 20 * wanted)).alias("b") if shares else F.lit(None).alias("b"), F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    if found["low"] is None:
        return [], [], None
    at = [int(x) for x in found["b"] or ()]
    heavy = sorted({x for x in at if at.count(x) > 1}) if found["n"] >= FEW else []
    edges = {(x, LEAST) for x in at}
    for x in heavy:
        n = at.count(x) + 1
        edges |= {(x, LEAST + (i << 64) // n) for i in range(1, n)}
        if x < found["high"]:
            edges.add((x + 1, LEAST))
    return sorted(edges), heavy, (found["low"], found["high"])


def ranged(edges: list[tuple[int, int]], span: tuple[int, int] | None, pieces: int) -> Column:
    """The number of a row's range by (key, tie), cut evenly again where more than CUTS are wanted."""
    if not edges:
        return F.lit(0).cast("long")
    key, tie = F.col("key"), F.col("tie")
    step = F.size(F.filter(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t")) for k, t in edges]), lambda e: (e["k"] < key) | ((e["k"] == key) & (e["t"] <= tie)))).cast("long")
    finer = -(-pieces // CUTS)
    if finer == 1:
        return step
    lows, highs = [span[0], *(k for k, _ in edges)], [*(k for k, _ in edges), span[1] + 1]
    low = F.element_at(F.array(*[F.lit(float(x)) for x in lows]), (step + 1).cast("int"))
    high = F.element_at(F.array(*[F.lit(float(x)) for x in highs]), (step + 1).cast("int"))
    inner = F.floor((key.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * finer)
    return step * finer + F.least(F.greatest(inner, F.lit(0)), F.lit(finer - 1))


def neighbours(docs: DataFrame) -> DataFrame:
    """(part, place, key, text, next_part, next_place, next_text): each document with the next by descending doc_id, the
    first after the last; part and place name a row.

    One shuffle of the texts, by ranges of doc_id, a task for each. A range's last row finds its next one in a copy of the
    next range's first row, which is sent along; which rows those are is known from the ids alone. Rows of an id that fills
    more than one range (as rows without one may) are ordered, and dealt, by a hash of their text.
    """
    spark = docs.sparkSession
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces = partitions(spark)
    edges, heavy, span = cuts(docs.select(key.alias("key")), "key", pieces)
    # texts are read here only where an id is that frequent
    tie = F.when(key.isin(*heavy), F.xxhash64(text)).otherwise(F.lit(LEAST)) if heavy else F.lit(LEAST)
    rows = docs.select(key.alias("key"), tie.cast("long").alias("tie"), text.alias("text"))
    ids = docs.select(key.alias("key"), tie.cast("long").alias("tie"))
    part = ranged(edges, span, pieces).cast("int")
    # one row for each range, no more than there are edges
    tops = sorted((r["part"], r["top"]) for r in ids.groupBy(part.alias("part")).agg(F.max(F.struct("key", "tie")).alias("top")).collect())
    copies = [(*tops[i][1], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]
    beside = F.broadcast(spark.createDataFrame(copies, "top long, top_tie long, goal int"))
    own = F.struct(part.alias("part"), F.lit(0).alias("copy"))
    sent = F.when(F.col("goal").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("goal").alias("part"), F.lit(1).alias("copy"))))
    met = rows.join(beside, (F.col("key") == F.col("top")) & (F.col("tie") == F.col("top_tie")), "left")
    dealt = met.select("key", "tie", "text", part.alias("home"), F.explode(sent).alias("to")).select("to.part", "to.copy", "home", "key", "tie", "text")
    placed = dealt.repartitionById(tops[-1][0] + 1 if tops else 1, F.col("part"))
    order = W.partitionBy("part").orderBy("copy", F.col("key").desc(), F.col("tie").desc(), "text")
    place = F.row_number().over(order).cast("long")
    # the first copy is of the first row of its own range
    beyond = F.lead("copy").over(order) == 1
    seen = placed.select("part", "copy", "key", "text", place.alias("place"), F.lead("home").over(order).alias("next_part"), F.when(beyond, 1).otherwise(place + 1).cast("long").alias("next_place"), F.lead("text").over(order).alias("next_text"))
    return seen.where("copy = 0").drop("copy")


def edit_test(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text with the last third taken from the next document.

    (part, place, key, next_part, next_place, n_chars, sha0..sha3, high_text, low_text, high_edited, low_edited).
    """
    rows = neighbours(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select("part", "place", "key", "text", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third)).alias("edited"), "next_part", "next_place")
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    quarters = [F.expr(f"cast(conv(substr(sha, {16 * i + 1}, 16), 16, -10) as bigint)").alias(f"sha{i}") for i in range(4)]
    rows = rows.select("part", "place", "key", "next_part", "next_place", "n_chars", "text", "edited", *quarters)
    return fingerprints(rows, ["part", "place"], ["key", "next_part", "next_place", "n_chars", *(f"sha{i}" for i in range(4))], ["text", "edited"])


def plan(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(blocks, slips) for n fingerprints: cut into so many blocks, two within the radius differ in at most `slips` bits of one.

    A query looks up the keys of each of its blocks with up to `slips` bits changed, and meets n / 2^width fingerprints of no
    kin at each: few wide blocks cost look-ups, many narrow ones chance hits, which grow with the table. The cheaper sum
    is taken, so keys widen as the table grows and chance hits stay about as few as look-ups.
    """

    def cost(blocks: int) -> float:
        width = 128 // blocks
        return blocks * sum(comb(width, i) for i in range(radius // blocks + 1)) * (1 + n / 2**width)

    # a block is one long
    blocks = min(range(2, radius + 2), key=cost)
    return blocks, radius // blocks


def within(classes: DataFrame, queries: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """(q_high, q_low, high, low, distance): all fingerprints within the radius of each query fingerprint.

    There is a table for each block of plan(), keyed by its bits; queries are looked up by their own bits and by those with
    some changed, and each pair comes from the first table that holds it. Both inputs should be distinct; n is the
    number of classes, counted where it isn't given.
    """
    blocks, slips = plan(classes.count() if n is None else n, radius)
    edges = [128 * i // blocks for i in range(blocks + 1)]

    def bits(high: str, low: str, a: int, b: int) -> str:
        """Bits a..b of the 128, as a long."""
        mask = f" & {(1 << (b - a)) - 1}L" if b - a < 64 else ""
        if a >= 64 or b <= 64:
            return f"(shiftrightunsigned({high if a >= 64 else low}, {a % 64}){mask})"
        return f"((shiftrightunsigned({low}, {a}) | shiftleft({high}, {64 - a})){mask})"

    def masks(width: int) -> str:
        """All longs with up to `slips` of so many bits."""
        some, bit = "array(0L)", f"transform(sequence(0, {width - 1}), b -> shiftleft(1L, b))"
        for _ in range(slips):
            some = f"array_distinct(concat({some}, flatten(transform({some}, m -> transform({bit}, x -> m | x)))))"
        return some

    def tables(df: DataFrame, changed: bool) -> DataFrame:
        keys = []
        for t, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            own = bits("high", "low", a, b)
            codes = f"transform({masks(b - a)}, m -> {own} ^ m)" if changed else f"array({own})"
            keys.append(f"transform({codes}, c -> named_struct('tab', {t}, 'code', c))")
        return df.select("high", "low", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("k")).select("k.tab", "k.code", "high", "low")

    left = tables(queries.select("high", "low"), slips > 0).select("tab", "code", F.col("high").alias("q_high"), F.col("low").alias("q_low"))
    met = left.join(tables(classes.select("high", "low"), False), ["tab", "code"])
    distance = F.expr("bit_count(q_high ^ high) + bit_count(q_low ^ low)")
    first = [f"(tab <= {t} OR bit_count({bits('(q_high ^ high)', '(q_low ^ low)', a, b)}) > {slips})" for t, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return met.where((distance <= radius) & F.expr(" AND ".join(first))).select("q_high", "q_low", "high", "low", distance.alias("distance"))


EVERY = 20


def within_counts(marked: DataFrame, radius: int) -> DataFrame:
    """(q_high, q_low, n_within): documents within the radius of each queried fingerprint, those that have it included.

    Queries are the fingerprints of every 20th doc_id, searched against those of all documents; copies are counted, not
    paired.
    """
    prints = marked.select("key", F.col("high_text").alias("high"), F.col("low_text").alias("low"))
    classes = materialize(prints.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("key") % EVERY == 0).alias("asked")), "simhash-classes")
    found = within(classes, classes.where("asked"), radius)
    counted = found.join(classes.select("high", "low", "n"), ["high", "low"]).groupBy("q_high", "q_low").agg(F.sum("n").alias("n_within"))
    return materialize(counted, "simhash-within")


def digest(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The contract's row for each document, and for every 20th doc_id how many documents are within the radius, itself included."""
    marked = materialize(edit_test(docs), "simhash")
    following = marked.select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("high_text").alias("high_next"), F.col("low_text").alias("low_next"))
    counted = within_counts(marked, radius)
    both = marked.join(following, ["next_part", "next_place"], "left")
    asked = (F.col("key") % EVERY == 0) & (F.col("high_text") == F.col("q_high")) & (F.col("low_text") == F.col("q_low"))
    both = both.join(counted, asked, "left")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))
    own = ("high_text", "low_text")
    return both.select(
        F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"), "n_chars", sha.alias("edited_sha256"), written(*own).alias("fingerprint"), written("high_edited", "low_edited").alias("edited_fingerprint"),
        likeness(own, ("high_edited", "low_edited")).alias("near_edited"), likeness(own, ("high_next", "low_next")).alias("near_next"), "n_within",
    )
