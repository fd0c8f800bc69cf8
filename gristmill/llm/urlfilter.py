"""URL rules by a blocked Bloom filter and an exact hash join, in DataFrame functions alone.

Rules name a host and the start of a path. A url's candidates are the suffixes of its host that start at a label and have
no more labels than some rule's host, each with the url's path cut to every length that some rule's path has; a host or
path may be as long as it likes. A filter of four 64-bit words a block, one bit in
each for a listed rule, passes possible hits; the join on the rule's text removes those that aren't. The filter's size
is bounded by MAX_BLOCKS whatever the number of rules, so it may be broadcast; the rules themselves are broadcast only
if Spark finds them under spark.sql.autoBroadcastJoinThreshold, else both sides are shuffled by the rule's text.

Defined results: a null url, or one without "://", has an empty host and path; the longest fitting rule wins, at equal
length the one with the longer host; a rule listed twice with other verdicts blocks; rows that are alike are judged each
for itself; with no rules every url gets the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 40 bytes each when broadcast: 10 MB.
MAX_BLOCKS = 1 << 18
WORDS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def bits(word: int) -> Column:
    """The one bit that the hash h sets in a word of its block."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {24 + 6 * word}) & 63 as int))")


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) for the blocks in which a rule's text sets bits."""
    keyed = rules.select(F.xxhash64("rule").alias("h"))
    return keyed.groupBy((F.col("h").bitwiseAND(blocks - 1)).alias("block")).agg(*[F.bit_or(bits(i)).alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url) with rules (host, path, verdict): (page_id, url, host, path, rule, verdict)."""
    listed = rules.groupBy(F.concat(lower_ascii(F.col("host")), F.col("path")).alias("rule")).agg(F.max("verdict").alias("rule_verdict"), F.max(F.length("host")).alias("host_length"))
    size = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    known = listed.agg(F.count("rule").alias("n")).first()["n"]
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    urls = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url").cast("string").alias("url"))
    urls = urls.select("row", "page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if not known:
        return urls.select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 16 < known:
        blocks *= 2
    # negative counts take labels from the end
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, (size["labels"] or 1) + 1)]))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p)))))
    tried = urls.select("row", "page_id", "url", "host", "path", F.explode_outer(keys).alias("key")).withColumn("h", F.xxhash64("key"))
    tried = tried.withColumn("block", F.col("h").bitwiseAND(blocks - 1)).join(F.broadcast(bloom(listed, blocks)), "block", "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bits(i)) != 0)
    # what the filter turns away keeps its row under a key that no rule has and that no other row shares
    passed = tried.select("row", "page_id", "url", "host", "path", F.when(F.coalesce(hit, F.lit(False)), F.col("key")).otherwise(F.concat(F.lit("#"), F.col("row"))).alias("rule_key"))
    joined = passed.join(listed, passed["rule_key"] == listed["rule"], "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("host_length"), F.col("rule"), F.col("rule_verdict"))))
    found = joined.groupBy("row", "page_id", "url", "host", "path").agg(best.alias("best"))
    return found.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"))
