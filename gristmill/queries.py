"""The registered queries of the engine, and for each that SQL can express its DuckDB form."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import hashing, permute, text
from gristmill.operators import bpe, budget, evaluate, metrics, mix, ngram, pack, retokenize, select, sft, tokenize, windows
from gristmill.plans import packages as kept
from gristmill.plans import pretrain, shipping, staging
from gristmill.plans.offsets import numbered, running
from gristmill.sources import config, corpus, cycled, logs, retry, tokenbin
from gristmill.sources.config import Source
from gristmill.streaming import budgets, packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACE_RE2 = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RATIO, SALT = 0.05, "split"
TRAIN, VALIDATION = 100_000, 5_000


def strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{SPACE_RE2}]+', ''), '[{SPACE_RE2}]+$', '')"


def words_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{SPACE_RE2}]+'))"


def held_sql(c: str) -> str:
    return f"(('0x' || substr(sha1('{SALT}' || {c}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE) < {RATIO}::DOUBLE"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(doc_id, source, n, held): stripped documents that aren't blank, a token for each word and one for the end."""
    docs = table(spark, sf_dir, "documents").where(where).select("doc_id", "source", text.strip("text").alias("t")).where("t <> ''")
    return docs.select("doc_id", "source", (tokenize.word_count("t") + 1).alias("n"), hashing.is_validation(F.col("t"), RATIO, SALT).alias("held"))


def lengths(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """measured() with each document's place, seq; texts are read once, the ordered passes go over lengths."""
    return numbered(staging.keep(measured(spark, sf_dir, where)), "doc_id")


def lengths_sql(where: str = "true") -> str:
    return f"""d AS (SELECT doc_id, source, {words_sql('t')} + 1 AS n, {held_sql('t')} AS held, row_number() OVER (ORDER BY doc_id) - 1 AS seq
               FROM (SELECT doc_id, source, {strip_sql('text')} AS t FROM documents WHERE {where}) WHERE t <> '')"""


ROUTED_SQL = f"""
    c AS (SELECT *, sum(CASE WHEN held THEN n ELSE 0 END) OVER (ORDER BY seq) AS cv, sum(CASE WHEN held THEN 0 ELSE n END) OVER (ORDER BY seq) AS ct FROM d),
    a AS (SELECT coalesce(min(CASE WHEN cv >= {VALIDATION} THEN seq END), 1::BIGINT << 61) AS v, coalesce(min(CASE WHEN ct >= {TRAIN} THEN seq END), 1::BIGINT << 61) AS t FROM c),
    r AS (SELECT seq, n, CASE WHEN seq <= least(v, t) THEN (CASE WHEN held THEN 'validation' ELSE 'train' END) WHEN v <= t THEN 'train' ELSE 'validation' END AS split FROM c, a),
    o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE split WHEN 'train' THEN {TRAIN} ELSE {VALIDATION} END AS target FROM r)"""


@query(f"""WITH {lengths_sql("lang = 'en'")}, {ROUTED_SQL}
    SELECT split, count(*) AS documents, sum(least(n, target - start))::BIGINT AS tokens, max(seq) AS last_seq FROM o WHERE start < target GROUP BY split""")
def pretrain_route_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = budget.route(lengths(spark, sf_dir, "lang = 'en'"), "seq", "n", "held", TRAIN, VALIDATION)
    return routed.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.sum("written").alias("tokens"), F.max("seq").alias("last_seq"))


@query(f"""WITH {lengths_sql()}, {ROUTED_SQL}
    SELECT split, count(*) AS documents, sum(n)::BIGINT AS tokens, max(seq) AS last_seq FROM o WHERE start < target GROUP BY split""")
def route_no_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = budget.route(lengths(spark, sf_dir), "seq", "n", "held", TRAIN, VALIDATION, truncate=False)
    return routed.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.sum("written").alias("tokens"), F.max("seq").alias("last_seq"))


@query(f"""WITH {lengths_sql()}, o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
    SELECT doc_id, start::BIGINT AS start, greatest(0, least(n, {TRAIN} - start))::BIGINT AS written, (n - greatest(0, least(n, {TRAIN} - start)))::BIGINT AS skipped FROM o""")
def budgeted_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.budgeted(lengths(spark, sf_dir), "seq", "n", TRAIN).select("doc_id", "start", "written", "skipped")


@query(f"""WITH {lengths_sql()}, w AS (SELECT doc_id, n, seq, seq % 4 AS worker FROM d),
    o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY worker, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w)
    SELECT worker, count(*) AS documents, sum(least(n, {TRAIN} - start))::BIGINT AS tokens FROM o WHERE start < {TRAIN} GROUP BY worker""")
def merged_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lengths(spark, sf_dir).withColumn("worker", F.col("seq") % 4)
    return budget.merged(parts, "worker", "seq", "n", TRAIN).groupBy("worker").agg(F.count(F.lit(1)).alias("documents"), F.sum("written").alias("tokens"))


FILTERS = {"language": "en", "score_min": 1, "token_count_min": 100, "token_count_max": 20_000}
SCORED_SQL = "SELECT d.doc_id, lang AS language, quality AS score, n_chars / 1000.0 AS language_score, n_chars AS token_count, row_number() OVER (ORDER BY d.doc_id) - 1 AS seq FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), (F.col("n_chars") / 1000.0).alias("language_score"), F.col("n_chars").alias("token_count"))
    rated = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id", "left")
    return numbered(rated, "doc_id")


@query(f"WITH s AS ({SCORED_SQL}) SELECT doc_id, score, token_count FROM s WHERE language = 'en' AND score >= 1 AND token_count BETWEEN 100 AND 20000")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.quality_filter(scored(spark, sf_dir), FILTERS).select("doc_id", "score", "token_count")


@query(f"""WITH s AS ({SCORED_SQL}) SELECT doc_id, ((seq // 100) * 100 + row_number() OVER (PARTITION BY seq // 100 ORDER BY score DESC NULLS LAST, language_score DESC NULLS LAST, seq) - 1)::BIGINT AS place FROM s""")
def quality_rank_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.buffered_rank(scored(spark, sf_dir), "seq", 100).select("doc_id", "place")


@query(f"WITH s AS ({SCORED_SQL}) SELECT doc_id, seq FROM s WHERE seq % 3 = 1")
def modulo_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.shard(scored(spark, sf_dir), "seq", 1, 3).select("doc_id", "seq")


@query(f"""WITH s AS ({SCORED_SQL}), p AS (SELECT * FROM s WHERE seq % 2 = 0 AND language = 'en' AND score >= 1 AND token_count BETWEEN 100 AND 20000),
    q AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM p)
    SELECT doc_id, ((r // 50) * 50 + row_number() OVER (PARTITION BY r // 50 ORDER BY score DESC NULLS LAST, language_score DESC NULLS LAST, r) - 1)::BIGINT AS place FROM q""")
def ranked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.samples(scored(spark, sf_dir).drop("seq"), "doc_id", FILTERS, 0, 2, buffer=50).select("doc_id", "place")


@query(f"""WITH {lengths_sql()} SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, count(*) AS documents, sum(n)::BIGINT AS tokens FROM d GROUP BY 1""")
def hash_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("held"), "validation").otherwise("train").alias("split")
    return measured(spark, sf_dir).groupBy(split).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


@query(f"""WITH l AS (SELECT doc_id, regexp_replace({strip_sql('text')}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g') AS line FROM documents),
    k AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM l WHERE line <> '')
    SELECT r // 100 AS chunk, count(*) AS lines, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes, min(doc_id) AS first_doc FROM k GROUP BY 1""")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.corpus_lines(table(spark, sf_dir, "documents"), "doc_id", 100)
    return lines.groupBy("chunk").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"), F.min("seq").alias("first_doc"))


@query(f"""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents)
    SELECT seq % 3 AS worker, count(*) AS rows, min(doc_id) AS first_doc FROM s WHERE seq // 3 < CASE WHEN seq % 3 < 2 THEN 67 ELSE 66 END GROUP BY 1""")
def worker_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return corpus.worker_chunks(rows, "seq", 3, 200).groupBy("worker").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {lengths_sql()} SELECT source, count(*) AS samples, sum(n)::BIGINT AS tokens FROM d GROUP BY source")
def corpus_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.corpus_count(measured(spark, sf_dir), "source", F.col("n"))


@query(f"""WITH d AS (SELECT {words_sql('text')} AS n, length({strip_sql('text')}) AS k FROM documents)
    SELECT count(*) AS seen, count_if(k = 0)::BIGINT AS blank, count_if(k > 0 AND n < 50)::BIGINT AS short, count_if(n >= 50)::BIGINT AS kept, sum(CASE WHEN n >= 50 THEN n + 1 ELSE 0 END)::BIGINT AS tokens FROM d""")
def skip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(tokenize.word_count("text").alias("n"), F.length(text.strip("text")).alias("k"))
    return rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("k") == 0).alias("blank"), F.count_if((F.col("k") > 0) & (F.col("n") < 50)).alias("short"), F.count_if(F.col("n") >= 50).alias("kept"), F.sum(F.when(F.col("n") >= 50, F.col("n") + 1).otherwise(0)).alias("tokens"))


STARTS_SQL = "p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)"
SPANS_SQL = "x AS (SELECT *, unnest(generate_series(start // {S}, (start + n - 1) // {S})) AS shard FROM p), y AS (SELECT *, greatest(0, shard * {S} - start) AS low, least(n, (shard + 1) * {S} - start) AS high FROM x)"


@query(f"WITH {lengths_sql()}, {STARTS_SQL}, {SPANS_SQL.replace('{S}', '4096')} SELECT shard, count(*) AS documents, sum(high - low)::BIGINT AS tokens, min(seq) AS first_seq, max(seq) AS last_seq FROM y GROUP BY shard")
def pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pack.shard_spans(pack.placed(lengths(spark, sf_dir), "seq", "n"), "n", 4096)
    return spans.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("high") - F.col("low")).alias("tokens"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {lengths_sql()}, {STARTS_SQL}, {SPANS_SQL.replace('{S}', '8192')} SELECT shard AS package, source, count(*) AS samples, sum(high - low)::BIGINT AS tokens FROM y GROUP BY shard, source")
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packages(pack.placed(lengths(spark, sf_dir), "seq", "n"), "n", 8192)


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, n, ids): the length of each word, and 0 for the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.transform(text.words("text"), lambda w: F.length(w)), F.array(F.lit(0))).alias("ids"))
    return staging.keep(docs.select(F.col("doc_id").alias("seq"), F.size("ids").cast("long").alias("n"), "ids"))


def placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_tokens with the offset of each document; only lengths go through the ordered sums."""
    rows = word_tokens(spark, sf_dir)
    return pack.placed(rows.select("seq", "n"), "seq", "n").join(rows.drop("n"), "seq")


WORD_STREAM_SQL = f"""t AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(text, '[^{SPACE_RE2}]+'), lambda w: length(w)), 0) AS ids FROM documents),
    u AS (SELECT doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS i FROM t),
    stream AS (SELECT (row_number() OVER (ORDER BY doc_id, i) - 1)::BIGINT AS pos, tok::BIGINT AS tok FROM u)"""


def digest(ids: str, first: Column | int = 0, period: int = 97) -> Column:
    """The sum of an array's ids, each times its place from `first` on, modulo the period, and one."""
    return F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * ((first + i) % period + 1)), F.lit(0).cast("long"), lambda a, b: a + b)


@query(f"""WITH {WORD_STREAM_SQL}, n AS (SELECT count(*) AS n FROM stream),
    w AS (SELECT s.start, pos - s.start AS k, tok FROM (SELECT unnest(generate_series(0::BIGINT, (SELECT n FROM n) - 1025, 1024)) AS start) s JOIN stream ON pos BETWEEN s.start AND s.start + 1024)
    SELECT start, sum(CASE WHEN k < 1024 THEN tok * (k % 97 + 1) END)::BIGINT AS input_sum, sum(CASE WHEN k > 0 THEN tok * ((k - 1) % 97 + 1) END)::BIGINT AS target_sum FROM w GROUP BY start""")
def eval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pack.windows(pack.shards(placed_words(spark, sf_dir), "ids", "n", 1 << 16, overlap=1024), 1024, 1 << 16)
    return cut.select("start", digest("input").alias("input_sum"), digest("target").alias("target_sum"))


@query(f"""WITH {lengths_sql()}, n AS (SELECT sum(n)::BIGINT AS n FROM d), s AS (SELECT unnest(generate_series(1 * 512::BIGINT, (SELECT n FROM n) - 512 - 1, 512 * 4)) AS start)
    SELECT start, (row_number() OVER (ORDER BY start) - 1) // 8 AS batch FROM s""")
def rank_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = measured(spark, sf_dir).agg(F.sum("n")).first()[0] or 0
    return pack.batches(pack.window_starts(spark, total, 512, rank=1, world=4), 8)


CONV_SQL = "m AS (SELECT conv_id, turn, coalesce(lower(role), '') AS role, " + strip_sql("coalesce(text, '')") + " AS content FROM conversations)"
LABEL_SQL = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' WHEN '' THEN 'User' ELSE upper(role[1]) || role[2:] END"


@query(f"WITH {CONV_SQL} SELECT c.conv_id, coalesce(string_agg({LABEL_SQL} || ': ' || content, chr(10) ORDER BY turn) FILTER (content <> ''), '') AS text FROM m c GROUP BY c.conv_id")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.from_turns(table(spark, sf_dir, "conversations")).select("conv_id", text.conversation(F.col("messages")).alias("text"))


QA_SQL = "q AS (SELECT conv_id, (array_agg(text ORDER BY turn) FILTER (role = 'user'))[1] AS question, (array_agg(text ORDER BY turn) FILTER (role = 'assistant'))[1] AS answer FROM conversations GROUP BY conv_id)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(*[F.min(F.when(F.col("role") == r, F.struct("turn", "text")))["text"].alias(n) for r, n in (("user", "question"), ("assistant", "answer"))])


@query(f"WITH {QA_SQL} SELECT conv_id, CASE WHEN coalesce(trim(question), '') = '' OR coalesce(trim(answer), '') = '' THEN '' ELSE 'User: ' || {strip_sql('question')} || chr(10) || 'Assistant: ' || {strip_sql('answer')} END AS text FROM q")
def qa_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir)
    return rows.select("conv_id", text.formatted(["question", "answer"], "gsm8k").alias("text"))


NORMAL_SQL = f"{CONV_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM m WHERE role <> '' AND content <> ''), t AS (SELECT conv_id, i, role, CASE WHEN i > 1 THEN chr(10) ELSE '' END || {LABEL_SQL} || ': ' || content AS body FROM k)"


@query(f"WITH {NORMAL_SQL} SELECT conv_id, i::BIGINT AS place, role, body FROM t")
def sft_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = sft.from_turns(table(spark, sf_dir, "conversations"))
    turns = sft.turns(convs.select("conv_id", sft.messages(["messages"], "chat").alias("messages")))
    each = turns.select("conv_id", F.posexplode(F.arrays_zip(F.col("messages"), F.col("texts"))).alias("i", "x"))
    return each.select("conv_id", (F.col("i") + 1).cast("long").alias("place"), F.col("x.messages.role").alias("role"), F.col("x.texts").alias("body"))


@query(f"""WITH {NORMAL_SQL} SELECT conv_id, sum(octet_length(encode(body)))::BIGINT + 1 AS inputs, sum(CASE WHEN role = 'assistant' THEN octet_length(encode(body)) ELSE 0 END)::BIGINT + 1 AS learnt FROM t GROUP BY conv_id""")
def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = sft.from_turns(table(spark, sf_dir, "conversations"))
    turns = sft.turns(convs.select("conv_id", sft.messages(["messages"], "chat").alias("messages"))).where(F.size("messages") > 0)
    ids = turns.select("conv_id", "learnt", F.transform("texts", tokenize.byte_ids).alias("ids"))
    tokens, labels = sft.masked(F.col("ids"), F.col("learnt"), 256, 257)
    inputs, targets = sft.shifted(F.col("tokens"), F.col("labels"))
    pairs = ids.select("conv_id", tokens.alias("tokens"), labels.alias("labels")).select("conv_id", inputs.alias("inputs"), targets.alias("targets"))
    return pairs.select("conv_id", F.size("inputs").cast("long").alias("inputs"), F.size(F.filter("targets", lambda x: x != sft.IGNORED)).cast("long").alias("learnt"))


@query(f"""WITH {CONV_SQL} SELECT conv_id, 'System: You are a helpful assistant.' || chr(10) || string_agg(CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE 'User' END || ': ' || content, chr(10) ORDER BY turn) || chr(10) || 'Assistant:' AS prompt
    FROM m WHERE content <> '' GROUP BY conv_id""")
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.from_turns(table(spark, sf_dir, "conversations")).select("conv_id", text.chat_prompt(F.col("messages")).alias("prompt"))


@query(f"""WITH p AS (SELECT doc_id, replace(text, '. ', chr(10) || 'User:') AS t FROM documents) SELECT doc_id, CASE WHEN position(chr(10) || 'User:' IN t) > 0 THEN substr(t, 1, position(chr(10) || 'User:' IN t) - 1) ELSE t END AS text FROM p""")
def trim_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit(". "), F.lit("\nUser:"))
    return table(spark, sf_dir, "documents").select("doc_id", text.trim_stops(marked).alias("text"))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{SPACE_RE2}]+') AS w FROM documents)
    SELECT doc_id, len(w)::BIGINT AS prompt_tokens, least(len(w), 16)::BIGINT AS context_tokens, len(w) > 16 AS truncated, array_to_string(w[greatest(1, len(w) - 15):], ' ') AS context FROM t""")
def left_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.words("text").alias("w"))
    kept = rows.withColumn("c", text.left_truncated(F.col("w"), 16))
    return kept.select("doc_id", F.size("w").cast("long").alias("prompt_tokens"), F.size("c").cast("long").alias("context_tokens"), (F.size("w") > 16).alias("truncated"), F.array_join("c", " ").alias("context"))


@query(f"""WITH d AS (SELECT {words_sql('text')} AS w, length(text) AS c, octet_length(encode(text)) AS b FROM documents)
    SELECT round(sum(b)::DOUBLE / sum(w), 9) AS tokens_per_word, round(sum(b)::DOUBLE / sum(c), 9) AS tokens_per_char, round(sum(c)::DOUBLE / sum(b), 9) AS chars_per_token FROM d""")
def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.fertility(table(spark, sf_dir, "documents"), F.col("text"), F.octet_length("text"))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(f"""WITH {WORD_STREAM_SQL}, g AS (SELECT *, coalesce(sum(CASE WHEN tok = 0 THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc FROM stream)
    SELECT doc, count_if(tok <> 0)::BIGINT AS ids, coalesce(sum(tok), 0)::BIGINT AS total, max(CASE WHEN tok = 0 THEN 1 ELSE 0 END) = 0 AS partial FROM g GROUP BY doc""")
def retokenize_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retokenize.shard_documents(pack.shards(placed_words(spark, sf_dir), "ids", "n", 1 << 16), 0)
    return found.select("doc", F.size("ids").cast("long").alias("ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), "partial")


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^{SPACE_RE2}]+')) AS piece FROM documents), c AS (SELECT hex(encode(piece)) AS h, count(*) AS n FROM w GROUP BY piece),
    p AS (SELECT n, substr(h, 2 * i - 1, 2) AS a, substr(h, 2 * i + 1, 2) AS b FROM c, unnest(generate_series(1, length(h) // 2 - 1)) AS t(i)) SELECT a, b, sum(n)::BIGINT AS n FROM p GROUP BY a, b""")
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = table(spark, sf_dir, "documents").select(F.explode(text.words("text")).alias("piece"))
    return bpe.pair_counts(spread.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))


#: The first stage's pieces in RE2, which has no lookahead: a mark, put before the last space of a run that a word follows, stands for it.
PIECES_RE2 = (
    r"[^\r\n\p{L}\p{N}\x{E000}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}\x{E000}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|"
    r"\p{N}{1,3}| ?[^\s\p{L}\p{N}\x{E000}]+[\r\n/]*|\s*[\r\n]+|\s+\x{E000}|\s+|\x{E000}"
)


@query(f"""WITH m AS (SELECT regexp_replace(text, '(\\s+)([^\\S\\r\\n])(\\S)', '\\1' || chr(57344) || '\\2\\3', 'g') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT replace(unnest(regexp_extract_all(t, '{PIECES_RE2}')), chr(57344), '') AS piece FROM m) SELECT piece, count(*) AS n FROM p WHERE piece <> '' GROUP BY piece""")
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.piece_counts(table(spark, sf_dir, "documents"))


MIX = [Source("a", "documents", target_tokens=700), Source("b", "documents", target_tokens=200), Source("c", "documents", target_tokens=100)]


@query("SELECT source AS name, sum(n_chars)::BIGINT AS target_tokens, round(sum(n_chars)::DOUBLE / (SELECT sum(n_chars) FROM documents), 9) AS weight FROM documents GROUP BY source")
def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").cast("long").alias("target_tokens"))
    return mix.shares(sums, "target_tokens", "weight").withColumn("weight", F.round("weight", 9))


@query("""WITH w AS (SELECT source, sum(n_chars)::BIGINT AS w FROM documents WHERE source IS NOT NULL GROUP BY source), r AS (SELECT source, w * 1000.0::DOUBLE / (SELECT sum(w) FROM w) AS share FROM w),
    b AS (SELECT source, share - floor(share) AS fraction, greatest(1, floor(share))::BIGINT AS n FROM r), m AS (SELECT 1000 - sum(n) AS missing FROM b),
    c AS (SELECT source, n + CASE WHEN row_number() OVER (ORDER BY fraction DESC) = 1 THEN missing ELSE 0 END AS n FROM b, m)
    SELECT source, (5 * n)::BIGINT AS slots, 0::BIGINT AS first_k, (5 * n - 1)::BIGINT AS last_k FROM c""")
def mixture_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five windows of slots for the documents' sources by their lengths; what rounding leaves goes to one source."""
    sums = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.sum("n_chars").cast("long").alias("n")).orderBy("source")
    # a row for each source, as in a configuration
    sources = [Source(r["source"], "documents", target_tokens=r["n"]) for r in sums.collect()]
    return mix.slots(spark, sources, 5000, seed=7, window=1000).groupBy("source").agg(F.count(F.lit(1)).alias("slots"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


def shuffled_slots(seed: int, windows: int) -> str:
    """The names in MIX's slots, a letter each: ten to a window, shuffled by Python's generator, which has drawn nothing before."""
    draw, out = random.Random(seed), ""
    for _ in range(windows):
        window = list("aaaaaaabbc")
        draw.shuffle(window)
        out += "".join(window)
    return out


def slots_sql(seed: int, windows: int) -> str:
    return f"""z AS (SELECT range AS slot, substr('{shuffled_slots(seed, windows)}', range::BIGINT + 1, 1) AS source FROM range({10 * windows})),
    sl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM z)"""


def epochs_sql(rows: str, seed: int, n: int) -> str:
    """(source, k, …) of rows (source, place, seq, …), place telling the sources' seeds apart; n is how many a source may need."""
    return f"""h AS (SELECT source, count(*) AS have FROM {rows} GROUP BY source),
    ep AS (SELECT r.*, e, substr(sha1((place + {seed} + e)::VARCHAR || ':' || seq), 1, 10) AS o FROM {rows} r JOIN h USING (source), unnest(generate_series(0::BIGINT, {n} // have)) AS t(e)),
    ek AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY e, o, seq) - 1 AS k FROM ep)"""


@query(f"""WITH {slots_sql(7, 100)}, m AS (SELECT chr((97 + doc_id % 3)::INTEGER) AS source, doc_id % 3 AS place, doc_id AS seq FROM documents), {epochs_sql('m', 11, 1000)}
    SELECT slot, source, k, seq AS doc_id FROM sl JOIN ek USING (source, k)""")
def mixture_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = {s.name: mix.epochs(docs.where(F.pmod("doc_id", F.lit(3)) == i), 1000, 11 + i, "doc_id").select("k", "doc_id") for i, s in enumerate(MIX)}
    return mix.interleave(mix.slots(spark, MIX, 1000, seed=7, window=10), parts).select("slot", "source", "k", "doc_id")


STEPS_SQL = "s AS (SELECT event_id AS step, value FROM events)"


@query(f"WITH {STEPS_SQL} SELECT step, round(CASE WHEN greatest(1, step + 1) <= 200 THEN 0.001::DOUBLE * greatest(1, step + 1) / 200 ELSE 0.0001::DOUBLE + 0.0009::DOUBLE * 0.5 * (1 + cos(pi() * least(1, greatest(0, (step + 1 - 200) / 5800::DOUBLE)))) END, 9) AS rate, round(0.001::DOUBLE * CASE WHEN step < 200 THEN (step + 1) / 200::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(1, greatest(0, (step - 200) / 5800::DOUBLE)))) END, 9) AS legacy_rate FROM s")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates at the steps that a log has."""
    steps = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return steps.select("step", F.round(metrics.learning_rate(F.col("step"), 1e-3, 200, 6000, 1e-4), 9).alias("rate"), F.round(metrics.legacy_learning_rate(F.col("step"), 1e-3, 200, 6000, 1e-4), 9).alias("legacy_rate"))


@query(f"WITH {STEPS_SQL}, p AS (SELECT step, greatest(1e-9, value / 100) AS sec FROM s) SELECT step, (step * 262144)::BIGINT AS tokens_seen, round(262144 / sec, 3) AS tokens_per_second, round(128 / sec, 3) AS samples_per_second, round(step * 262144 / 4000000::DOUBLE, 6) AS epoch_equivalent, round(least(1, step * 262144 / 1100000000::DOUBLE) * 100, 6) AS token_progress_percent FROM p")
def progress_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("value") / 100).alias("step_time_seconds"))
    out = metrics.progress(steps, metrics.tokens_per_step(4, 16, 2048, 2), 128, 4_000_000, 1_100_000_000)
    return out.select("step", "tokens_seen", *[F.round(c, 3).alias(c) for c in out.columns[2:4]], *[F.round(c, 6).alias(c) for c in out.columns[4:]])


LOG_SQL = "g AS (SELECT event_id + 1 AS step, CASE WHEN (event_id + 1) % 3 = 0 THEN 4.0 - value / 200.0::DOUBLE END AS val_loss, CASE WHEN (event_id + 1) % 5 = 0 THEN 3.9 - value / 200.0::DOUBLE END AS validation_loss FROM events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, row, val_loss, validation_loss): events as a run's log, each third row with a loss, each fifth with another."""
    s = F.col("event_id") + 1
    return table(spark, sf_dir, "events").select(s.alias("step"), s.alias("row"), F.when(s % 3 == 0, 4.0 - F.col("value") / 200.0).alias("val_loss"), F.when(s % 5 == 0, 3.9 - F.col("value") / 200.0).alias("validation_loss"))


@query(f"WITH {LOG_SQL} SELECT step::DOUBLE AS step, round(coalesce(val_loss, validation_loss), 6) AS value FROM g WHERE coalesce(val_loss, validation_loss) IS NOT NULL")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.series(log(spark, sf_dir), "validation_loss").select("step", F.round("value", 6).alias("value"))


@query(f"WITH {LOG_SQL} SELECT step, round(val_loss * 0.23::DOUBLE / ln(2), 6) AS bits_per_char, round(exp(val_loss * 0.23::DOUBLE), 6) AS char_perplexity, round(exp(least(100, val_loss)), 6) AS perplexity FROM g WHERE val_loss IS NOT NULL")
def bpc_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, loss, rate = log(spark, sf_dir).where("val_loss IS NOT NULL"), F.col("val_loss"), F.lit(0.23)
    return rows.select("step", F.round(metrics.bits_per_character(loss, rate), 6).alias("bits_per_char"), F.round(metrics.character_perplexity(loss, rate), 6).alias("char_perplexity"), F.round(metrics.perplexity(loss), 6).alias("perplexity"))


@query(f"WITH {LOG_SQL} SELECT step, round(val_loss, 6) AS a, round(validation_loss, 6) AS b, round(val_loss - validation_loss, 6) AS difference FROM g WHERE val_loss IS NOT NULL AND validation_loss IS NOT NULL")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    both = metrics.compared(rows.where("val_loss IS NOT NULL").select("step", F.col("val_loss").alias("loss")), rows.where("validation_loss IS NOT NULL").select("step", F.col("validation_loss").alias("loss")), "step", "loss")
    return both.select("step", *[F.round(c, 6).alias(c) for c in ("a", "b", "difference")])


def ngram_sql(asked: str, corpus: str) -> str:
    """CTEs from rows asked (id, choice, w, begin) and corpus (w) to s (id, choice, tokens, score)."""
    return f"""g AS (SELECT g, count(*) AS n FROM (SELECT array_to_string(list_slice(w, i - k + 1, i), ' ') AS g FROM {corpus}, range(1, 4) AS t(k), unnest(generate_series(1, len(w))) AS u(i) WHERE i >= k) GROUP BY g),
    big AS (SELECT greatest(1, sum(len(w)))::DOUBLE AS n FROM {corpus}),
    p AS (SELECT id, choice, i, list_slice(w, i - 2, i) AS x3, list_slice(w, i - 1, i) AS x2, w[i] AS x1 FROM {asked}, unnest(generate_series(begin + 1, len(w))) AS u(i)),
    v AS (SELECT p.id, p.choice, p.i, CASE WHEN i >= 3 THEN coalesce(a.n, 0) ELSE 0 END AS c3, CASE WHEN i >= 3 THEN coalesce(b.n, 0) ELSE 0 END AS d3, CASE WHEN i >= 2 THEN coalesce(c.n, 0) ELSE 0 END AS c2, CASE WHEN i >= 2 THEN coalesce(d.n, 0) ELSE 0 END AS d2, coalesce(e.n, 0) AS c1
        FROM p LEFT JOIN g a ON i >= 3 AND a.g = array_to_string(x3, ' ') LEFT JOIN g b ON i >= 3 AND b.g = x3[1] || ' ' || x3[2] LEFT JOIN g c ON i >= 2 AND c.g = array_to_string(x2, ' ') LEFT JOIN g d ON i >= 2 AND d.g = x2[1] LEFT JOIN g e ON e.g = x1),
    s AS (SELECT id, choice, count(*) AS tokens, sum(CASE WHEN c3 > 0 AND d3 > 0 THEN ln(c3::DOUBLE / d3) WHEN c2 > 0 AND d2 > 0 THEN ln(0.4::DOUBLE * c2 / d2) WHEN c1 > 0 THEN ln(0.16::DOUBLE * c1 / big.n) ELSE ln(0.064::DOUBLE / big.n) END) AS score FROM v, big GROUP BY id, choice)"""


def split_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{SPACE_RE2}]+')"


@query(f"""WITH d AS (SELECT doc_id, {split_sql('t')} AS w, {held_sql('t')} AS held FROM (SELECT doc_id, {strip_sql("coalesce(text, '')")} AS t FROM documents)),
    k AS (SELECT w FROM d WHERE NOT held), q AS (SELECT doc_id AS id, 0 AS choice, w, 0 AS begin FROM d WHERE held), {ngram_sql('q', 'k')}
    SELECT round(-sum(score) / sum(tokens), 6) AS loss, round(exp(least(100, -sum(score) / sum(tokens))), 4) AS perplexity FROM s""")
def perplexity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents held out, by an n-gram model of the others."""
    stripped = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.strip(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    rows = stripped.select("id", text.words("t").alias("words"), F.lit(0).alias("begin"), hashing.is_validation(F.col("t"), RATIO, SALT).alias("held"))
    found = ngram.scored(rows.where("held"), rows.where("NOT held"), ["id"]).withColumn("loss", -F.col("score") / F.col("tokens"))
    return metrics.weighted_loss(found, "loss", "tokens").select(F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"))


#: The second half of an item's words in four parts, of which the first follows its context, is turned by the item's number.
ITEMS_SQL = f"""b AS (SELECT item_id, {split_sql('text')} AS w FROM benchmark WHERE text IS NOT NULL), h AS (SELECT item_id, w, len(w) // 2 AS half, (len(w) - len(w) // 2) // 4 AS part FROM b WHERE len(w) >= 8),
    c AS (SELECT item_id AS id, (j + item_id) % 4 AS choice, item_id % 4 AS label, list_slice(w, 1, half) AS context, list_slice(w, half + j * part + 1, CASE WHEN j = 3 THEN len(w) ELSE half + (j + 1) * part END) AS ending FROM h, range(4) AS t(j)),
    q AS (SELECT id, choice, label, list_concat(context, ending) AS w, len(context) AS begin FROM c), k AS (SELECT {split_sql('text')} AS w FROM documents WHERE text IS NOT NULL)"""


@query(f"WITH {ITEMS_SQL}, {ngram_sql('q', 'k')}, r AS (SELECT id, choice, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, choice) AS k FROM s JOIN q USING (id, choice)) SELECT count_if(choice = label)::BIGINT AS correct, count(*) AS total, round(count_if(choice = label)::DOUBLE / count(*), 9) AS accuracy FROM r WHERE k = 1")
def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of an item follows its first half, by an n-gram model of the documents."""
    w = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", text.words("text").alias("w")).where("size(w) >= 8")
    w = w.withColumns({"half": F.expr("size(w) div 2"), "part": F.expr("(size(w) - size(w) div 2) div 4")})
    parts = [F.array_join(F.slice("w", F.col("half") + j * F.col("part") + 1, F.col("part") if j < 3 else F.size("w")), " ") for j in range(4)]
    turned = F.array(*[F.element_at(F.array(*parts), (F.pmod(F.lit(j) - F.col("item_id"), F.lit(4)) + 1).cast("int")) for j in range(4)])
    items = w.select(F.col("item_id").alias("id"), F.array_join(F.slice("w", F.lit(1), F.col("half")), " ").alias("context"), turned.alias("endings"), (F.col("item_id") % 4).cast("int").alias("label"))
    corpus_ = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(text.words("text").alias("words"))
    rated = ngram.rated(evaluate.candidates(items), corpus_, text.words)
    return evaluate.accuracy(evaluate.chosen(rated), F.col("choice") == F.col("label")).withColumn("accuracy", F.round("accuracy", 9))


@query("WITH i AS (SELECT o_orderkey AS id, 'so #### ' || (o_orderkey % 7) AS answer, 'it is ' || (o_orderkey % 5) || ' or -' || (o_orderkey % 3) || '.5 or ' || (o_orderkey % 7) || CASE WHEN o_orderkey % 2 = 0 THEN ' #### ' || (o_orderkey % 7) ELSE ' done' END AS generated FROM orders) SELECT count_if(o)::BIGINT AS correct, count(*) AS total, 1.0::DOUBLE AS accuracy FROM (SELECT trim(str_split(answer, '####')[-1]) = CASE WHEN contains(generated, '####') THEN trim(str_split(generated, '####')[-1]) ELSE regexp_extract_all(generated, '-?\\d+(?:\\.\\d+)?')[-1] END AS o FROM i)")
def gsm8k_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("so #### "), k % 7).alias("answer"), F.concat(F.lit("it is "), k % 5, F.lit(" or -"), k % 3, F.lit(".5 or "), k % 7, F.when(k % 2 == 0, F.concat(F.lit(" #### "), k % 7)).otherwise(F.lit(" done"))).alias("generated"))
    return evaluate.accuracy(items, evaluate.exact_match(F.col("answer"), F.col("generated")))


@query("SELECT item_id AS id, trim_c AS context, opt || rest AS ending FROM (SELECT item_id, text[1:position(' ' IN text) - 1] AS trim_c, 'x' || item_id AS opt, text[position(' ' IN text) + 1:] AS rest FROM benchmark)")
def winogrande_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace("text", "^([^ ]*) ", "$1_").alias("sentence"), F.concat(F.lit("x"), "item_id").alias("option1"), F.lit("y").alias("option2"), F.lit("1").alias("answer"))
    return evaluate.winogrande(items).select("id", "context", F.col("endings")[0].alias("ending"))


@query("SELECT item, logit FROM (SELECT o_custkey AS item, (o_orderkey % 11)::DOUBLE AS logit, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 11 DESC) AS r FROM orders) WHERE r <= 2")
def top_k_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 11).cast("double").alias("logit"))
    return evaluate.top_k(rows, 2)


@query("SELECT 'step_' || lpad((o_orderkey * 10)::VARCHAR, 10, '0') || '.pt' AS name FROM orders ORDER BY name DESC OFFSET 3")
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("step_"), F.lpad((F.col("o_orderkey") * 10).cast("string"), 10, "0"), F.lit(".pt")).alias("name"))
    return select.keep_newest(names, "name", 3)


ERRORS = ["408 Client Error: Request Time-out for url", "404 Client Error: Not Found", "read timed out", "HTTP error: 503", "disk full", "status 500 of jobs", "Connection reset by peer"]


@query("SELECT o_orderkey AS id, o_orderkey % 7 IN (0, 2, 3, 6) AS transient FROM orders")
def transient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of orders that failed."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.element_at(F.array(*map(F.lit, ERRORS)), (k % 7 + 1).cast("int")), F.lit(", order "), k, F.lit(".")).alias("message"))
    return rows.select("id", retry.transient_message(F.col("message")).alias("transient"))


PARAMETERS = ["tok_embeddings.weight", "layers.{}.attn.wq", "layers.{}.mlp.w1", "layers.{}.attn_norm.weight", "norm.weight", "lm_head.weight", "rope.freqs", "layers.{}.attn.q_norm"]


@query("SELECT CASE p_partkey % 8 WHEN 0 THEN 'embedding' WHEN 1 THEN 'attention' WHEN 2 THEN 'ffn' WHEN 3 THEN 'norm' WHEN 4 THEN 'norm' WHEN 5 THEN 'lm_head' WHEN 6 THEN 'other' ELSE 'attention' END AS bucket, sum(p_size * 64)::BIGINT AS parameters FROM part GROUP BY 1")
def param_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the tensors of a model, a layer for every eight."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, PARAMETERS)), (k % 8 + 1).cast("int"))
    return metrics.parameter_rollup(table(spark, sf_dir, "part").select(F.replace(kind, F.lit("{}"), F.floor(k / 8).cast("string")).alias("name"), (F.col("p_size") * 64).cast("long").alias("n")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey * 10 <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype FROM orders")
def token_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tokenize.dtype_for_vocab(F.col("o_orderkey") * 10).alias("dtype"))


@query("SELECT p_partkey AS id, (ceil(floor(p_size * 64 * 2.5) / 256) * 256)::BIGINT AS width FROM part")
def ffn_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), metrics.ffn_width(F.col("p_size") * 64, 256, 2.5).alias("width"))


@query("SELECT event_type AS run, event_id AS step, round(8192 / greatest(1e-9, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY event_id)), 0) AS log_window_tokens_per_second FROM events")
def log_window_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "ts")
    return metrics.log_window_rate(rows, 1024, 8).select("run", "step", F.round("log_window_tokens_per_second", 0).alias("log_window_tokens_per_second"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN NULL ELSE (p_partkey * 10)::BIGINT END AS whole, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_partkey + 0.5::DOUBLE ELSE (p_partkey * 10)::DOUBLE END AS number FROM part")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, F.lit("n/a")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise((k * 10).cast("string")).alias("v"))
    return rows.select("id", select.as_int(rows, "v").alias("whole"), select.as_float(rows, "v").alias("number"))


@query("SELECT source, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY source")
def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return mix.shares(counted, "rows", "share").withColumn("share", F.round("share", 9))


@query("SELECT doc_id, seq, before FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents)")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", {"seq": F.lit(1), "before": F.col("n_chars")}).drop("n_chars")


@query(f"""WITH {NORMAL_SQL}, n AS (SELECT conv_id, i, role, body, octet_length(encode(body)) AS b FROM t), g AS (SELECT conv_id, sum(b)::BIGINT + 1 AS n FROM n GROUP BY conv_id),
    total AS (SELECT sum(n)::BIGINT AS n FROM g) SELECT unnest(generate_series(0::BIGINT, (SELECT n FROM total) - 256, 256)) AS start, 256::BIGINT AS ids""")
def sft_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = sft.from_turns(table(spark, sf_dir, "conversations"))
    turns = sft.turns(convs.select("conv_id", sft.messages(["messages"], "chat").alias("messages"))).where(F.size("messages") > 0)
    ids = turns.select("conv_id", "learnt", F.transform("texts", tokenize.byte_ids).alias("ids"))
    tokens, labels = sft.masked(F.col("ids"), F.col("learnt"), 256, 257)
    inputs, targets = sft.shifted(F.col("tokens"), F.col("labels"))
    pairs = ids.select(F.col("conv_id").alias("seq"), tokens.alias("tokens"), labels.alias("labels")).select("seq", inputs.alias("tokens"), targets.alias("labels")).withColumn("n", F.size("tokens").cast("long"))
    placed = pack.placed(pairs.select("seq", "n"), "seq", "n").join(pairs.drop("n"), "seq")
    stream = pack.shards(placed, "tokens", "n", 1 << 14, overlap=255, labels="labels")
    cut = windows.paired_windows(stream, 256, 1 << 14)
    return cut.select("start", F.greatest(F.size("input"), F.size("target")).cast("long").alias("ids"))


@query(f"""WITH {WORD_STREAM_SQL}, s AS (SELECT pos // 4096 AS shard, count(*) AS n FROM stream GROUP BY 1)
    SELECT shard, count(*) AS windows, max(start)::BIGINT AS last_start FROM s, unnest(generate_series(0, n - 257, 256)) AS t(start) GROUP BY shard""")
def shard_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = placed_words(spark, sf_dir)
    cut = windows.shard_windows(pack.shards(docs, "ids", "n", 4096), 256)
    return cut.groupBy("shard").agg(F.count(F.lit(1)).alias("windows"), F.max("start").cast("long").alias("last_start"))


@query("SELECT event_type AS run, round(avg(value), 6) AS tokens_per_second, round(avg(value / 0.23::DOUBLE), 6) AS chars_per_second FROM events WHERE value IS NOT NULL GROUP BY event_type")
def mean_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy(F.col("event_type").alias("run"))
    return rows.agg(F.round(F.avg("value"), 6).alias("tokens_per_second"), F.round(F.avg(F.col("value") / 0.23), 6).alias("chars_per_second"))


@query(f"""WITH b AS (SELECT doc_id, octet_length(encode({strip_sql('text')})) + 1 AS n, {held_sql(strip_sql('text'))} AS held, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents WHERE {strip_sql('text')} <> ''), d AS (SELECT * FROM b), {ROUTED_SQL}
    SELECT split, count(*) AS documents, sum(least(n, target - start))::BIGINT AS tokens FROM o WHERE start < target GROUP BY split""")
def pretrain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    routed = pretrain.tokenize_corpus(docs, "doc_id", tokenize.ByteTokenizer, staging.folder(spark), TRAIN, VALIDATION, RATIO, SALT, eos=256)
    return pretrain.stats(routed)


@query(f"""WITH {slots_sql(3, 1000)}, f AS (SELECT doc_id, doc_id % 3 AS place, octet_length(encode({strip_sql('text')})) + 1 AS n FROM documents WHERE {strip_sql('text')} <> ''),
    m AS (SELECT chr((97 + place)::INTEGER) AS source, 17 * (place + 1) AS place, row_number() OVER (PARTITION BY place ORDER BY doc_id) - 1 AS seq, n FROM f), {epochs_sql('m', 3, 10000)},
    j AS (SELECT slot, source, n, coalesce(sum(n) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sl JOIN ek USING (source, k)),
    x AS (SELECT *, unnest(generate_series(start // 65536, (start + n - 1) // 65536)) AS package FROM j WHERE start < 200000)
    SELECT package, source, count(*) AS samples, sum(least(n, (package + 1) * 65536 - start) - greatest(0, package * 65536 - start))::BIGINT AS tokens FROM x GROUP BY package, source""")
def mixture_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipping.ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    frames = {s.name: docs.where(F.pmod("doc_id", F.lit(3)) == i) for i, s in enumerate(MIX)}
    texts = [Source(s.name, s.dataset_id, target_tokens=s.target_tokens, format="text") for s in MIX]
    return pretrain.packages(pretrain.mixture(texts, frames, "doc_id", tokenize.ByteTokenizer, 200_000, 3, 10, 256), 65_536)


def drawn_sql(seed: int, stream: str, *counters: str) -> str:
    return f"('0x' || substr(sha1('{seed}:{stream}:' || {" || ':' || ".join(counters)}), 1, 15))::BIGINT"


@query(f"""WITH {WORD_STREAM_SQL}, n AS (SELECT count(*) - 64 AS n FROM stream), s AS (SELECT list(tok ORDER BY pos) AS ids FROM stream),
    d AS (SELECT b.range AS batch, r.range AS rank, i.range AS i FROM range(1000) b, range(4) r, range(4) i),
    placed AS (SELECT *, ({drawn_sql(5, "start", "batch", "rank", "i")} % ((n - rank + 3) // 4) * 4 + rank)::BIGINT AS start FROM d, n)
    SELECT batch, rank, i, start, list_sum(list_transform(range(64), lambda k: ids[start + k + 1] * (k % 97 + 1)))::BIGINT AS input_sum,
           list_sum(list_transform(range(64), lambda k: ids[start + k + 2] * (k % 97 + 1)))::BIGINT AS target_sum FROM placed, s""")
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four windows for each of four ranks in each of 1,000 batches."""
    docs = placed_words(spark, sf_dir)
    total = docs.agg(F.sum("n")).first()[0] or 0
    cut = windows.random_windows(pack.shards(docs, "ids", "n", 1 << 14, overlap=64), windows.random_starts(spark, total, 64, 4, 1000, seed=5, world=4), 64, 1 << 14)
    return cut.select("batch", "rank", "i", "start", digest("input").alias("input_sum"), digest("target").alias("target_sum"))


@query()
def weighted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of single shards, drawn by length; how often each shard is drawn is held against its weight by a test."""
    shards = staging.keep(pack.shards(placed_words(spark, sf_dir), "ids", "n", 1 << 14))
    # a row for each shard, as an index of them has
    lengths = [r["n"] for r in shards.select("shard", F.size("tokens").alias("n")).orderBy("shard").collect()]
    cut = windows.weighted_windows(shards, windows.weighted_starts(spark, lengths, 64, 8, 1000, seed=6), 64)
    return cut.select("batch", "i", "shard", "start", digest("input").alias("input_sum"), digest("target").alias("target_sum"))


@query(f"""WITH {WORD_STREAM_SQL} SELECT 'part-' || lpad((pos // 50000)::VARCHAR, 6, '0') || '.bin' AS file, count(*) AS ids, sum(tok * (pos % 101 + 1))::BIGINT AS checksum FROM stream GROUP BY 1""")
def tokenbin_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_words(spark, sf_dir, 50_000, "uint16")
    back = tokenbin.read(spark, path, "uint16", block=4096)
    first = F.col("start") + 50_000 * F.substring("file", 6, 6).cast("long")
    return back.groupBy("file").agg(F.sum(F.size("ids")).alias("ids"), F.sum(digest("ids", first, 101)).alias("checksum"))


def stored_words(spark: SparkSession, sf_dir: str, part: int, dtype: str, ids: Callable[[str], Column] = F.col) -> str:
    """A folder with the stream of all documents' words in files of so many ids; `ids` makes what is stored of a piece."""
    path = staging.folder(spark)
    pieces = pack.pieces(placed_words(spark, sf_dir), ["ids"], "n", part)
    tokenbin.write(pieces.select(F.col("shard").alias("part"), "start", ids("ids").alias("ids")), path, dtype)
    return path


@query(f"""WITH {WORD_STREAM_SQL}, n AS (SELECT count(*) AS n FROM stream),
    w AS (SELECT s.start, pos - s.start AS k, tok FROM (SELECT unnest(generate_series(0::BIGINT, (SELECT n FROM n) - 513, 512)) AS start) s JOIN stream ON pos BETWEEN s.start AND s.start + 512)
    SELECT start, sum(CASE WHEN k < 512 THEN tok * (k % 97 + 1) END)::BIGINT AS input_sum, sum(CASE WHEN k > 0 THEN tok * ((k - 1) % 97 + 1) END)::BIGINT AS target_sum FROM w GROUP BY start""")
def file_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation windows of stored files: a task reads a block and the ids after it, across files, and nothing is shuffled."""
    path = stored_words(spark, sf_dir, 64 * 512, "uint16")
    blocks = tokenbin.read(spark, path, "uint16", block=16 * 512, overlap=512)
    begin = F.col("start") + 64 * 512 * F.substring("file", 6, 6).cast("long")
    cut = pack.windows(blocks.select(begin.alias("begin"), F.col("ids").alias("tokens")), 512, 16 * 512)
    return cut.select("start", digest("input").alias("input_sum"), digest("target").alias("target_sum"))


@query(f"""WITH {WORD_STREAM_SQL} SELECT 'part-000000.bin' AS file, pos // 4096 * 4096 AS start, count(*) AS ids, sum(tok * (pos % 97 + 1))::BIGINT AS checksum
    FROM stream WHERE pos < 50000 AND pos // 4096 * 4096 BETWEEN 8192 AND 20000 GROUP BY 2""")
def file_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some blocks of one file; the reader opens that file alone and reads their bytes alone."""
    path = stored_words(spark, sf_dir, 50_000, "uint16")
    some = tokenbin.read(spark, path, "uint16", block=4096).where("file = 'part-000000.bin' AND start >= 8192 AND start <= 20000")
    return some.select("file", "start", F.size("ids").cast("long").alias("ids"), digest("ids", F.col("start")).alias("checksum"))


@query(f"WITH d AS (SELECT doc_id AS seq, source, {words_sql('text')} + 1 AS n FROM documents), {STARTS_SQL}, {SPANS_SQL.replace('{S}', '32768')} SELECT shard AS package, count(*) AS documents, sum(high - low)::BIGINT AS tokens FROM y GROUP BY shard")
def streaming_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    # a stream reads folders; a table of one file is picked out of its folder by name
    docs = reader.parquet(path) if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    rows = docs.select(F.col("doc_id").alias("seq"), "source", (tokenize.word_count("text") + 1).alias("n"))
    out = staging.folder(spark)
    packages.stream_packages(rows, 32_768, out, f"{out}-state.json", f"{out}-progress").awaitTermination()
    return spark.read.parquet(out).groupBy("package").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("high") - F.col("low")).alias("tokens")).withColumn("package", F.col("package").cast("long"))


@query(f"""WITH {WORD_STREAM_SQL} SELECT pos // 10000 AS block, count(*) AS ids, sum(tok)::BIGINT AS tokens, sum(CASE WHEN tok % 3 = 0 THEN -100 ELSE tok END)::BIGINT AS labels FROM stream GROUP BY 1""")
def paired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def labels(c: str) -> Column:
        return F.transform(c, lambda x: F.when(x % 3 == 0, sft.IGNORED).otherwise(x))

    tokens = stored_words(spark, sf_dir, 50_000, "uint16")
    both = tokenbin.read(spark, tokens, "uint16", labels=stored_words(spark, sf_dir, 50_000, "int32", labels), block=10_000)
    place = F.col("start") + 50_000 * F.substring("file", 6, 6).cast("long")
    total = [F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b) for c in ("ids", "labels")]
    return both.select((place / 10_000).cast("long").alias("block"), F.size("ids").cast("long").alias("ids"), total[0].alias("tokens"), total[1].alias("labels"))


@query(f"WITH {WORD_STREAM_SQL} SELECT 'train-' || lpad((pos // 4096)::VARCHAR, 6, '0') || '.npy' AS file, count(*) AS ids, sum(tok * (pos % 4096 % 101 + 1))::BIGINT AS checksum FROM stream GROUP BY 1")
def npy_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark)
    staging.keep(tokenbin.write_npy(pack.shards(placed_words(spark, sf_dir), "ids", "n", 4096), path))
    back = tokenbin.read_npy(spark, path)
    return back.select("file", F.size("ids").cast("long").alias("ids"), digest("ids", period=101).alias("checksum"))


@query(f"WITH {WORD_STREAM_SQL} SELECT 'part-' || lpad((pos // 30000)::VARCHAR, 6, '0') || '.bin' AS file, count(*) AS ids FROM stream GROUP BY 1")
def file_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_words(spark, sf_dir, 30_000, "uint32")
    return tokenbin.counts(spark, path, "uint32").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "ids")


@query(f"""WITH {LOG_SQL} SELECT 'validation' AS kind, count(*) AS rows, sum(step * step)::BIGINT AS places FROM g WHERE validation_loss IS NOT NULL
    UNION ALL SELECT 'throughput', count(*), sum(step * step)::BIGINT FROM g WHERE step % 7 = 0 UNION ALL SELECT 'last', 1, max(step * step)::BIGINT FROM g WHERE validation_loss IS NOT NULL""")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark)
    rows = log(spark, sf_dir).drop("row").withColumn("tokens_per_second", F.when(F.col("step") % 7 == 0, F.col("step") * 2.5))
    # one run's log is one file
    logs.append_rows(rows.coalesce(1).sortWithinPartitions("step"), path)
    read = logs.read_metrics(spark, path)
    kinds = {"validation": logs.validation_rows(read), "throughput": logs.throughput_rows(read), "last": logs.last_row(logs.validation_rows(read))}
    wide = [F.col(c).cast("decimal(19,0)") for c in ("row", "step")]
    parts = [d.agg(F.count(F.lit(1)).alias("rows"), F.sum(wide[0] * wide[1]).cast("decimal(38,0)").alias("places")).select(F.lit(k).alias("kind"), "rows", "places") for k, d in kinds.items()]
    found = staging.keep(parts[0].union(parts[1]).union(parts[2]))
    # three rows; bigint as in SQL unless a sum is beyond it, as from some 5 million steps on
    fits = found.where(F.abs("places") > F.lit((1 << 63) - 1)).isEmpty()
    return found.withColumn("places", F.col("places").cast("long")) if fits else found


@query("""WITH c AS (SELECT o_orderkey AS id, (1 + o_orderkey % 4) * (1 + o_orderkey % 3) * 256 * (1 + o_custkey % 5) * greatest(1, o_custkey % 3) AS per, 256 * (1 + o_custkey % 5) AS context, CASE WHEN o_orderkey % 4 > 0 THEN 1 + o_orderkey % 100 END AS max_steps,
    CASE WHEN o_orderkey % 4 <> 1 THEN 100 * floor(o_totalprice)::BIGINT END AS max_tokens, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey * 7 END AS package FROM orders)
    SELECT id, greatest(1, least(max_steps, (max_tokens + per - 1) // per))::BIGINT AS steps, greatest(CASE WHEN package > 0 THEN package ELSE 32 * per END, per, context + 1)::BIGINT AS package FROM c""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of all kinds: how many steps each takes and how large its packages are."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = table(spark, sf_dir, "orders").select(
        k.alias("id"), (1 + k % 4).alias("micro"), (1 + k % 3).alias("accumulation"), (256 * (1 + c % 5)).alias("context"), (c % 3).alias("world"), F.when(k % 4 > 0, 1 + k % 100).alias("max_steps"),
        F.when(k % 4 != 1, 100 * F.floor("o_totalprice")).alias("max_tokens"), F.when(k % 6 > 0, k * 7).alias("package_tokens"),
    )
    return metrics.run_lengths(runs).select("id", "steps", "package")


@query("SELECT o_orderkey AS id, o_orderkey % 300 < 200 AND o_custkey % 1000 < 700 AS both, o_orderkey % 300 < 200 AS by_steps, true AS free FROM orders")
def training_goes_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, tokens = F.col("o_orderkey") % 300, F.col("o_custkey") % 1000
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), *[metrics.should_continue(step, tokens, s, t).alias(n) for n, s, t in (("both", 200, 700), ("by_steps", 200, None), ("free", None, None))])


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'train_loss' WHEN 1 THEN 'perplexity' ELSE event_type END AS name, event_id % 3 < 2 AS known, count(*) AS rows FROM events GROUP BY 1, 2")
def known_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which series of a log there is a name for; the others are told apart, not dropped."""
    k = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select(F.when(k == 0, "train_loss").when(k == 1, "perplexity").otherwise(F.col("event_type")).alias("name"))
    return metrics.marked(rows, "name", metrics.SERIES).groupBy("name", "known").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH w AS (SELECT item_id AS id, list_transform(regexp_extract_all(text, '[^{SPACE_RE2}]+'), lambda w: length(w)) AS labels FROM benchmark WHERE text IS NOT NULL)
    SELECT id, list_position(labels, id % 12) - 1 AS label, len(labels)::BIGINT AS endings FROM w WHERE coalesce(list_position(labels, id % 12), 0) > 0""")
def arc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of an item are its choices, called by their lengths, so that calls repeat and the first hit counts."""
    words = text.words("text")
    choices = F.struct(F.transform(words, lambda w: F.length(w).cast("string")).alias("label"), words.alias("text"))
    items = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), F.col("text").alias("question"), choices.alias("choices"), (F.col("item_id") % 12).cast("string").alias("answerKey"))
    return evaluate.arc(items).select("id", "label", F.size("endings").cast("long").alias("endings"))


@query(f"""WITH {WORD_STREAM_SQL}, k AS (SELECT doc_id, list_slice(ids, greatest(1, len(ids) - 61), len(ids)) AS kept FROM t)
    SELECT doc_id AS id, (len(kept) + 2)::BIGINT AS ids, len(kept)::BIGINT AS first, (list_sum(kept) + doc_id % 7 + 3)::BIGINT AS total FROM k""")
def aligned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_tokens(spark, sf_dir)
    ids, first = evaluate.aligned_log_likelihood(F.col("ids"), F.array((F.col("seq") % 7).cast("int"), F.lit(3)), 64)
    return rows.select(F.col("seq").alias("id"), F.size(ids).cast("long").alias("ids"), first.cast("long").alias("first"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("""WITH s AS (SELECT s_suppkey % 11 AS worker_index, arg_max(s_suppkey * 10, s_suppkey) AS train_tokens, arg_max(s_nationkey, s_suppkey) AS validation_tokens FROM supplier WHERE s_suppkey % 11 <> 3 GROUP BY 1)
    SELECT range AS worker_index, coalesce(train_tokens, 0)::BIGINT AS train_tokens, coalesce(validation_tokens, 0)::BIGINT AS validation_tokens FROM range(16) LEFT JOIN s ON worker_index = range""")
def resumed_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    shards = table(spark, sf_dir, "supplier").select(F.when(k % 11 != 3, k % 11).cast("long").alias("worker_index"), k.alias("place"), (k * 10).cast("long").alias("train_tokens"), F.col("s_nationkey").cast("long").alias("validation_tokens"))
    return budget.resumed(spark.range(16).select(F.col("id").alias("worker_index")), shards, ["train_tokens", "validation_tokens"])


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders QUALIFY place <= 5")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.newest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 5)


@query("""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
    SELECT 'all' AS kind, count(text) AS texts, sum(length(text))::BIGINT AS chars FROM d UNION ALL SELECT 'first', count(text), sum(length(text))::BIGINT FROM d WHERE r <= 100""")
def corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = {"all": corpus.texts(docs), "first": corpus.texts(docs, "text", "doc_id", 100)}
    parts = [d.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars")).select(F.lit(k).alias("kind"), "texts", "chars") for k, d in kinds.items()]
    return parts[0].union(parts[1])


@query("""WITH d AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS w, row_number() OVER (ORDER BY source) - 1 AS i FROM documents WHERE source IS NOT NULL GROUP BY source)
    SELECT CASE WHEN i % 3 = 1 THEN 'source_' || lpad(i::VARCHAR, 2, '0') ELSE source END AS name, CASE WHEN i % 3 = 0 THEN 'openai/gsm8k' ELSE 'x/' || source END AS dataset_id, w AS tokens, CASE WHEN i % 3 = 1 THEN 'text' ELSE 'chat' END AS format,
           CASE WHEN i % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END AS low, CASE WHEN i % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END AS high, CASE WHEN i % 3 = 0 THEN 'openai/gsm8k:main:train[:9]' WHEN i % 3 = 1 THEN 'x/' || source || '::test' ELSE 'shared' END AS range_key FROM d
    UNION ALL SELECT source, 'x/' || source, round(1000000.0::DOUBLE * n / (SELECT sum(n) FROM d))::BIGINT + CASE WHEN i = 0 THEN 1000000 - (SELECT sum(round(1000000.0::DOUBLE * n / (SELECT sum(n) FROM d))::BIGINT) FROM d) ELSE 0 END, 'chat', 0, 1, 'x/' || source || '::train' FROM d""")
def parsed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of the documents' sources, in all spellings, and one made of their ratios, whose rounding goes to the first."""
    # a row for each source, as in a configuration
    found = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("w")).orderBy("source").collect()
    kinds = (
        lambda r: {"name": r["source"], "id": "gsm8k", "subset": "main", "target_tokens": r["w"], "sample_range": [0.25, 0.5]},
        lambda r: {"dataset": f"x/{r['source']}", "weight": str(r["w"]), "sample_format": "text", "split": "test"},
        lambda r: {"name": r["source"], "dataset_id": f"x/{r['source']}", "weight": r["w"], "sample_range_key": "shared"},
    )
    rows = [kinds[i % 3](r) for i, r in enumerate(found)] + [{"name": "none", "id": "x/z", "target_tokens": 0}]
    mixed = config.ratio_sources(1_000_000, {r["source"]: r["n"] for r in found} | {"none": 0}, {r["source"]: {"id": f"x/{r['source']}"} for r in found})
    ratios = config.parse_sources({}, mixed)
    config.check_budget(ratios, 1_000_000, 0)
    every = config.parse_sources({"split": "train[:9]", "sources": rows}) + ratios
    return spark.createDataFrame([(s.name, s.dataset_id, s.target_tokens, s.format, *s.sample_range, s.range_key) for s in every], "name string, dataset_id string, tokens long, format string, low double, high double, range_key string")


# Fixed values of BLAKE2b: its initial words, and the order of a block's words in each of ten rounds.
BLAKE_WORDS = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
BLAKE_ORDER = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15), (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3), (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4), (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13), (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9), (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11), (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5), (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)


def blake_sql(keys: str) -> str:
    """Recursive CTEs from keys (id, key) to bucket (id, bucket): BLAKE2b of eight bytes in SQL, a block of 128 bytes a step.

    Independent of any library: the words of a block are read from the text's hexadecimal form, and each half round is a
    select over the one before.
    """
    full = 18446744073709551615

    def turn(x: str, by: int) -> str:
        return f"(({x} >> {by}) | (({x} << {64 - by}) & {full}))"

    def select(changed: dict[str, str], source: str) -> str:
        return f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in changed.items())}) FROM ({source})"

    word = [" || ".join(f"substr(hx, 256 * b + {16 * j + 2 * i + 1}, 2)" for i in range(7, -1, -1)) for j in range(16)]
    read = ", ".join(f"('0x' || {w})::UBIGINT::HUGEINT AS m{j}" for j, w in enumerate(word))
    first = ", ".join([*(f"h{i} AS v{i}" for i in range(8)), *(f"{x}::HUGEINT AS v{i + 8}" for i, x in enumerate(BLAKE_WORDS))])
    rows = f"SELECT *, {first}, {read} FROM st WHERE b < blocks"
    rows = select({"v12": "xor(v12, least(size, 128 * (b + 1))::HUGEINT)", "v14": f"CASE WHEN b + 1 = blocks THEN xor(v14, {full}::HUGEINT) ELSE v14 END"}, rows)
    for r in range(12):
        m = BLAKE_ORDER[r % 10]
        for half in (0, 1):
            quads = [(i, 4 + (i + half) % 4, 8 + (i + 2 * half) % 4, 12 + (i + 3 * half) % 4) for i in range(4)]
            for part, (d_by, b_by) in enumerate(((32, 24), (16, 63))):
                added = {f"v{a}": f"((v{a} + v{b} + m{m[8 * half + 2 * i + part]}) & {full})" for i, (a, b, c, d) in enumerate(quads)}
                rows = select(added, rows)
                rows = select({f"v{d}": turn(f"xor(v{d}, v{a})", d_by) for a, b, c, d in quads}, rows)
                rows = select({f"v{c}": f"((v{c} + v{d}) & {full})" for a, b, c, d in quads}, rows)
                rows = select({f"v{b}": turn(f"xor(v{b}, v{c})", b_by) for a, b, c, d in quads}, rows)
    state = ", ".join(f"xor(h{i}, xor(v{i}, v{i + 8})) AS h{i}" for i in range(8))
    begin = ", ".join(f"{x if i else x ^ 0x01010008}::HUGEINT AS h{i}" for i, x in enumerate(BLAKE_WORDS))
    turned = " + ".join(f"((h0 >> {8 * i}) & 255)::DOUBLE * {2.0 ** (56 - 8 * i - 64)!r}::DOUBLE" for i in range(7, -1, -1))
    return f"""sized AS (SELECT id, key, octet_length(encode(key)) AS size FROM {keys}), hexed AS (SELECT id, rpad(hex(encode(key)), (256 * greatest(1, (size + 127) // 128))::INTEGER, '0') AS hx, size FROM sized),
    st(id, hx, size, blocks, b, h0, h1, h2, h3, h4, h5, h6, h7) AS (SELECT id, hx, size, greatest(1, (size + 127) // 128), 0::BIGINT, {begin} FROM hexed UNION ALL SELECT id, hx, size, blocks, b + 1, {state} FROM ({rows})),
    bucket AS (SELECT id, {turned} AS bucket FROM st WHERE b = blocks)"""


BUCKETS_SQL = f"""k AS (SELECT {{'doc': doc_id, 'kind': 'range'}} AS id, 'source-range:shared' || chr(10) || text AS key FROM documents UNION ALL SELECT {{'doc': doc_id, 'kind': 'part'}}, 'validation' || chr(10) || text FROM documents), {blake_sql('k')},
    r AS (SELECT id.doc AS doc_id, bucket FROM bucket WHERE id.kind = 'range'), v AS (SELECT id.doc AS doc_id, bucket FROM bucket WHERE id.kind = 'part')"""


@query(f"WITH RECURSIVE {BUCKETS_SQL} SELECT doc_id, round(r.bucket, 12) AS bucket, CASE WHEN r.bucket < 0.25 THEN 'mid' WHEN r.bucket < 0.75 THEN 'sft' ELSE 'rest' END AS source, true AS in_all, v.bucket < 0.1 AS validation, v.bucket >= 0.1 AS train, true AS unsplit FROM r JOIN v USING (doc_id)")
def sample_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to three ranges of one key's hash space, which are disjoint, and to train and validation."""
    shipping.ship(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranges = {"mid": (0.0, 0.25), "sft": (0.25, 0.75), "rest": (0.75, 1.0)}
    # each range by its own test: a document in two of them, or in none, shows
    own = F.array_join(F.array_compact(F.array(*[F.when(hashing.in_range(["text"], low, high, "shared"), name) for name, (low, high) in ranges.items()])), "+")
    split = {p: hashing.in_partition(["text"], p, 0.1).alias(p) for p in ("validation", "train")}
    bucket = F.round(hashing.sample_bucket(["text"], "source-range:shared"), 12)
    return rows.select("doc_id", bucket.alias("bucket"), own.alias("source"), hashing.in_range(["text"], 0, 1, "shared").alias("in_all"), *split.values(), hashing.in_partition(["text"], "train", 0.0).alias("unsplit"))


@query(f"WITH RECURSIVE {BUCKETS_SQL} SELECT doc_id FROM r JOIN v USING (doc_id) WHERE r.bucket >= 0.25 AND r.bucket < 0.75 AND v.bucket >= 0.1")
def range_sample_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipping.ship(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.where(hashing.in_range(["text"], 0.25, 0.75, "shared")).where(hashing.in_partition(["text"], "train", 0.1)).select("doc_id")


def through(make: Callable[[int], object], ends: tuple[int, ...]) -> None:
    """Run a stream to each of the ends, a query for each that goes on where the one before was stopped."""
    for end in ends:
        query = make(end)
        query.processAllAvailable()
        query.stop()


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq, (SELECT count(*) FROM documents) AS n, length(text) AS chars FROM documents)
    SELECT doc_id, count(*) AS times, sum(e * n + seq)::BIGINT AS places, sum(chars)::BIGINT AS chars FROM s, range(3) AS t(e) WHERE e * n + seq < 5 * n // 2 GROUP BY doc_id""")
def cycled_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two and a half epochs of an unbounded stream, stopped once and resumed."""
    folder = staging.folder(spark)
    n = cycled.prepare(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", folder, 128)

    def make(end: int):
        return cycled.stream(spark, folder, rowsPerBatch=n // 2 + 1, rows=end).writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").start(f"{folder}/out")

    through(make, (n + n // 3, 5 * n // 2))
    read = spark.read.parquet(f"{folder}/out").groupBy("doc_id")
    return read.agg(F.count(F.lit(1)).alias("times"), F.sum(F.col("epoch") * n + F.col("place")).alias("places"), F.sum(F.length("text")).alias("chars"))


STREAM_TRAIN, STREAM_VALIDATION = 20_000, 1_500


@query(f"""WITH {lengths_sql()}, k AS (SELECT source, n, held, e * (SELECT count(*) FROM d) + seq AS seq FROM d, range(2) AS t(e)),
    c AS (SELECT *, sum(CASE WHEN held THEN n ELSE 0 END) OVER w AS cv, sum(CASE WHEN held THEN 0 ELSE n END) OVER w AS ct FROM k WINDOW w AS (PARTITION BY source ORDER BY seq)),
    a AS (SELECT source, coalesce(min(CASE WHEN cv >= {STREAM_VALIDATION} THEN seq END), 1::BIGINT << 61) AS v, coalesce(min(CASE WHEN ct >= {STREAM_TRAIN} THEN seq END), 1::BIGINT << 61) AS t FROM c GROUP BY source),
    r AS (SELECT source, seq, n, CASE WHEN seq <= least(v, t) THEN (CASE WHEN held THEN 'validation' ELSE 'train' END) WHEN v <= t THEN 'train' ELSE 'validation' END AS split FROM c JOIN a USING (source)),
    o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source, split ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE split WHEN 'train' THEN {STREAM_TRAIN} ELSE {STREAM_VALIDATION} END AS target FROM r)
    SELECT source, CASE WHEN start < target THEN split END AS split, count(*) AS documents, sum(greatest(0, least(n, target - start)))::BIGINT AS written, sum(n - greatest(0, least(n, target - start)))::BIGINT AS skipped FROM o GROUP BY 1, 2""")
def streamed_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of documents routed under budgets for each source, the counts kept as the stream's state over a restart."""
    folder = staging.folder(spark)
    n = cycled.prepare(measured(spark, sf_dir), "doc_id", folder, 128)

    def make(end: int):
        stream = budgets.routed(cycled.stream(spark, folder, rowsPerBatch=n // 2 + 1, rows=end), "source", ["epoch", "place"], STREAM_TRAIN, STREAM_VALIDATION)
        return stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").start(f"{folder}/out")

    through(make, (n + n // 3, 2 * n))
    return spark.read.parquet(f"{folder}/out").groupBy("source", "split").agg(F.count(F.lit(1)).alias("documents"), F.sum("written").alias("written"), F.sum("skipped").alias("skipped"))


@query(f"""WITH t AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(text, '[^{SPACE_RE2}]+'), lambda w: length(w)), 0) AS ids, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents),
    k AS (SELECT doc_id % 7 AS part, ids, e * (SELECT count(*) FROM t) + seq AS seq FROM t, range(2) AS r(e) WHERE e * (SELECT count(*) FROM t) + seq < 3 * (SELECT count(*) FROM t) // 2),
    u AS (SELECT part, seq, unnest(ids) AS tok, generate_subscripts(ids, 1) AS i FROM k),
    p AS (SELECT part, tok, row_number() OVER (PARTITION BY part ORDER BY seq, i) - 1 AS pos FROM u)
    SELECT part::BIGINT AS part, count(*) AS ids, sum(tok * (pos % 101 + 1))::BIGINT AS checksum FROM p GROUP BY part""")
def streamed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch and a half of tokens in files that each micro-batch adds to once; the last batch before the restart is run again."""
    folder = staging.folder(spark)
    n = cycled.prepare(word_tokens(spark, sf_dir).select("seq", "ids"), "seq", folder, 128)

    def make(end: int):
        stream = cycled.stream(spark, folder, rowsPerBatch=n // 2 + 1, rows=end)
        return tokenbin.write_stream(stream.select(F.pmod("seq", F.lit(7)).alias("part"), (F.col("epoch") * n + F.col("place")).alias("start"), "ids"), f"{folder}/bins", "uint16", f"{folder}/progress")

    through(make, (n + n // 3,))
    packages.forget_last(spark, f"{folder}/progress")
    through(make, (3 * n // 2,))
    # files of a part go by batch; a file's place in its part is the sum of those before
    blocks = staging.keep(tokenbin.read(spark, f"{folder}/bins", "uint16").withColumn("part", F.substring("file", 6, 6).cast("long")))
    sizes = blocks.select("file", "part", "start", F.size("ids").cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(sizes.withColumn("before", before).drop("n"), ["file", "part", "start"])
    return placed.groupBy("part").agg(F.sum(F.size("ids")).alias("ids"), F.sum(digest("ids", F.col("before"), 101)).alias("checksum"))


def turned_sql(x: str, n: str, seed: int) -> str:
    """permute.turned() in SQL."""
    a = f"ceil(sqrt({n}))::BIGINT"
    b = f"(({n} + {a} - 1) // {a})"
    left, right = f"({x} % {a})", f"({x} // {a})"
    for k in range(permute.ROUNDS):
        drawn = f"('0x' || substr(sha1('{seed}:{k}:' || {left if k % 2 else right}), 1, 15))::BIGINT"
        left, right = (left, f"(({right} + {drawn}) % {b})") if k % 2 else (f"(({left} + {drawn}) % {a})", right)
    return f"({left} + {a} * {right})"


@query(f"""WITH RECURSIVE n AS (SELECT count(*)::BIGINT AS n FROM documents), s AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS seq FROM documents),
    walk(doc_id, n, place) AS (SELECT doc_id, n, {turned_sql('seq', 'n', 11)} FROM s, n UNION ALL SELECT doc_id, n, {turned_sql('place', 'n', 11)} FROM walk WHERE place >= n)
    SELECT doc_id, place FROM walk WHERE place < n""")
def permuted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole shuffle of documents without a sort: each one's place is computed from its number."""
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return select.permuted(rows, "seq", 11).select("doc_id", "place")


@query(f"""WITH RECURSIVE {slots_sql(7, 100)}, m AS (SELECT chr((97 + doc_id % 3)::INTEGER) AS source, doc_id, (row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1)::BIGINT AS seq FROM documents),
    h AS (SELECT source, count(*)::BIGINT AS n FROM m GROUP BY source), k AS (SELECT slot, source, n, (k // n)::BIGINT AS epoch, (k % n)::BIGINT AS x FROM sl JOIN h USING (source)),
    walk(slot, source, n, epoch, place) AS (SELECT slot, source, n, epoch, {turned_sql('x', 'n', 0).replace("'0:", "(11 + epoch) || ':")} FROM k UNION ALL SELECT slot, source, n, epoch, {turned_sql('place', 'n', 0).replace("'0:", "(11 + epoch) || ':")} FROM walk WHERE place >= n)
    SELECT slot, source, epoch, doc_id FROM walk JOIN m USING (source) WHERE place < n AND place = seq""")
def mixture_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a mixture with the samples that keyed permutations give each epoch: nothing is repeated or sorted for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = {s.name: staging.keep(numbered(docs.where(F.pmod("doc_id", F.lit(3)) == i), "doc_id")) for i, s in enumerate(MIX)}
    return mix.permuted(mix.slots(spark, MIX, 1000, seed=7, window=10), parts, 11).select("slot", "source", "epoch", "doc_id")


@query(f"""WITH {slots_sql(3, 1000)}, f AS (SELECT doc_id, doc_id % 3 AS place, octet_length(encode({strip_sql('text')})) + 1 AS n FROM documents WHERE {strip_sql('text')} <> ''),
    m AS (SELECT chr((97 + place)::INTEGER) AS source, 17 * (place + 1) AS place, row_number() OVER (PARTITION BY place ORDER BY doc_id) - 1 AS seq, n FROM f), {epochs_sql('m', 3, 10000)},
    j AS (SELECT slot, source, n, coalesce(sum(n) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sl JOIN ek USING (source, k)),
    x AS (SELECT *, unnest(generate_series(start // 4096, (start + n - 1) // 4096)) AS package FROM j WHERE start < 200000)
    SELECT package, count(*) AS samples, sum(least(n, (package + 1) * 4096 - start) - greatest(0, package * 4096 - start))::BIGINT AS ids, false AS rewritten, bool_or(source = 'c') AS renewed FROM x GROUP BY package""")
def stored_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of a mixture, stored; a second run writes none of them, one with another source writes those that hold it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = [Source(s.name, f"documents-{i}", target_tokens=s.target_tokens, format="text") for i, s in enumerate(MIX)]
    frames = pretrain.opened(texts, lambda dataset, _config, _split: docs.where(F.pmod("doc_id", F.lit(3)) == int(dataset[-1])))
    mixed = staging.keep(pretrain.mixture(texts, frames, "doc_id", tokenize.ByteTokenizer, 200_000, 3, 10, 256))
    folder = staging.folder(spark)
    kept.store(mixed, texts, 4096, folder)
    again = kept.store(mixed, texts, 4096, folder)
    other = kept.store(mixed, [replace(s, split="test") if s.name == "c" else s for s in texts], 4096, folder)
    read = kept.stored(spark, folder)
    return read.select("package", "samples", F.size("ids").cast("long").alias("ids"), F.col("package").isin(again or [-1]).alias("rewritten"), F.col("package").isin(other or [-1]).alias("renewed"))


@query(f"""WITH s AS ({SCORED_SQL}), t AS (SELECT *, substr(sha1('9:' || seq), 1, 10) AS tie FROM s)
    SELECT doc_id, ((seq // 200) * 200 + row_number() OVER (PARTITION BY seq // 200 ORDER BY score DESC NULLS LAST, language_score DESC NULLS LAST, tie, seq) - 1)::BIGINT AS place FROM t""")
def quality_rank_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by quality where only ties are shuffled."""
    return select.buffered_rank(scored(spark, sf_dir), "seq", 200, seed=9).select("doc_id", "place")


@query("""WITH k AS (SELECT o_custkey AS run, CASE WHEN o_orderkey % 5 < 3 THEN 'step_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.pt' WHEN o_orderkey % 5 = 3 THEN 'latest.pt' ELSE 'final.pt' END AS name FROM orders)
    SELECT run, coalesce(max(CASE WHEN name = 'latest.pt' THEN name END), max(CASE WHEN name LIKE 'step%' THEN name END), max(CASE WHEN name = 'final.pt' THEN name END)) AS chosen FROM k GROUP BY run""")
def checkpoint_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoint that each run goes on from."""
    k = F.col("o_orderkey")
    name = F.when(k % 5 < 3, F.concat(F.lit("step_"), F.lpad(k.cast("string"), 8, "0"), F.lit(".pt"))).when(k % 5 == 3, "latest.pt").otherwise("final.pt")
    return select.picked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), name.alias("name")), "run", "name")


@query(f"""WITH t AS (SELECT doc_id, {split_sql('text')} AS w FROM documents)
    SELECT doc_id, least(len(w), 33)::BIGINT AS ids, array_to_string(list_slice(w, 1, 33), ' ') AS kept FROM t WHERE len(w) > 1""")
def right_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words that a model of 32 positions is shown and asked for, of texts with two at least."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.right_truncated(text.words("text"), 32).alias("w"))
    return select.long_enough(rows, "w", 2).select("doc_id", F.size("w").cast("long").alias("ids"), F.array_join("w", " ").alias("kept"))


@query(f"""WITH r AS (SELECT {VALIDATION}::DOUBLE / ({TRAIN} + {VALIDATION}) AS ratio), d AS (SELECT {words_sql('t')} + 1 AS n, {held_sql('t').replace(f'{RATIO}::DOUBLE', '(SELECT ratio FROM r)')} AS held FROM (SELECT {strip_sql('text')} AS t FROM documents) WHERE t <> '')
    SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, count(*) AS documents, sum(n)::BIGINT AS tokens FROM d GROUP BY 1""")
def derived_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by the ratio that follows from the token targets."""
    docs = select.non_blank(table(spark, sf_dir, "documents")).select(text.strip("text").alias("t"))
    held = hashing.is_validation(F.col("t"), hashing.validation_ratio(TRAIN, VALIDATION), SALT)
    rows = docs.select((tokenize.word_count("t") + 1).alias("n"), F.when(held, "validation").otherwise("train").alias("split"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


@query(f"""WITH d AS (SELECT doc_id, {words_sql('text')} AS n, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents WHERE {strip_sql('text')} <> '')
    SELECT doc_id, n + 1 AS tokens FROM d WHERE n >= 50 AND seq < (SELECT count(*) FROM d) // 2""")
def kept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of what isn't blank, less what is too short; the end is added after that is judged."""
    docs = staging.keep(select.non_blank(table(spark, sf_dir, "documents")).select("doc_id", tokenize.word_count("text").alias("n")))
    seen = select.first_rows(numbered(docs, "doc_id"), "seq", docs.count() // 2)
    return select.min_tokens(seen, 50).select("doc_id", (F.col("n") + 1).alias("tokens"))


@query()
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merges of a two-stage vocabulary of 50,000 ids over all documents; a test holds them against merges made one by one."""
    found = bpe.train(table(spark, sf_dir, "documents"), 50_000, special=("<pad>", "<bos>", "<eos>", "<unk>"))
    return spark.createDataFrame([(i, a.hex(), b.hex()) for i, (a, b) in enumerate(found)], "rank long, a string, b string")


@query(f"""WITH w AS (SELECT item_id AS id, {split_sql('text')} AS w FROM benchmark WHERE text IS NOT NULL), n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS seq, len(w) AS k FROM w),
    h AS (SELECT 'hellaswag' AS task, id, (id % 7)::INT AS label, CASE WHEN id % 5 = 0 THEN 0 ELSE k END AS endings FROM n WHERE seq < 30 AND id % 5 > 0 AND id % 7 <> 6),
    p AS (SELECT 'piqa' AS task, id, (id % 3)::INT AS label, 2 AS endings FROM n WHERE seq < 30 AND id % 3 < 2), g AS (SELECT 'gsm8k' AS task, id, 0 AS label, 0 AS endings FROM n WHERE seq < 15)
    SELECT task, count(*) AS items, sum(label)::BIGINT AS labels, sum(endings)::BIGINT AS endings FROM (SELECT * FROM h UNION ALL SELECT * FROM p UNION ALL SELECT * FROM g) GROUP BY task""")
def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items of three kinds are valid; a limit counts items before that is asked, and GSM8K has half of it."""
    w = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), text.words("text").alias("w"))
    rows, k = numbered(w.select("id"), "id").join(w, "id"), F.col("id")
    asked = {task: select.first_rows(rows, "seq", evaluate.item_limit(task, 30)) for task in ("hellaswag", "piqa", "gsm8k")}
    endings = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("w"))
    label = F.when(k % 7 == 6, "none").otherwise((k % 7).cast("string"))
    found = {
        "hellaswag": evaluate.hellaswag(asked["hellaswag"].select("id", F.lit("c").alias("ctx"), endings.alias("endings"), label.alias("label"))),
        "piqa": evaluate.piqa(asked["piqa"].select("id", F.lit("g").alias("goal"), F.col("w")[0].alias("sol1"), F.lit("s").alias("sol2"), (k % 3).alias("label"))),
        "gsm8k": asked["gsm8k"].select("id", F.lit("").alias("context"), F.array().cast("array<string>").alias("endings"), F.lit(0).alias("label")),
    }
    parts = [d.select(F.lit(t).alias("task"), "label", F.size("endings").alias("endings")) for t, d in found.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("task").agg(F.count(F.lit(1)).alias("items"), F.sum("label").cast("long").alias("labels"), F.sum("endings").cast("long").alias("endings"))


@query(f"""WITH {lengths_sql()}, w AS (SELECT seq % 4 AS worker, n, seq, coalesce(sum(n) OVER (PARTITION BY seq % 4 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
    s AS (SELECT worker, seq, least(n, greatest(0, {-(-TRAIN // 4)} - before)) AS own FROM w), o AS (SELECT *, coalesce(sum(own) OVER (ORDER BY worker, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s WHERE own > 0)
    SELECT worker, count(*) AS documents, sum(least(own, {TRAIN} - start))::BIGINT AS tokens, min(start)::BIGINT AS start FROM o WHERE start < {TRAIN} GROUP BY worker""")
def worker_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four workers with a quarter of the target each, their outputs one after the other."""
    parts = lengths(spark, sf_dir).withColumn("worker", F.col("seq") % 4)
    found = budget.by_workers(parts, "worker", "seq", "n", TRAIN, 4)
    return found.groupBy("worker").agg(F.count(F.lit(1)).alias("documents"), F.sum("written").alias("tokens"), F.min("start").alias("start"))


@query(f"""WITH l AS (SELECT doc_id, regexp_replace({strip_sql('text')}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g') AS line FROM documents),
    k AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM l WHERE line <> '')
    SELECT r // 64 AS chunk, count(*) AS lines, sum(octet_length(encode(line)))::BIGINT AS bytes FROM k GROUP BY 1""")
def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training corpus as text files of 64 lines, read back."""
    path = staging.folder(spark)
    corpus.write_lines(corpus.corpus_lines(table(spark, sf_dir, "documents"), "doc_id", 64), path)
    return spark.read.text(path).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::BIGINT) AS ids FROM documents)
    SELECT doc, (len(ids) + 1)::BIGINT AS ids, (list_sum(ids) + 1114111)::BIGINT AS total FROM t WHERE len(ids) > 0""")
def retokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored stream of bytes, cut at its ends, decoded, and encoded anew as code points."""
    coded = tokenize.encode(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", tokenize.ByteTokenizer)
    rows = staging.keep(coded.select(F.col("doc_id").alias("seq"), F.concat("ids", F.array(F.lit(256))).alias("ids")).withColumn("n", F.size("ids").cast("long")))
    placed = pack.placed(rows.select("seq", "n"), "seq", "n").join(rows.drop("n"), "seq")
    found = retokenize.retokenize(pack.shards(placed, "ids", "n", 1 << 16), 256, tokenize.ByteTokenizer, tokenize.CodePointTokenizer, target_eos=0x10FFFF)
    return found.select("doc", F.size("ids").cast("long").alias("ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))
