"""One query for each corpus operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, minhash, packing, periodic, resample, secretscan, simhash, suffix, tokenfile, toxicity, urlfilter, vptree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"), simhash.RADIUS)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).drop("url")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(table(spark, sf_dir, "documents"), edit=periodic.planted))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.neighbours(table(spark, sf_dir, "embeddings"))


#: A row with the 256 remainders of a reversed CRC-32 (its polynomial is a fixed value), and the CRC of the bytes of a string.
CRC_SQL = "crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(i)))"


def crc_sql(text: str) -> str:
    byte = "(position(x[1] IN '0123456789ABCDEF') - 1) * 16 + position(x[2] IN '0123456789ABCDEF') - 1"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ({byte})::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_fingerprints, op3_url_rules, op4_token_files, op5_toxicity, op6_repeated_strings, op7_decontamination, op8_secrets, op9_packing, op10_chat, op11_periodic_runs, op12_resampling, op13_neighbours)
}

ORACLES: dict[str, str] = {
    "op1_near_duplicates": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 2), ' ')) AS s FROM d, unnest(generate_series(1, greatest(1, len(w) - 2))) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.root, e.b FROM reach r JOIN both_ways e ON e.a = r.node),
        comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = d.doc_id
    """,
    "op3_url_rules": r"""
        WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        rest AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS u FROM pages),
        parts AS (SELECT page_id, r, translate(regexp_extract(u, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        fits AS (SELECT p.r, x.host || x.path AS rule, x.verdict, row_number() OVER (PARTITION BY p.r ORDER BY length(x.host || x.path) DESC, length(x.host) DESC) AS k
                 FROM parts p JOIN rules x ON (p.host = x.host OR ends_with(p.host, '.' || x.host)) AND starts_with(p.path, x.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.r = p.r AND f.k = 1
    """,
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        windows AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM windows),
        runs AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
        found AS (SELECT r, i, x.n, item_id FROM runs x JOIN windows y ON x.win = y.win AND x.n = y.n),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM found), unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
    """,
    "op10_chat": r"""
        WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        placed AS (SELECT *, row_number() OVER w AS place, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns
                   FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        whole AS (SELECT n_turns, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM placed WHERE place = n_turns GROUP BY 1, 2),
        keep AS (SELECT * FROM whole h WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.place < p.n_turns AND p.place = h.n_turns AND p.prefix = h.prefix))
        SELECT k.conv_id, k.n_turns, k.n_copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
        FROM keep k JOIN placed p ON p.conv_id = k.conv_id GROUP BY 1, 2, 3
    """,
    "op11_periodic_runs": rf"""
        WITH {CRC_SQL},
        t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {crc_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
        m AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM t),
        d AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // parts) END + 1]) END AS w FROM m),
        g AS (SELECT r, i, len(w) AS n, hash(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS k FROM d, unnest(range(len(w) - 4)) AS t(i)),
        pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        stretches AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
        runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
        lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
        top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
        gone AS (SELECT DISTINCT r, unnest(generate_series(start + period, start + length - 1)) AS i FROM runs),
        kept AS (SELECT r, string_agg(x.word, ' ' ORDER BY x.i) AS body FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) x ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256, len(w)::BIGINT AS n_words
        FROM d LEFT JOIN lines USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
    """,
    "op12_resampling": rf"""
        WITH {CRC_SQL},
        w AS (SELECT row_number() OVER () AS r, doc_id, true AS own, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
              UNION ALL SELECT -1, NULL, false, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark),
        f AS (SELECT r, own, array_to_string(list_slice(w, i, i + k - 1), ' ') AS f FROM w, range(1, 4) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
        n AS (SELECT f, r, own, count(*) AS n FROM f GROUP BY ALL),
        b AS (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM n), crc),
        c AS (SELECT b, sum(CASE WHEN own THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN own THEN 0 ELSE n END)::DOUBLE AS t FROM n JOIN b USING (f) GROUP BY b),
        g AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c),
        d AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN b USING (f) JOIN g USING (b) WHERE own GROUP BY r),
        x AS (SELECT doc_id, len(w) AS k, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (r) WHERE own),
        o AS (SELECT *, row_number() OVER (PARTITION BY k >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY k >= 20) AS total FROM x)
        SELECT doc_id, n_features, weight, score, CASE WHEN k >= 20 AND place <= 5 * total // 100 THEN place END AS rank FROM o
    """,
}
