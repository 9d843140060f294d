"""Thin queries ``opN_<name>``: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, langid, linespread, neardup, order, pieces, quality, shards, tokencount, urlrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality(spark, docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"), 8)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(spark, docs, langid.learn(docs))


URL_RULES = [
    urlrules.UrlRule("allow", "com", "/"),
    urlrules.UrlRule("block", "example.com", "/en/"),
    urlrules.UrlRule("allow", "www.example.com", "/en/"),
    urlrules.UrlRule("block", "net", "/es/"),
    urlrules.UrlRule("block", "net", "/fr/"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(spark, _table(spark, sf_dir, "pages"), URL_RULES)


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return order.order_in_shared_folder(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, end_id=50256)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linespread.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    near = F.array_join("near_item_ids", ",").alias("near_item_ids")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", near)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_piece_sampling": op5_piece_sampling,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_training_order": op8_training_order,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
}

_OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT rid, item_id, dw.k, i FROM dw JOIN bw USING (k, phrase)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
      FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid),
p AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS (SELECT word, count(*) AS n FROM p GROUP BY word),
u AS (SELECT row_number() OVER () AS wid, item_id, k, string_split(phrase, ' ') AS x FROM bw),
o AS (SELECT wid, item_id, k, x, j, word, row_number() OVER (PARTITION BY wid ORDER BY coalesce(n, 0), j) AS rarity
      FROM (SELECT wid, item_id, k, x, unnest(x) AS word, unnest(range(0, k)) AS j FROM u) LEFT JOIN f USING (word)),
c AS (SELECT DISTINCT rid, item_id, k, x, i - j AS s FROM o JOIN p USING (word) WHERE rarity <= greatest(k - {decontam.NEAR_WORDS}, 0) + 1),
g AS (SELECT DISTINCT rid, item_id FROM c JOIN d USING (rid)
      WHERE len(list_filter(range(0, k), lambda j: list_contains(
        w[greatest(1, s + j - {decontam.NEAR_SLACK}) : greatest(0, s + j + {decontam.NEAR_SLACK})], x[j + 1]))) >= least(k, {decontam.NEAR_WORDS})),
v AS (SELECT rid, string_agg(item_id, ',' ORDER BY item_id) AS near FROM g GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(near, '') AS near_item_ids
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN v USING (rid)
"""

_OP9_SQL = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p,
         unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT * FROM l WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {linespread.MIN_WORDS}),
b AS (SELECT line, min((doc_id, p)) AS first FROM w GROUP BY line HAVING count(DISTINCT source) >= {linespread.MIN_SITES}),
r AS (SELECT doc_id, p FROM w JOIN b USING (line) WHERE (doc_id, p) <> first)
SELECT l.doc_id, count(*) AS n_lines, count(r.p) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE r.p IS NULL), '') AS text
FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.p = r.p GROUP BY l.doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

ORACLES: dict[str, str] = {"op9_line_dedup": _OP9_SQL, "op10_decontamination": _OP10_SQL}
