"""The queries opN_<name> on the driver's tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlattice.llm import bpe_reuse, centroid_clusters, exact_names, language_id, line_spread, media_chunks, packing, simhash, suffix_dedup, token_counts, toxicity, turn_repair, url_rules
from turnlattice.llm.common import crc_mod, documents


def op1_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(language_id.training(docs))
    return language_id.identified(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_spread.without_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir))


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_columns(documents(spark, sf_dir))


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("_row")


def op7_exact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_names.exact_duplicates(documents(spark, sf_dir)).drop("_row")


def op8_sentence_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.scored(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_offending", "worst_sentence")


def op9_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_reuse.encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rule_table(spark, url_rules.RULES))


def op11_array_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_elkan_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.repairs(rows, turn_repair.damaged(rows))


QUERIES = {f.__name__: f for f in (op1_centroids, op2_line_spread, op3_suffix_dedup, op4_media_chunks, op5_sum_of_squares, op6_simhash, op7_exact_names, op8_sentence_bags, op9_bpe_reuse, op10_url_rules, op11_array_merges, op12_elkan_bounds, op13_turn_repair)}

ORACLE_SQL = {
    "op12_elkan_bounds": centroid_clusters.ORACLE,
    "op13_turn_repair": turn_repair.ORACLE,
    "op2_line_spread": line_spread.ORACLE,
    "op7_exact_names": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op10_url_rules": """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
""",
}
