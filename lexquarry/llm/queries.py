"""The queries of the training-data operators, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexquarry.llm import abuse, canonical, cutoff, encode, leak, near, spans, survivor, variants
from lexquarry.session import prepare
from lexquarry.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "evidence").selectExpr("evidence_id AS id", "verbatim_quote AS text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.sharing_ids(_quotes(spark, folder)).withColumnRenamed("id", "evidence_id")


def p1_spans(spark: SparkSession, folder: str) -> DataFrame:
    amounts = spans.shared_amount(_quotes(spark, folder)).withColumnRenamed("id", "evidence_id")
    return amounts.select("evidence_id", "size", "shared_chars", "shared_rate")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variant_pairs(variants.names_of(read_table(spark, folder, "legal_citation")))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variant_groups(variants.names_of(read_table(spark, folder, "legal_citation")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutoff.cut_values(cutoff.values_of(read_table(spark, folder, "raw_result"), read_table(spark, folder, "evidence")))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    raw, evidence = read_table(spark, folder, "raw_result"), read_table(spark, folder, "evidence")
    return cutoff.cut_rates(raw, evidence, read_table(spark, folder, "research_source"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_pairs(near.texts_of(read_table(spark, folder, "raw_result"), read_table(spark, folder, "evidence")))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(near.texts_of(read_table(spark, folder, "raw_result"), read_table(spark, folder, "evidence")))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.typed_values(*(read_table(spark, folder, t) for t in ("evidence_candidate", "gap_item", "legal_citation")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_values(_typed(spark, folder), read_table(spark, folder, "canonical_value"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.mapping_report(_typed(spark, folder), read_table(spark, folder, "canonical_value"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return survivor.p6_found(read_table(spark, folder, "raw_result"), read_table(spark, folder, "provider_trust"))


def p6_truth(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return survivor.p6_truth(read_table(spark, folder, "raw_result"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_item"))


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return leak.cleaned(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_item"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.to_review(read_table(spark, folder, "documents"), read_table(spark, folder, "doc_label"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.source_rates(read_table(spark, folder, "documents"), read_table(spark, folder, "doc_label"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_spans": p1_spans,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_truth": p6_truth,
    "p7_ids": p7_ids,
    "p8_cleaned": p8_cleaned,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

ORACLES: dict[str, str] = {
    "p6_found": r"""
WITH a AS (
  SELECT ord, run_id, title, published_at, provider, fetched_at,
         regexp_replace(regexp_replace(trim(url_canonical), '#.*$', ''), '^(https?:)?//', '', 'i') AS bare
  FROM raw_result WHERE trim(url_canonical) <> '' AND run_id IS NOT NULL
), b AS (
  SELECT *, regexp_extract(bare, '^([^?/]*)', 1) AS host, regexp_extract(bare, '^[^?/]*([^?]*)', 1) AS path,
         regexp_extract(bare, '\?(.*)$', 1) AS query FROM a
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(host), ':\d*$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') || '?' ||
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains(
      ['utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','ref','source','mc_cid','mc_eid'],
      lower(split_part(p, '=', 1))))), '&') AS page
  FROM b
), t AS (SELECT provider, max(trust) AS trust FROM provider_trust WHERE provider IS NOT NULL GROUP BY provider
), d AS (
  SELECT c.*, t.trust, length(trim(title)) AS tl,
    count(*) OVER (PARTITION BY run_id, page) AS n,
    row_number() OVER (PARTITION BY run_id, page ORDER BY coalesce(length(trim(title)), 0) DESC, fetched_at DESC NULLS LAST, ord) AS rt,
    row_number() OVER (PARTITION BY run_id, page ORDER BY CASE WHEN published_at <= CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) THEN published_at END DESC NULLS LAST, ord) AS rp,
    row_number() OVER (PARTITION BY run_id, page ORDER BY t.trust DESC NULLS LAST, fetched_at DESC NULLS LAST, ord) AS rv
  FROM c LEFT JOIN t ON c.provider = t.provider
)
SELECT min(ord) AS first_ord,
  coalesce(max(CASE WHEN rt = 1 AND tl > 0 THEN ord END), -1) AS title_ord,
  coalesce(max(CASE WHEN rp = 1 AND published_at <= CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) THEN ord END), -1) AS published_ord,
  coalesce(max(CASE WHEN rv = 1 AND trust IS NOT NULL THEN ord END), -1) AS provider_ord
FROM d WHERE n >= 2 GROUP BY run_id, page
""",
}
