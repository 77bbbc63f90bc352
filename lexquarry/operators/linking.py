"""Joins between candidates, sources, documents and evidence, and rows that are set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_source(evidence: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """Evidence with ``columns`` of its source in its run; evidence of no known source is left out."""
    return evidence.join(sources.select("run_id", "source_id", *columns), ["run_id", "source_id"])


def source_documents(sources: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources with the document they are linked to (``links``: source_id, content_hash); others are left out."""
    return sources.join(links.select("source_id", "content_hash").distinct(), "source_id").join(documents, "content_hash")


def link_candidates(candidates: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with ``link``: ok, no_source or no_document (``documents`` has the source_ids with one)."""
    known = sources.select("source_id").distinct().withColumn("_source", F.lit(True))
    read = documents.select("source_id").distinct().withColumn("_document", F.lit(True))
    joined = candidates.join(known, "source_id", "left").join(read, "source_id", "left")
    link = F.when(F.col("_source").isNull(), "no_source").when(F.col("_document").isNull(), "no_document").otherwise("ok")
    return joined.withColumn("link", link).drop("_source", "_document")


def last_snippets(rows: DataFrame, raw: DataFrame, url: str = "url_canonical") -> DataFrame:
    """``rows`` (run_id and a URL) with the snippet of the last raw result of that URL in the run, null without one."""
    key = F.substring(F.sha1(F.col(url)), 1, 16)
    last = raw.select("run_id", key.alias("_key"), "snippet", "ord").groupBy("run_id", "_key").agg(F.max_by("snippet", "ord").alias("snippet"))
    return rows.withColumn("_key", key).join(last, ["run_id", "_key"], "left").drop("_key")


def with_status(rows: DataFrame, *status: str) -> DataFrame:
    return rows.where(F.col("status").isin(*status))


# The severities of gaps.
SEVERITIES = ["blocking", "important", "nice_to_have"]


def sanitise_gaps(gaps: DataFrame, kinds: DataFrame, most: int = 10) -> DataFrame:
    """Gaps reported by a model: those of an unknown kind (``kinds``: gap_kind) go, an unknown severity becomes
    important, and a run and round keeps the first ``most`` by gap_no."""
    known = gaps.where("detected_by = 'llm'").join(kinds.select("gap_kind").distinct(), "gap_kind", "left_semi")
    first = known.groupBy("run_id", "loop_index").agg(F.array_sort(F.collect_list("gap_no")).alias("all"))
    kept = first.select(F.explode(F.slice("all", 1, most)).alias("gap_no"))
    severity = F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("important")
    return known.withColumn("severity", severity).join(kept, "gap_no", "left_semi")


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with ``reason``, the first rule they break; a rule whose
    condition is null counts as broken. Nothing is raised."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


# The longest statement and quote of evidence.
MOST_STATEMENT = 500
MOST_QUOTE = 4000


def evidence_rules(most_statement: int = MOST_STATEMENT, most_quote: int = MOST_QUOTE) -> dict[str, Column]:
    return {
        "statement": F.length("statement") <= most_statement,
        "verbatim_quote": F.coalesce(F.length("verbatim_quote"), F.lit(0)) <= most_quote,
        "llm_confidence": F.coalesce(F.col("llm_confidence"), F.lit(0.5)).between(0, 1),
    }
