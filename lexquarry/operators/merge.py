"""Search results merged by page, and tables merged by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.urls import canonical_url, is_blocked, is_junk


def richness() -> Column:
    return F.coalesce(F.length("snippet"), F.lit(0)) + 2 * F.coalesce(F.length("title"), F.lit(0))


def search_merge(results: DataFrame) -> DataFrame:
    """One row per canonical URL without blocked and junk hosts: all providers and queries, and the
    richest copy (the earliest of equals); ``ord`` is the first arrival."""
    clean = results.where(~is_blocked(F.col("url")) & ~is_junk(F.col("url"))).withColumn("page", canonical_url(F.col("url")))
    best = F.min_by(F.struct("raw_id", "title", "snippet"), F.struct((-richness()).alias("r"), F.col("ord")))
    return (
        clean.groupBy("page")
        .agg(
            F.array_sort(F.collect_set("provider")).alias("discovered_by"),
            F.array_sort(F.collect_set("query_id")).alias("provenance"),
            best.alias("best"),
            F.min("ord").alias("ord"),
        )
        .select("page", "discovered_by", "provenance", "best.raw_id", "best.title", "best.snippet", "ord")
    )


def merge_counters(results: DataFrame) -> DataFrame:
    url = F.col("url")
    counted = results.agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if(is_blocked(url)).alias("n_blocked"), F.count_if(~is_blocked(url) & is_junk(url)).alias("n_junk")
    )
    merged = search_merge(results).agg(F.count(F.lit(1)).alias("n_survivors"), F.count_if(F.size("discovered_by") > 1).alias("n_multi_provider"))
    return counted.crossJoin(merged)  # one row each


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key (last write wins), with the place of the first."""
    order = [*order]
    last = F.max_by(F.struct(*df.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(last.alias("row"), F.min("ord").alias("first_ord")).select("row.*", "first_ord")


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``target`` and those rows of ``new`` whose key it lacks, the first of each."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return target.unionByName(first.join(target.select(*keys), list(keys), "left_anti").select(target.columns))


def upsert_columns(target: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """``target`` with the columns ``update`` of rows whose key stands in ``new`` replaced, and new keys added."""
    t, n = target.alias("t"), new.alias("n")
    joined = t.join(n, [F.col(f"t.{k}") == F.col(f"n.{k}") for k in keys], "full")
    known, fresh = F.col(f"t.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"n.{c}")).alias(c)
        if c in update:
            return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        return F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return joined.select(*[pick(c) for c in target.columns])
