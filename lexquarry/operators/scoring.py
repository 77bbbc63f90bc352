"""Scores of sources, batches, and selection by quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recency(source_type: Column, published: Column, as_of: Column, half_life: int = 365) -> Column:
    """1 for types that do not age; 0.5 without a date; else halved every ``half_life`` days, 0.05 at least."""
    age = F.greatest(F.lit(0), F.datediff(as_of, published))
    decayed = F.round(F.greatest(F.lit(0.05), F.pow(F.lit(0.5), age / half_life)), 3)
    return F.when(~source_type.isin("legal_news", "regulator_circular", "gazette_notification"), 1.0).when(published.isNull(), 0.5).otherwise(decayed)


def reliability(trust: Column, n_providers: Column, retrievable: Column, citations: Column) -> Column:
    agree = F.least(n_providers / 3.0, F.lit(1.0))
    plain = 0.4 * trust + 0.3 * agree + 0.3 * retrievable
    cited = 0.35 * trust + 0.20 * agree + 0.20 * retrievable + 0.25 * F.least(F.log10(1 + citations) / 3, F.lit(1.0))
    return F.round(F.when(citations.isNull(), plain).otherwise(cited), 4)


def retrievability(status: Column) -> Column:
    return (
        F.when(status.isNull(), 0.4).when(status == 200, 1.0).when(status.isin(403, 405), 0.7).when(status.between(300, 399), 0.9).otherwise(0.3)
    )


def composite(authority: Column, relevance: Column, reliable: Column, recent: Column) -> Column:
    return F.round(0.35 * authority + 0.35 * relevance + 0.15 * reliable + 0.15 * recent, 4)


def batched(df: DataFrame, keys: list[str], order: str, size: int = 25) -> DataFrame:
    """``batch`` numbers of ``size`` rows each within ``keys``."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("batch", F.floor((number - 1) / size).cast("int"))


def with_relevance(df: DataFrame, responses: DataFrame) -> DataFrame:
    """Recorded relevance by (batch, source_id): rows of a batch without any get 0.4, others without one 0.3."""
    answered = responses.select("run_id", "batch").distinct().withColumn("answered", F.lit(True))
    joined = df.join(answered, ["run_id", "batch"], "left").join(responses, ["run_id", "batch", "source_id"], "left")
    return joined.withColumn("relevance", F.when(F.col("answered").isNull(), 0.4).otherwise(F.coalesce("relevance", F.lit(0.3)))).drop("answered")


def select_by_quota(candidates: DataFrame, cap: int = 18, least_composite: float = 0.45, least_relevance: float = 0.35) -> DataFrame:
    """Of each run: the three best of tier 1 and 2 (by composite among the relevant, then by relevance), the
    most relevant one, then by composite until ``cap``; ties go to the smaller ord.

    Needs run_id, source_id, tier, relevance, composite and ord. Gives the picks with the quota.
    """

    def rank(df: DataFrame, *order: Column) -> Column:
        return F.row_number().over(Window.partitionBy("run_id").orderBy(*order, "ord"))

    high = candidates.where("tier <= 2")
    first = high.where(F.col("relevance") >= least_relevance)
    first = first.withColumn("n", rank(first, F.desc("composite"))).where("n <= 3").select("run_id", "source_id", F.lit("tier").alias("quota"))
    had = first.groupBy("run_id").agg(F.count(F.lit(1)).alias("had"))
    rest = high.join(first, ["run_id", "source_id"], "left_anti").join(had, "run_id", "left")
    rest = rest.withColumn("n", rank(rest, F.desc("relevance"))).where(F.col("n") <= 3 - F.coalesce("had", F.lit(0)))
    tiers = first.unionByName(rest.select("run_id", "source_id", F.lit("tier").alias("quota")))
    top = candidates.withColumn("n", rank(candidates, F.desc("relevance"))).where("n = 1").select("run_id", "source_id", F.lit("relevance").alias("quota"))
    picked = tiers.unionByName(top.join(tiers, ["run_id", "source_id"], "left_anti"))
    taken = picked.groupBy("run_id").agg(F.count(F.lit(1)).alias("taken"))
    left = candidates.join(picked, ["run_id", "source_id"], "left_anti").where((F.col("composite") >= least_composite) & (F.col("relevance") >= least_relevance))
    fill = left.join(taken, "run_id").withColumn("n", rank(left, F.desc("composite"))).where(F.col("n") <= F.greatest(F.lit(0), cap - F.col("taken")))
    return picked.unionByName(fill.select("run_id", "source_id", F.lit("fill").alias("quota")))


def best_per_instrument(candidates: DataFrame, instruments: DataFrame) -> DataFrame:
    """Of each instrument (run_id, instrument) of a run the best statute by composite, ties by ord: one whose title
    holds the first 30 characters of its name, else any; ``source_id`` is null where the run has none."""
    typed = candidates.where(F.col("source_type").isin("statute", "subordinate_legislation"))
    typed = typed.select("run_id", "source_id", F.lower("title").alias("_title"), "source_type", F.struct((-F.col("composite")).alias("c"), "ord").alias("_order"))
    met = instruments.join(typed, "run_id")
    named = F.contains(F.coalesce("_title", F.lit("")), F.substring(F.lower("instrument"), 1, 30))
    met = met.where(named | (F.col("source_type") == "statute")).withColumn("_rank", F.struct(F.when(named, 0).otherwise(1).alias("k"), "_order"))
    best = met.groupBy("run_id", "instrument").agg(F.min_by("source_id", "_rank").alias("source_id"))
    return instruments.join(best, ["run_id", "instrument"], "left").select("run_id", "instrument", "source_id")


def shortfalls(candidates: DataFrame, least: int = 3) -> DataFrame:
    """Runs with fewer than ``least`` candidates of tier 1 and 2: run_id, ``quota`` and ``have``."""
    have = candidates.groupBy("run_id").agg(F.count_if(F.col("tier") <= 2).alias("have"))
    return have.where(F.col("have") < least).select("run_id", F.lit("min_tier12").alias("quota"), "have")


def dropped(candidates: DataFrame, picked: DataFrame) -> DataFrame:
    """The candidates that no quota took, with the reason."""
    rest = candidates.join(picked.select("run_id", "source_id"), ["run_id", "source_id"], "left_anti")
    return rest.select("run_id", "source_id", F.lit("below selection threshold").alias("dropped_reason"))
