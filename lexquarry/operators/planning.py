"""Queries of a plan: identity, deduplication, routing, clamping, stable issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.citations import strip
from lexquarry.functions.similarity import token_set_ratio_col
from lexquarry.functions.text import nfkc

# Providers by intent, the first preferred.
ROUTES = {
    "statute_text": ["indiacode", "tavily", "serpapi"],
    "case_law": ["indiankanoon", "tavily", "serpapi"],
    "related_precedent": ["exa", "indiankanoon", "serpapi"],
    "recent_development": ["perplexity", "tavily", "serpapi"],
    "regulatory_action": ["tavily", "serpapi", "exa"],
    "academic_commentary": ["semantic_scholar", "exa", "tavily", "serpapi"],
    "counter_view": ["exa", "perplexity", "tavily", "serpapi"],
    "comparative": ["exa", "tavily", "perplexity", "serpapi"],
    "background": ["tavily", "serpapi"],
}


def normalise_query(text: Column) -> Column:
    """Lower case, stripped, NFKC, runs of white space one blank, without punctuation."""
    return F.regexp_replace(F.regexp_replace(nfkc(strip(F.lower(text))), r"(?U)[\s\x1c-\x1f]+", " "), r"(?U)[^\w\s]", "")


def query_key(text: Column, intent: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", normalise_query(text), intent)), 1, 16)


def first_of_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def clamp(queries: DataFrame, most: int = 12) -> DataFrame:
    """Of each run the ``most`` queries of highest priority, ties by query_id."""
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("priority", "query_id"))
    return queries.withColumn("n", number).where(F.col("n") <= most)


def route(intent: Column, available: list[str]) -> Column:
    """The available providers of an intent in order, all available ones if it has none."""
    table = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    every = F.array(*[F.lit(p) for p in available])
    found = F.filter(F.coalesce(F.try_element_at(table, intent), F.array().cast("array<string>")), lambda p: p.isin(available))
    return F.when(F.size(found) > 0, found).otherwise(every)


def open_pairs(queries: DataFrame, executed: DataFrame) -> DataFrame:
    """(run_id, query_id, provider) of the plan that were not executed yet."""
    planned = queries.select("run_id", "query_id", F.explode("providers").alias("provider")).distinct()
    return planned.join(executed, ["run_id", "query_id", "provider"], "left_anti")


def stable_issues(previous: DataFrame, proposed: DataFrame, least: float = 70.0) -> DataFrame:
    """The previous issues in order, then the proposed ones that resemble none of them (run_id, pos, issue).

    Issues of one run are few, so they are compared run by run.
    """
    p, q = previous.select("run_id", F.col("issue").alias("old")), proposed
    pairs = q.join(p, "run_id").withColumn("score", token_set_ratio_col(F.lower("issue"), F.lower("old")))
    like = pairs.groupBy("run_id", "pos", "issue").agg(F.max("score").alias("best")).where(F.col("best") >= least).select("run_id", "pos", "issue")
    fresh = q.join(like, ["run_id", "pos", "issue"], "left_anti").withColumn("late", F.lit(1))
    both = previous.withColumn("late", F.lit(0)).unionByName(fresh)
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("late", "pos"))
    return both.select("run_id", number.alias("pos"), "issue")


def parse_date(text: Column, *formats: str) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.try_to_date(text, f) for f in (formats or ("yyyy-MM-dd",))])


def precedent_at_first(intent: Column, loop_index: Column) -> Column:
    """Related precedent is asked for in repair rounds only; at first it is case law. Ids keep the first intent."""
    return F.when((intent == "related_precedent") & (loop_index == 0), "case_law").otherwise(intent)


def add_missing(plan: DataFrame, extra: DataFrame, executed: DataFrame) -> DataFrame:
    """The plan and those of ``extra`` (same columns) whose (run_id, query_id) is neither in it nor executed."""
    keys = ["run_id", "query_id"]
    fresh = extra.dropDuplicates(keys).join(plan.select(*keys), keys, "left_anti").join(executed.select(*keys), keys, "left_anti")
    return plan.unionByName(fresh)


def fill_short_plans(plan: DataFrame, template: DataFrame, executed: DataFrame, least: int = 4, most: int = 12) -> DataFrame:
    """Plans of fewer than ``least`` queries with those of ``template`` that are new, ``most`` at most, by ``place``."""
    short = plan.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("run_id")
    filled = add_missing(plan.withColumn("late", F.lit(0)), template.join(short, "run_id", "left_semi").withColumn("late", F.lit(1)), executed)
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("late", "place", "query_id"))
    return filled.withColumn("n", number).where(F.col("n") <= most).drop("n", "late")
