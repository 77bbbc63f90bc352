"""Recorded search responses as tables: one row per hit, in the columns of raw_result.

Each parser takes ``query_id`` and ``response`` (the JSON text) and never fails on a bad response: rows that
cannot be read are in :func:`rejected`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.urls import canonical_url

COLUMNS = "query_id string, provider string, provider_rank int, url string, title string, snippet string, published_at date, venue string"
_DATES = ["yyyy-MM-dd", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy"]


def _date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(text, f) for f in _DATES], F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def _text(c: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(c, r"<[^>]+>", "")), F.lit(""))


def _rows(df: DataFrame, items: Column, limit: int) -> DataFrame:
    return df.select("query_id", F.posexplode(F.slice(items, 1, limit)).alias("i", "x"))


def _shape(df: DataFrame, provider: str, rank: Column, url: Column, title: Column, snippet: Column, date: Column, venue: Column) -> DataFrame:
    out = df.select("query_id", F.lit(provider).alias("provider"), rank.cast("int").alias("provider_rank"), url.alias("url"), title.alias("title"),
                    snippet.alias("snippet"), date.alias("published_at"), venue.alias("venue"))
    return out.where("url is not null and url <> ''")



def _null() -> Column:
    return F.lit(None).cast("string")


def web_results(df: DataFrame, limit: int = 10) -> DataFrame:
    """results[] with url, title, content, published_date: the content cut to 500 characters, ranks from 1."""
    parsed = F.from_json("response", "results array<struct<url:string,title:string,content:string,published_date:string>>")
    x = F.col("x")
    return _shape(_rows(df, parsed["results"], limit), "tavily", F.col("i") + 1, x["url"], x["title"], F.substring(x["content"], 1, 500), _date(x["published_date"]), _null())


def organic_results(df: DataFrame, limit: int = 10) -> DataFrame:
    """organic_results[] with link, title, snippet, date, position; a response with ``error`` gives none."""
    parsed = F.from_json("response", "error string, organic_results array<struct<position:int,title:string,link:string,snippet:string,date:string>>")
    x = F.col("x")
    good = df.where(parsed["error"].isNull())
    return _shape(_rows(good, parsed["organic_results"], limit), "serpapi", x["position"], x["link"], x["title"], x["snippet"], _date(x["date"]), _null())


def case_results(df: DataFrame, base: str, limit: int = 10) -> DataFrame:
    """docs[] with tid, title, headline, docsource, publishdate: the URL built from tid, tags stripped."""
    parsed = F.from_json("response", "docs array<struct<tid:string,title:string,headline:string,docsource:string,publishdate:string>>")
    x = F.col("x")
    url = F.when(x["tid"].isNotNull(), F.concat(F.lit(base), x["tid"], F.lit("/")))
    return _shape(_rows(df, parsed["docs"], limit), "indiankanoon", F.col("i") + 1, url, _text(x["title"]), _text(x["headline"]), _date(x["publishdate"]), x["docsource"])


def cited_urls(df: DataFrame, limit: int = 10) -> DataFrame:
    """citations[] of URLs: no titles, and the answer as the snippet of the first only."""
    parsed = F.from_json("response", "answer string, citations array<string>")
    rows = df.select("query_id", parsed["answer"].alias("answer"), F.posexplode(F.slice(parsed["citations"], 1, limit)).alias("i", "x"))
    return _shape(rows, "perplexity", F.col("i") + 1, F.col("x"), _null(), F.when(F.col("i") == 0, F.col("answer")), F.lit(None).cast("date"), _null())


def no_results(spark: SparkSession) -> DataFrame:
    """What a provider without an implementation gives."""
    return spark.createDataFrame([], COLUMNS)


def rejected(df: DataFrame) -> DataFrame:
    """query_id and reason of responses that are no JSON object or report an error."""
    error = F.get_json_object("response", "$.error")
    reason = F.when(F.try_parse_json("response").isNull() | ~F.coalesce(F.ltrim("response").startswith("{"), F.lit(False)), "not_json").when(error.isNotNull(), "provider_error")
    return df.select("query_id", reason.alias("reason")).where("reason is not null")


def with_raw_id(hits: DataFrame) -> DataFrame:
    page = canonical_url(F.col("url"))
    return hits.withColumn("url_canonical", page).withColumn("raw_id", F.substring(F.sha1(F.concat_ws(":", "query_id", "provider", page)), 1, 16))
