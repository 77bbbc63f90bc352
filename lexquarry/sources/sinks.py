"""Writing: append-only logs, articles as text files, rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str, day: str | None = None) -> None:
    """Add rows to a log; with ``day``, the name of a timestamp column, in a folder for each day."""
    if day is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles (doc_id, article) as Markdown, in a folder for each doc_id, written by the executors."""
    articles.select("doc_id", F.col("article").alias("value")).write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)


def as_json(rows: DataFrame, key: str, name: str = "payload") -> DataFrame:
    """``key`` and the other columns as one JSON object, nulls kept."""
    rest = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(name))
