"""Coverage of issues by evidence, histograms and comparisons of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(evidence: DataFrame, issues: DataFrame) -> DataFrame:
    """Evidence rows of each run's issue; issues (run_id, issue_no) without any keep a zero.

    ``supports_issues`` holds issue numbers as strings; what is no number is ignored and a repeat counts once.
    """
    cited = evidence.select("run_id", F.explode(F.array_distinct("supports_issues")).alias("s")).select("run_id", F.col("s").try_cast("int").alias("issue_no"))
    counts = cited.where("issue_no is not null").groupBy("run_id", "issue_no").agg(F.count(F.lit(1)).alias("n"))
    return issues.join(counts, ["run_id", "issue_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def summaries(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Several group counts in one pass; ``grouping`` tells them apart."""
    columns = sorted({c for s in sets for c in s})
    groups = [[F.col(c) for c in s] for s in sets]
    return df.groupingSets(groups, *[F.col(c) for c in columns]).agg(F.grouping_id(*columns).alias("grouping"), F.count(F.lit(1)).alias("n"))


def compare_rounds(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (n) of two rounds side by side; a key of one round has 0 in the other."""
    joined = before.withColumnRenamed("n", "n_before").join(after.withColumnRenamed("n", "n_after"), keys, "full")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after")])


def changes_of_rounds(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Which keys of a round are gone in the next one, which stay and which are new: keys and ``change`` (closed,
    open, new)."""
    a = before.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("_b", F.lit(True))
    change = F.when(F.col("_b").isNull(), "closed").when(F.col("_a").isNull(), "new").otherwise("open")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))
