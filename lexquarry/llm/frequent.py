"""The most frequent words of a corpus, without a sort of all words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.session import settle

#: Buckets of counts by factor e: finer ones fill the limit better.
_FINE = 20


def most_frequent(counts: DataFrame, limit: int) -> list:
    """At most ``limit`` rows of ``counts`` (columns word and n): all words whose count is above a cut.

    A histogram of the logarithms of the counts, under a thousand rows, places the cut; so the
    driver receives ``limit`` rows at most, however many partitions there are.
    """
    held = settle(counts.withColumn("bucket", F.floor(F.log("n") * _FINE).cast("int")), "counts")
    room, cut = limit, None
    for row in sorted(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.bucket):
        room -= row.words
        if room < 0:
            break
        cut = row.bucket
    if cut is None:
        return []
    return sorted(held.where(F.col("bucket") >= cut).select("word", "n").collect(), key=lambda r: (-r.n, r.word if isinstance(r.word, str) else bytes(r.word)))
