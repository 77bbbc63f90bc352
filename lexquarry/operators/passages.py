"""Passages of documents scored against issues, selected and packed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.text import cut_chunks, cut_passages, discourse_weight, spans_of, tokens

# Fixed value: what stands between passages of a digest.
OMISSION = "\n\n[... omitted ...]\n\n"


def scored_passages(documents: DataFrame, issue_terms: list[str], size: int = 2000) -> DataFrame:
    """doc_id, span_no, start, end, span and score of each passage.

    The score: three times the summed document-wise idf of the issue terms over the root of the number of
    tokens, the weights of discourse families, and the place in the document.
    """
    spans = spans_of(documents, "doc_id", "text", cut_passages, size).withColumn("tokens", tokens(F.col("span")))
    # One pass over the texts: the terms of each passage travel with it, those of the document by one window.
    whole = Window.partitionBy("doc_id")
    own = F.filter("tokens", lambda t: t.isin(issue_terms))
    spans = spans.withColumn("own", own).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("all", F.flatten(F.collect_list(F.array_distinct("own")).over(whole)))
    times = lambda column, term: F.size(F.array_compact(F.transform(column, lambda t: F.when(t == term, t))))
    mass = sum((times("own", term) * F.log(1 + F.col("n") / (1 + times("all", term))) for term in issue_terms), F.lit(0.0))
    spans = spans.withColumn("mass", mass)
    length = F.greatest(F.sqrt(F.size("tokens")), F.lit(1.0))
    share = F.col("span_no") / F.col("n")
    place = F.when(share > 0.85, 1.2).when(share < 0.05, 0.4).otherwise(0.0)
    score = 3 * F.col("mass") / length + discourse_weight(F.col("span")) + place
    return spans.select("doc_id", "span_no", "start", "end", "span", score.alias("score"))


def digests(passages: DataFrame, n_digests: int = 3, max_chars: int = 25_000) -> DataFrame:
    """Of each document at most ``n_digests`` texts: the first and the last two passages, then the best, as long as
    they fit, in document order, packed into ``max_chars`` each, the weakest left out until they fill no more.
    One document's passages come together, no more."""

    def pack(spans: list[str]) -> list[str]:
        bins: list[list[str]] = []
        room = 0
        for span in spans:
            if not bins or len(span) > room:
                bins.append([])
                room = max_chars
            bins[-1].append(span)
            room -= len(span)
        return [OMISSION.join(b) for b in bins]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(group["span_no"].tolist(), group["span"].tolist(), group["score"].tolist()))
        n = len(rows)
        forced = {0, n - 1, max(0, n - 2)}
        chosen, room = set(), n_digests * max_chars
        for i in [*sorted(forced), *sorted(set(range(n)) - forced, key=lambda i: (-rows[i][2], i))]:
            if len(rows[i][1]) <= room:
                chosen.add(i)
                room -= len(rows[i][1])
        while True:
            bins = pack([rows[i][1] for i in sorted(chosen)])
            loose = chosen - forced
            if len(bins) <= n_digests or not loose:
                break
            chosen.remove(min(loose, key=lambda i: (rows[i][2], i)))
        bins = bins[:n_digests]
        doc = group["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": np.full(len(bins), doc), "digest_no": np.arange(len(bins)), "digest": np.array(bins, object)})

    return passages.select("doc_id", "span_no", "span", "score").groupBy("doc_id").applyInPandas(one, "doc_id long, digest_no int, digest string")


def reading_budget(tier: Column) -> tuple[Column, Column]:
    """(passes, items) a source of a tier may take."""
    return F.when(tier <= 2, 3).when(tier == 3, 2).otherwise(1), F.when(tier <= 2, 16).when(tier == 3, 12).otherwise(8)


def round_robin(items: DataFrame, key: str, pass_no: str, item_no: str, most: Column) -> DataFrame:
    """If a key has more than ``most`` items, the first of each pass in turn, then the second ..."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(item_no, pass_no))
    return items.withColumn("_n", turn).where(F.col("_n") <= most).drop("_n")


def full_or_digest(documents: DataFrame, passes: Column, chunk: int = 25_000, overlap: int = 800) -> DataFrame:
    """doc_id, n_chunks and ``selection``: full where the chunks of the text are at most ``passes``, else digest."""
    counted = spans_of(documents, "doc_id", "text", cut_chunks, chunk, overlap).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    joined = documents.where("text is not null").withColumn("_passes", passes).select("doc_id", "_passes").join(counted, "doc_id", "left")
    n = F.coalesce("n_chunks", F.lit(0))
    return joined.select("doc_id", n.alias("n_chunks"), F.when(n <= F.col("_passes"), "full").otherwise("digest").alias("selection"))
