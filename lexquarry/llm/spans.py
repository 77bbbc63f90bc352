"""Problem 1: long stretches that records share character for character.

1. Every text gives the least hash of each run of neighbouring ``GRAM``-character passages
   (winnowing). Two texts that share ``least`` characters give at least one passage in common.
2. Passages that records of two different keys give are the recurring phrases; they are grouped by
   their characters, so each is confirmed.
3. The phrases are split by hash into shards, each compiled into an Aho-Corasick automaton; every
   text that holds a phrase of a shard is streamed through that shard's automaton, which finds
   all its occurrences. Shards with many texts are split further, the phrases repeated.
4. Every stretch of ``least`` characters around an occurrence gets a 128-bit hash; stretches that
   records of two different keys hold are shared. Only the least and the greatest key (a 64-bit hash) are
   kept, so a passage in a third of all records is as cheap as any other.

Defined results. Null keys and null or short texts share nothing. Rows repeated under one key are one
record; equal texts under two keys are shared wholly. Empty tables give no rows. Characters are code
points. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.session import settle

GRAM = 48
PHRASES_IN_SHARD = 4_000
CHARACTERS_IN_GROUP = 8_000_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def run_hashes(codes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``size`` codes, put together from runs of powers of two."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        piece, width, power = codes * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(0x2545F4914F6CDD1D), 1, base
        out, done = None, 0
        rest = size
        while rest:
            if rest & 1:
                out = piece[:n].copy() if out is None else out * power + piece[done : done + n]
                done += width
            rest >>= 1
            if rest:
                piece = piece[:-width] * power + piece[width:]
                power, width = power * power, width * 2
        out ^= out >> np.uint64(31)
        return out * np.uint64(0xD6E8FEB86659FD93)


def least_of_runs(values: np.ndarray, size: int) -> np.ndarray:
    """The least value of every run of ``size`` values, or of all if there are fewer."""
    size = min(size, len(values))
    low, width = values, 1
    while width * 2 <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(values) - size + 1], low[size - width :])


def passages(text: str, least: int, gram: int = GRAM) -> list[str]:
    """The passages a text gives: none if it is shorter than ``least``."""
    if len(text) < least:
        return []
    hashes = run_hashes(points(text), gram, _BASES[0])
    chosen = np.unique(least_of_runs(hashes, least - gram + 1))
    where = np.flatnonzero(np.isin(hashes, chosen))
    return list({text[i : i + gram] for i in where.tolist()})


def _passages(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, phrases = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                found = passages(text, least)
                rows += [i] * len(found)
                phrases += found
            pick = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pick) for j in range(3)), pa.array(phrases, pa.string())], ["text_no", "low", "high", "phrase"])

    return run


def _stretches(least: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """``left``: texts of a group, ``right``: the phrases of its shard."""
        machine = ahocorasick.Automaton()
        for phrase in right.column("phrase").to_pylist():
            machine.add_word(phrase, len(phrase))
        out: list[list] = [[], [], [], [], [], []]  # h1, h2, start, text_no, low, high
        if len(machine) and left.num_rows:
            machine.make_automaton()
            numbers, lows, highs, texts = (left.column(c).to_pylist() for c in ("text_no", "low", "high", "text"))
            for text_no, low, high, text in zip(numbers, lows, highs, texts):
                marks = np.zeros(len(text) - least + 2, np.int64)
                for end, size in machine.iter(text):
                    first, last = max(0, end + 1 - least), min(end + 1 - size, len(text) - least)
                    if first <= last:
                        marks[first] += 1
                        marks[last + 1] -= 1
                starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                if len(starts):
                    codes = points(text)
                    one, two = (run_hashes(codes, least, b)[starts].view(np.int64) for b in _BASES)
                    out[0].append(one)
                    out[1].append(two)
                    out[2].append(starts)
                    for k, value in ((3, text_no), (4, low), (5, high)):
                        out[k].append(np.full(len(starts), value, np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.Table.from_arrays([pa.array(x.astype(np.int32 if k == 2 else np.int64)) for k, x in enumerate(flat)], ["h1", "h2", "start", "text_no", "low", "high"])

    return run


def shared_stretches(records: DataFrame, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """``records`` has id and text. Gives (id, text_id, size) of the records with a text, and the
    text_id with the starts of all its stretches of ``least`` characters that stand in records of two ids."""
    rows = records.select(F.col("id").cast("string"), "text").where("id is not null and text is not null")
    rows = rows.where(F.length("text") > 0).select("id", F.md5("text").alias("text_id"), "text")
    key = F.xxhash64("id")
    texts = rows.where(F.length("text") >= least).groupBy("text_id").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.first("text").alias("text"))
    texts = settle(texts.select("text_id", F.monotonically_increasing_id().alias("text_no"), "low", "high", "text"), "texts")
    given = settle(texts.select("text_no", "low", "high", "text").mapInArrow(_passages(least), "text_no long, low long, high long, phrase string"), "passages")
    recurring = given.groupBy("phrase").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("phrase")
    recurring = settle(recurring, "phrases")
    shards = max(1, -(-recurring.count() // PHRASES_IN_SHARD))
    sharded = recurring.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)).cast("int"))
    routed = given.join(sharded, "phrase").select("text_no", "shard").distinct()
    placed = routed.join(texts.drop("text_id"), "text_no")
    split = placed.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / CHARACTERS_IN_GROUP).cast("int").alias("parts"))
    placed = placed.join(split, "shard").withColumn("part", F.pmod(F.xxhash64("text_no"), F.col("parts")).cast("int")).drop("parts")
    repeated = sharded.join(split, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    repeated = repeated.select("phrase", F.col("shard").alias("of_shard"), F.col("part").alias("of_part"))
    found = placed.groupBy("shard", "part").cogroup(repeated.groupBy("of_shard", "of_part")).applyInArrow(
        _stretches(least), "h1 long, h2 long, start int, text_no long, low long, high long"
    )
    found = settle(found, "stretches")  # a stretch may come from several shards, which changes no minimum
    shared = found.groupBy("h1", "h2").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("h1", "h2")
    hits = found.select("h1", "h2", "text_no", "start").join(shared, ["h1", "h2"], "left_semi")
    hits = hits.groupBy("text_no").agg(F.collect_set("start").alias("starts")).join(texts.select("text_no", "text_id"), "text_no").select("text_id", "starts")
    return rows.select("id", "text_id", F.length("text").alias("size")).distinct(), hits


def sharing_ids(records: DataFrame, least: int = 200) -> DataFrame:
    """The ids of records that share a stretch of ``least`` characters with a record of another id."""
    rows, hits = shared_stretches(records, least)
    return rows.join(hits.select("text_id"), "text_id").select("id").distinct()


def shared_amount(records: DataFrame, least: int = 200) -> DataFrame:
    """Of each record its size, the characters covered by shared stretches, their share and the spans.

    A record with several texts has a row for each.
    """
    rows, hits = shared_stretches(records, least)
    sorted_starts = hits.select("text_id", F.array_sort("starts").alias("starts"))
    begins = F.filter("starts", lambda s, i: (i == 0) | (s - F.get("starts", i - 1) > least))
    ends = F.transform(F.filter("starts", lambda s, i: F.coalesce(F.get("starts", i + 1) - s > least, F.lit(True))), lambda s: s + least)
    spans = sorted_starts.select("text_id", F.arrays_zip(begins.alias("begin"), ends.alias("end")).alias("spans"))
    total = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"])
    joined = rows.join(spans, "text_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")))
    return joined.select("id", "size", total.alias("shared_chars"), (total / F.col("size")).alias("shared_rate"), "spans")
