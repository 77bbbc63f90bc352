"""Quotes found again in the texts they claim to come from: exact, normalised, fuzzy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexquarry.functions.similarity import best_window, ratio
from lexquarry.session import settle

FUZZY = 92.0
# Characters that count as one when quotes are compared.
SAME = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "})
_ANCHOR = 3
#: Characters of short quotes that are sent to all workers at one time.
BLOCK_CHARACTERS = 2_000_000


def soften(text: Column) -> Column:
    """Quotation marks, dashes and blanks made equal, runs of white space one blank."""
    return F.regexp_replace(F.translate(text, "‘’“”–— ", "''\"\"-- "), r"\s+", " ")


def _blocks(quotes: DataFrame, most: int) -> Iterator[tuple[list[tuple], bool]]:
    """(quote_id, softened quote) in blocks of at most ``most`` characters, or of one quote, and whether more follow."""
    now: list[tuple] = []
    room = most
    for row in quotes.select("quote_id", soften(F.col("quote")).alias("q")).toLocalIterator():
        if now and len(row.q) > room:
            yield now, True
            now, room = [], most
        now.append((row.quote_id, row.q))
        room -= len(row.q)
    if now:
        yield now, False


def _streamed(documents: DataFrame, quotes: DataFrame, most: int = BLOCK_CHARACTERS) -> DataFrame | None:
    """Pairs of a document and a quote whose softened forms hold each other: one automaton of all quotes of a block runs
    over each text once. None without quotes."""
    spark = documents.sparkSession
    texts = documents.where("text is not null").select("doc_id", soften(F.col("text")).alias("t"))
    schema = StructType([StructField("quote_id", quotes.schema["quote_id"].dataType), StructField("doc_id", documents.schema["doc_id"].dataType)])
    out = None
    for block, more in _blocks(quotes, most):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            machine = ahocorasick.Automaton()
            for quote_id, quote in shared.value:
                machine.add_word(quote, [*machine.get(quote, []), quote_id])
            machine.make_automaton()
            for batch in batches:
                pairs = {(q, doc) for doc, text in zip(batch["doc_id"].tolist(), batch["t"].tolist()) for _, ids in machine.iter(text) for q in ids}
                yield pd.DataFrame(list(pairs), columns=["quote_id", "doc_id"])

        part = texts.mapInPandas(scan, schema)
        if more:
            part = settle(part, "streamed")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def candidates(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """Pairs of a document and a quote that could stand in it.

    A quote that stands in a text brings its inner words along: a run of ``_ANCHOR`` of them, the one with most letters,
    is an equi-join key against the runs of the text. Quotes with fewer inner words are found by an automaton.
    """
    words = lambda c: F.split(soften(c), " ")
    text = lambda w, i: F.array_join(F.slice(w, i, _ANCHOR), " ")
    q = quotes.where("quote is not null and quote <> ''").withColumn("_w", words(F.col("quote"))).withColumn("_n", F.size("_w"))
    long = q.where(F.col("_n") >= _ANCHOR + 2)
    inner = F.transform(F.sequence(F.lit(2), F.col("_n") - _ANCHOR), lambda i: F.struct(F.length(text(F.col("_w"), i)).alias("size"), F.xxhash64(text(F.col("_w"), i)).alias("key")))
    keyed = long.withColumn("_key", F.array_max(inner)["key"])
    texts = documents.where("text is not null").withColumn("_w", words(F.col("text")))
    n = F.size("_w") - _ANCHOR + 1
    runs = texts.where(n >= 1).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(text(F.col("_w"), i))))).alias("_key"))
    hits = keyed.select("quote_id", "_key").join(runs, "_key").select("quote_id", "doc_id").distinct()
    loose = _streamed(documents, q.where(F.col("_n") < _ANCHOR + 2))
    return hits if loose is None else hits.unionByName(loose)


def ground_exact(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, quote_id and the offsets (code points, end exclusive) of the first exact occurrence."""
    pairs = candidates(documents, quotes).join(quotes.select("quote_id", "quote"), "quote_id").join(documents.select("doc_id", "text"), "doc_id")
    place = F.instr(F.col("text"), F.col("quote")) - 1
    return pairs.withColumn("start", place).where("start >= 0").select("doc_id", "quote_id", "start", (F.col("start") + F.length("quote")).alias("end"))


def ground_normalised(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """Pairs where the softened quote stands in the softened text."""
    pairs = candidates(documents, quotes).join(quotes.select("quote_id", "quote"), "quote_id").join(documents.select("doc_id", "text"), "doc_id")
    return pairs.where(F.contains(soften(F.col("text")), soften(F.col("quote")))).select("doc_id", "quote_id")


def normalised_place(text: str, quote: str) -> tuple[int, int] | None:
    """Offsets in ``text`` itself of the softened quote."""
    pattern = r"\s+".join(re.escape(p) for p in re.split(r"\s+", quote.translate(SAME)))
    m = re.search(pattern, text.translate(SAME))
    return m.span() if m and quote else None


def fuzzy_place(text: str, quote: str, least: float = FUZZY) -> tuple[int, int] | None:
    """Offsets of the stretch of the quote's length whose partial ratio with it is highest, at least ``least`` of 100.

    All stretches count, not only those on a grid. A text shorter than the quote is compared as a whole.
    """
    n = len(quote)
    if not 10 <= n <= 5000 or not text:
        return None
    if len(text) < n:
        return (0, len(text)) if ratio(quote, text) >= least else None
    at = best_window(quote, text, least)
    return None if at is None else (at, at + n)


def ground(claims: DataFrame) -> DataFrame:
    """Ladder of a claim (claim_id, text, quote): exact, normalised, fuzzy, ungrounded, with offsets.

    The exact step is built in; only what it leaves reaches the Python steps.
    """
    place = F.instr(F.col("text"), F.col("quote")) - 1
    usable = F.coalesce(F.length("quote") > 0, F.lit(False)) & F.col("text").isNotNull()
    marked = claims.withColumn("_at", F.when(usable, place).otherwise(-1))
    done = marked.where("_at >= 0").select("claim_id", F.lit("exact").alias("level"), F.col("_at").alias("start"), (F.col("_at") + F.length("quote")).alias("end"))
    rest = marked.where("_at < 0").select("claim_id", "text", "quote")
    kind = claims.schema["claim_id"].dataType.simpleString()

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for claim, text, quote in zip(batch["claim_id"].tolist(), batch["text"].tolist(), batch["quote"].tolist()):
                level, span = "ungrounded", None
                if text and quote:
                    if span := normalised_place(text, quote):
                        level = "normalized"
                    elif span := fuzzy_place(text, quote):
                        level = "fuzzy"
                rows.append((claim, level, *(span or (None, None))))
            out = pd.DataFrame(rows, columns=["claim_id", "level", "start", "end"])
            yield out.astype({"start": "Int32", "end": "Int32"})

    return done.unionByName(rest.mapInPandas(climb, f"claim_id {kind}, level string, start int, end int"))


def binding_strength(kind: Column, tier: Column, match: Column) -> Column:
    return (
        F.when(kind == "commentary_opinion", "opinion")
        .when(tier <= 2, F.when(match, "binding").otherwise("persuasive"))
        .when(tier == 3, F.when(match, "persuasive").otherwise("informative"))
        .otherwise("informative")
    )


def broken_rule(kind: Column, level: Column, quote: Column, strength: Column, tier: Column, match: Column, quotable: Column) -> Column:
    """The first invariant an evidence row breaks, null if none."""
    comment = kind == "commentary_opinion"
    return (
        F.when(~quotable & ~comment, "not_quotable")
        .when(~comment & quote.isNull(), "no_quote")
        .when(~comment & ~level.isin("exact", "normalized"), "not_verbatim")
        .when((strength == "binding") & (tier > 2), "binding_tier")
        .when((strength == "binding") & ~match, "binding_jurisdiction")
    )


def evidence_id(source_id: Column, statement: Column, start: Column, end: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha1(F.concat_ws(":", source_id, statement, text(start), text(end))), 1, 16)


def settle_quotes(graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graded claims (kind, quote, level and any other columns) that stand, and the errors.

    No quote counts as exact. A commentary whose quote was not found stands without it; any other claim whose
    quote was not found is an error.
    """
    level = F.when(F.col("quote").isNull(), "exact").otherwise(F.coalesce("level", F.lit("ungrounded")))
    comment = F.coalesce(F.col("kind") == "commentary_opinion", F.lit(False))
    marked = graded.withColumn("level", level).withColumn("_comment", comment)
    lost = F.col("level") == "ungrounded"
    stand = marked.where(~lost | F.col("_comment")).withColumn("quote", F.when(~lost, F.col("quote"))).drop("_comment")
    errors = marked.where(lost & ~F.col("_comment")).drop("_comment").withColumn("error", F.lit("extraction_failed"))
    return stand, errors


def grounding_report(graded: DataFrame, keys: list[str], least: float = 0.7) -> DataFrame:
    """Of each group the claims by level, the share that is grounded (three places) and whether it is too low."""
    levels = ["exact", "normalized", "fuzzy", "ungrounded"]
    counts = graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("level") == name).alias(name) for name in levels])
    rate = F.round((F.col("total") - F.col("ungrounded")) / F.col("total"), 3)
    return counts.withColumn("pass_rate", rate).withColumn("low", rate < least)
