"""Drafts with evidence markers: extraction, scope, malformed markers, quotes, rendering, assembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from lexquarry.functions.similarity import partial_ratio_col

# Markers of evidence and of calculations, loose ones and what is left of broken ones.
MARKER = r"\[\[ev:([a-zA-Z0-9_-]+)\]\]"
CALC = r"\[\[calc:([a-zA-Z0-9_-]+)\]\]"
LOOSE = r"ev:([a-zA-Z0-9_-]+)"
DEBRIS = r"\[*ev:[a-zA-Z0-9_-]+\]*(?:,\s*\[*ev:[a-zA-Z0-9_-]+\]*)*"
CLOSE = 92.0
# Phrases that hedge.
HEDGES = [
    "a compelling argument can be made",
    "on balance",
    "the better view",
    "may not have been accurate",
]
UNRESOLVED = "[citation unresolved]"


def markers(bodies: DataFrame) -> DataFrame:
    """section_id, pos (from 0) and evidence_id of each marker, repeats kept."""
    found = F.regexp_extract_all("body", F.lit(MARKER), F.lit(1))
    return bodies.select("section_id", F.posexplode(found).alias("pos", "evidence_id"))


def malformed(bodies: DataFrame) -> DataFrame:
    """Loose marker tokens beyond the strict ones, as a multiset difference: section_id, token, n."""
    loose = bodies.select("section_id", F.explode(F.regexp_extract_all("body", F.lit(LOOSE), F.lit(1))).alias("token"))
    strict = bodies.select("section_id", F.explode(F.regexp_extract_all("body", F.lit(MARKER), F.lit(1))).alias("token"))
    rest = loose.exceptAll(strict)
    return rest.groupBy("section_id", "token").agg(F.count(F.lit(1)).alias("n"))


def marker_status(marks: DataFrame, offered: DataFrame, known: DataFrame) -> DataFrame:
    """unresolved where no evidence has the id, out_of_scope where the section was not offered it, else ok."""
    k = known.select("evidence_id").distinct().withColumn("_k", F.lit(True))
    o = offered.select("section_id", "evidence_id").distinct().withColumn("_o", F.lit(True))
    joined = marks.join(k, "evidence_id", "left").join(o, ["section_id", "evidence_id"], "left")
    status = F.when(F.col("_k").isNull(), "unresolved").when(F.col("_o").isNull(), "out_of_scope").otherwise("ok")
    return joined.select("section_id", "pos", "evidence_id", status.alias("status"))


def first_established(cited: DataFrame) -> DataFrame:
    """Facts known before a section: (doc_id, section_no, evidence_id) first cited in an earlier section."""
    first = cited.groupBy("doc_id", "evidence_id").agg(F.min("section_no").alias("first_no"))
    sections = cited.select("doc_id", "section_no").distinct()
    return sections.join(first, "doc_id").where("first_no < section_no").select("doc_id", "section_no", "evidence_id")


def running_hedges(sections: DataFrame) -> DataFrame:
    """Hedging phrases in all earlier sections of the document."""
    own = sum((F.regexp_count(F.lower("body"), F.lit(h)) for h in HEDGES), F.lit(0))
    earlier = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    counted = sections.select("doc_id", "section_no", own.alias("own"))
    return counted.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))


def recompute(method: Column, values: Column, periods: Column) -> Column:
    """sum, difference, ratio, delta_pct or cagr of an array; null for a wrong shape."""
    n, a, b = F.size(values), F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(2))
    two = n == 2
    growth = F.when((a > 0) & (b >= 0) & (periods > 0), (F.pow(F.try_divide(b, a), F.try_divide(F.lit(1.0), periods)) - 1) * 100)
    return (
        F.when((method == "sum") & (n > 0), F.aggregate(values, F.lit(0.0), lambda s, v: s + v))
        .when((method == "difference") & two, a - b)
        .when((method == "ratio") & two, F.try_divide(a, b))
        .when((method == "delta_pct") & two, F.try_divide((b - a) * 100, a))
        .when((method == "cagr") & two, growth)
    )


def calc_matches(computed: Column, claimed: Column) -> Column:
    return F.abs(computed - claimed) <= F.greatest(F.abs(computed) * 0.01, F.lit(0.05))


def quoted_claims(bodies: DataFrame) -> DataFrame:
    """section_id, quote and evidence_id of quotations of 10 to 800 characters directly before a marker."""
    pattern = r"(?U)[\"“]([^\"”]{10,800})[\"”]\s*" + MARKER
    quotes = F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    ids = F.regexp_extract_all("body", F.lit(pattern), F.lit(2))
    return bodies.select("section_id", F.explode(F.arrays_zip(quotes.alias("quote"), ids.alias("evidence_id"))).alias("c")).select("section_id", "c.*")


def plain_quote(text: Column) -> Column:
    """For comparison: lower case, dashes as blanks, no punctuation, runs of blanks one."""
    out = F.regexp_replace(F.lower(text), "[-–—]", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", ""), r"\s+", " "))


def verify_quotes(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each quotation (section_id, quote, evidence_id) with ``status`` and, where it was scored, ``score``.

    unresolved without such evidence, no_quote without a quote of it, clean if one stands in the other, else
    close or diverging by the partial ratio.
    """
    held = evidence.groupBy("evidence_id").agg(F.max("verbatim_quote").alias("_verbatim"), F.lit(True).alias("_known"))
    joined = claims.join(held, "evidence_id", "left").withColumn("_q", plain_quote(F.col("quote"))).withColumn("_v", plain_quote(F.col("_verbatim")))
    clean = (F.col("_q") != "") & (F.contains("_v", "_q") | F.contains("_q", "_v"))
    state = F.when(F.col("_known").isNull(), "unresolved").when(F.coalesce("_verbatim", F.lit("")) == "", "no_quote").when(clean, "clean")
    marked = joined.withColumn("_state", state)
    unclear = F.col("_state").isNull()
    scored = marked.withColumn("score", partial_ratio_col(F.when(unclear, F.col("_q")), F.when(unclear, F.col("_v"))))
    status = F.coalesce("_state", F.when(F.col("score") >= CLOSE, "close").otherwise("diverging"))
    return scored.select("section_id", "evidence_id", "quote", status.alias("status"), "score")


def calc_text(result: Column, unit: Column) -> Column:
    """Two places at most, without trailing zeros, and the unit."""
    plain = F.regexp_replace(F.format_string("%.2f", result), r"\.?0+$", "")
    return F.concat(plain, F.coalesce(unit, F.lit("")))


def render(bodies: DataFrame, citations: DataFrame, calcs: DataFrame | None = None) -> DataFrame:
    """Bodies as readers see them: calculation markers as results (``calcs``: section_id, calc_id, claimed_result,
    unit), evidence markers as citation and pinpoint in brackets (``citations``: evidence_id, citation,
    pinpoint), and whatever is left of broken markers as unresolved.

    The body is split at its markers, the parts joined with what they stand for and put together in order.
    """
    both = f"{CALC}|{MARKER}"
    plain = both.replace("(", "(?:")
    found = F.regexp_extract_all("body", F.lit(f"({plain})"), F.lit(1))
    parts = bodies.select("section_id", F.posexplode(F.split("body", plain)).alias("pos", "part"), found.alias("found")).withColumn("mark", F.get("found", F.col("pos")))
    parts = parts.drop("found").withColumn("evidence_id", F.nullif(F.regexp_extract("mark", MARKER, 1), F.lit(""))).withColumn("calc_id", F.nullif(F.regexp_extract("mark", CALC, 1), F.lit("")))
    if "pinpoint" not in citations.columns:
        citations = citations.withColumn("pinpoint", F.lit(None).cast("string"))
    known = citations.groupBy("evidence_id").agg(F.max(F.struct("citation", "pinpoint")).alias("c"), F.lit(True).alias("known"))
    cited = parts.join(known, "evidence_id", "left")
    cite = F.coalesce(F.nullif("c.citation", F.lit("")), F.lit(UNRESOLVED))
    pin = F.when(F.coalesce("c.pinpoint", F.lit("")) != "", F.concat(F.lit(", "), F.col("c.pinpoint"))).otherwise("")
    shown = F.when(F.col("known"), F.concat(F.lit(" ("), cite, pin, F.lit(")"))).when(F.col("evidence_id").isNotNull(), f" {UNRESOLVED}").otherwise("")
    if calcs is not None:
        results = calcs.groupBy("section_id", "calc_id").agg(F.max(calc_text(F.col("claimed_result"), F.col("unit"))).alias("result"))
        cited = cited.join(results, ["section_id", "calc_id"], "left")
        shown = F.when(F.col("calc_id").isNotNull(), F.coalesce("result", F.lit("[calc unresolved]"))).otherwise(shown)
    else:
        shown = F.when(F.col("calc_id").isNotNull(), "[calc unresolved]").otherwise(shown)
    whole = cited.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("part", shown).alias("t")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return whole.select("section_id", F.regexp_replace(text, DEBRIS, UNRESOLVED).alias("rendered"))


def assemble(sections: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc_id and the article: its title (``titles``: doc_id, article_title), then sections (section_no, title,
    body) in order under headings."""
    part = F.struct("section_no", F.concat(F.lit("## "), "title", F.lit("\n\n"), "body").alias("t"))
    ordered = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    if titles is None:
        return ordered.select("doc_id", body.alias("article"))
    named = ordered.join(titles.select("doc_id", "article_title"), "doc_id", "left")
    return named.select("doc_id", F.concat(F.when(F.col("article_title").isNotNull(), F.concat(F.lit("# "), "article_title", F.lit("\n\n"))).otherwise(""), body).alias("article"))


def paren_spans(text: str) -> list[str]:
    """Balanced outermost bracketed stretches."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "(":
            if not depth:
                start = i
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


@pandas_udf(ArrayType(StringType()))
def paren_spans_col(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else paren_spans(t))


def voice_safe(before: Column, after: Column) -> Column:
    """Whether a rewriting keeps all outermost brackets and quotations of three characters or more."""
    quotes = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"[\"“]([^\"”]{3,})[\"”]"), F.lit(1)))
    brackets = lambda c: F.array_sort(paren_spans_col(c))
    return (quotes(before) == quotes(after)) & (brackets(before) == brackets(after))
