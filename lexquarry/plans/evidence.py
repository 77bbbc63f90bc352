"""Queries over evidence, citations, issues and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions import citations
from lexquarry.operators import coverage, grounding, planning
from lexquarry.plans.registry import query
from lexquarry.sources.tables import read_table


def _quotes(spark, d):
    return read_table(spark, d, "eval_item").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


@query(
    "ground_exact",
    """SELECT doc_id, item_id AS quote_id, strpos(d.text, i.text) - 1 AS start, strpos(d.text, i.text) - 1 + length(i.text) AS "end", substring(sha1(concat_ws(':', CAST(doc_id AS VARCHAR), i.text,
 CAST(strpos(d.text, i.text) - 1 AS VARCHAR), CAST(strpos(d.text, i.text) - 1 + length(i.text) AS VARCHAR))), 1, 16) AS evidence_id
FROM documents d JOIN eval_item i ON strpos(d.text, i.text) > 0""",
)
def _exact(spark, d):
    quotes = _quotes(spark, d)
    found = grounding.ground_exact(read_table(spark, d, "documents"), quotes).join(quotes, "quote_id")
    key = grounding.evidence_id(F.col("doc_id").cast("string"), F.col("quote"), F.col("start"), F.col("end"))
    return found.select("doc_id", "quote_id", "start", "end", key.alias("evidence_id"))


_SOFT = "regexp_replace(translate({0}, '‘’“”–—' || chr(160), chr(39) || chr(39) || '\"\"-- '), '\\s+', ' ', 'g')"


@query(
    "ground_normalized",
    f"SELECT doc_id, item_id AS quote_id FROM documents d JOIN eval_item i ON contains({_SOFT.format('d.text')}, {_SOFT.format('i.text')})",
)
def _normalised(spark, d):
    return grounding.ground_normalised(read_table(spark, d, "documents"), _quotes(spark, d))


@query("ground_ladder")
def _ladder(spark, d):
    rows = read_table(spark, d, "evidence").where("verbatim_quote is not null and statement is not null")
    claims = rows.select(F.col("ord").alias("claim_id"), F.col("verbatim_quote").alias("text"), F.col("statement").alias("quote"))
    return grounding.ground(claims)


@query(
    "quote_offsets",
    """SELECT ord, verbatim_quote IS NOT NULL AS has_quote, quote_end - quote_start AS span, length(verbatim_quote) AS size,
 (quote_end - quote_start) = length(verbatim_quote) AS consistent FROM evidence""",
)
def _offsets(spark, d):
    span = F.col("quote_end") - F.col("quote_start")
    size = F.length("verbatim_quote")
    rows = read_table(spark, d, "evidence")
    return rows.select("ord", F.col("verbatim_quote").isNotNull().alias("has_quote"), span.alias("span"), size.alias("size"), (span == size).alias("consistent"))


@query(
    "binding_strength",
    """WITH e AS (SELECT ord, kind, "grounding" AS level, verbatim_quote AS quote, authority_tier AS tier, coalesce(jurisdiction = 'IN', false) AS m FROM evidence),
b AS (SELECT *, CASE WHEN kind = 'commentary_opinion' THEN 'opinion' WHEN tier <= 2 THEN CASE WHEN m THEN 'binding' ELSE 'persuasive' END
  WHEN tier = 3 THEN CASE WHEN m THEN 'persuasive' ELSE 'informative' END ELSE 'informative' END AS strength FROM e)
SELECT ord, strength, CASE WHEN coalesce(kind, '') <> 'commentary_opinion' AND quote IS NULL THEN 'no_quote'
 WHEN coalesce(kind, '') <> 'commentary_opinion' AND coalesce(level, '') NOT IN ('exact', 'normalized') THEN 'not_verbatim' END AS broken FROM b""",
)
def _binding(spark, d):
    match = F.coalesce(F.col("jurisdiction") == "IN", F.lit(False))
    kind, level = F.coalesce("kind", F.lit("")), F.coalesce("grounding", F.lit(""))
    strength = grounding.binding_strength(F.col("kind"), F.col("authority_tier"), match)
    broken = grounding.broken_rule(kind, level, F.col("verbatim_quote"), strength, F.col("authority_tier"), match, F.lit(True))
    return read_table(spark, d, "evidence").select("ord", strength.alias("strength"), broken.alias("broken"))


@query(
    "grounding_counts",
    """SELECT run_id, "grounding" AS level, count(*) AS n, CAST(round(1000.0 * count(*) / sum(count(*)) OVER (PARTITION BY run_id)) AS BIGINT) AS rate_1000
FROM evidence GROUP BY run_id, "grounding" """,
)
def _levels(spark, d):
    rows = read_table(spark, d, "evidence").groupBy("run_id", F.col("grounding").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("run_id").agg(F.sum("n").alias("total"))
    return rows.join(total, "run_id").select("run_id", "level", "n", F.round(1000 * F.col("n") / F.col("total")).cast("long").alias("rate_1000"))


# The citation patterns and court codes, written once more for DuckDB.
_RX = {
    "neutral_sc": r"(\d{4})\s+INSC\s+(\d+)",
    "neutral_hc": r"(\d{4}):([A-Z]{2,6}):(\d+)",
    "scc": r"\((\d{4})\)\s+(\d+)\s+SCC\s+(\d+)",
    "air": r"AIR\s+(\d{4})\s+(SC|[A-Z][a-z]+)\s+(\d+)",
    "scc_online": r"(\d{4})\s+SCC\s+OnLine\s+([A-Za-z]+)\s+(\d+)",
    "case_number": r"(Civil|Criminal|Special\s+Leave|Writ)\s+(Appeal|Petition|Application)\s+No\.?\s*(\d+)\s+of\s+(\d{4})",
    "writ": r"W\.?P\.?\s*\((C|Crl)\)\s*No\.?\s*(\d+)\s*of\s*(\d{4})",
    "statute": r"[Ss]ection\s+(\d+[A-Z]{0,2}(?:\(\w+\))*)\s+of\s+(?:the\s+)?([A-Z][\w\s,.]+?,\s*\d{4})",
    "sebi": r"SEBI/HO/[A-Z0-9/\-]+/(\d{4})/(\d+)",
    "rbi": r"RBI/(\d{4}-\d{2})/(\d+)",
}


def _ex(name: str, group: int) -> str:
    return f"regexp_extract(raw, '{_RX[name]}', {group})"


def _courts(code: str) -> str:
    return f"""CASE {code} WHEN 'SC' THEN 'Supreme Court of India' WHEN 'DHC' THEN 'Delhi High Court' WHEN 'Del' THEN 'Delhi High Court' WHEN 'BHC' THEN 'Bombay High Court' WHEN 'Bom' THEN 'Bombay High Court'
 WHEN 'MHC' THEN 'Madras High Court' WHEN 'Mad' THEN 'Madras High Court' WHEN 'Cal' THEN 'Calcutta High Court' WHEN 'KHC' THEN 'Karnataka High Court' WHEN 'Kar' THEN 'Karnataka High Court'
 WHEN 'AHC' THEN 'Allahabad High Court' WHEN 'All' THEN 'Allahabad High Court' WHEN 'APHC' THEN 'Andhra Pradesh High Court' WHEN 'TSHC' THEN 'Telangana High Court' WHEN 'KER' THEN 'Kerala High Court'
 WHEN 'Ker' THEN 'Kerala High Court' WHEN 'GHC' THEN 'Gujarat High Court' WHEN 'Guj' THEN 'Gujarat High Court' WHEN 'PHC' THEN 'Punjab and Haryana High Court' END"""


@query(
    "citation_parse",
    "WITH p AS (SELECT citation_no, raw, CASE " + " ".join(f"WHEN regexp_matches(raw, '{r}') THEN '{n}'" for n, r in _RX.items()) + " END AS pattern FROM legal_citation) "
    "SELECT citation_no, pattern, CASE WHEN pattern = 'statute' THEN 'statute' WHEN pattern IN ('sebi', 'rbi') THEN 'circular' WHEN pattern IS NOT NULL THEN 'case' ELSE 'other' END AS kind, "
    f"CASE pattern WHEN 'neutral_sc' THEN {_ex('neutral_sc', 1)} || ' INSC ' || {_ex('neutral_sc', 2)} WHEN 'neutral_hc' THEN {_ex('neutral_hc', 1)} || ':' || {_ex('neutral_hc', 2)} || ':' || {_ex('neutral_hc', 3)} END AS neutral, "
    f"CASE pattern WHEN 'scc' THEN '(' || {_ex('scc', 1)} || ') ' || {_ex('scc', 2)} || ' SCC ' || {_ex('scc', 3)} WHEN 'air' THEN 'AIR ' || {_ex('air', 1)} || ' ' || {_ex('air', 2)} || ' ' || {_ex('air', 3)} END AS reporter, "
    f"CASE pattern WHEN 'scc_online' THEN {_ex('scc_online', 1)} || ' SCC OnLine ' || {_ex('scc_online', 2)} || ' ' || {_ex('scc_online', 3)} END AS scc_online, "
    f"CASE pattern WHEN 'case_number' THEN {_ex('case_number', 1)} || ' ' || {_ex('case_number', 2)} || ' No. ' || {_ex('case_number', 3)} || ' of ' || {_ex('case_number', 4)} "
    f"WHEN 'writ' THEN 'W.P.(' || {_ex('writ', 1)} || ') No. ' || {_ex('writ', 2)} || ' of ' || {_ex('writ', 3)} END AS case_number, "
    f"CASE pattern WHEN 'neutral_sc' THEN 'Supreme Court of India' WHEN 'scc' THEN 'Supreme Court of India' WHEN 'neutral_hc' THEN {_courts(_ex('neutral_hc', 2))} WHEN 'air' THEN {_courts(_ex('air', 2))} "
    f"WHEN 'scc_online' THEN {_courts(_ex('scc_online', 2))} END AS court, CASE pattern WHEN 'statute' THEN {_ex('statute', 1)} END AS section, "
    f"CASE pattern WHEN 'statute' THEN trim(regexp_replace({_ex('statute', 2)}, ',\\s*\\d{{4}}$', '')) END AS act_name, CASE pattern WHEN 'statute' THEN CAST(regexp_extract({_ex('statute', 2)}, '(\\d{{4}})$', 1) AS INTEGER) END AS act_year, "
    f"CASE pattern WHEN 'sebi' THEN raw WHEN 'rbi' THEN 'RBI/' || {_ex('rbi', 1)} || '/' || {_ex('rbi', 2)} END AS circular FROM p",
)
def _parse(spark, d):
    rows = read_table(spark, d, "legal_citation").select("citation_no", citations.parse_citation(F.col("raw")).alias("c"))
    return rows.select("citation_no", *[f"c.{f}" for f in ("pattern", "kind", "neutral", "reporter", "scc_online", "case_number", "court", "section", "act_name", "act_year", "circular")])


@query(
    "citation_render",
    """WITH p AS (SELECT citation_no, raw, CASE kind
 WHEN 'case' THEN concat_ws(', ', nullif(trim(case_name), ''), nullif(trim(coalesce(nullif(neutral_citation, ''), nullif(reporter_citation, ''), nullif(scc_online, ''))), ''), nullif(trim(court), ''))
 WHEN 'statute' THEN concat_ws(', ', nullif(trim(act_name), ''), CAST(act_year AS VARCHAR), 's. ' || nullif(section, ''))
 WHEN 'circular' THEN concat_ws(', ', nullif(trim(circular_number), ''), CAST(issued_on AS VARCHAR)) ELSE '' END AS t FROM legal_citation)
SELECT citation_no, coalesce(nullif(t, ''), raw, '') AS rendered FROM p""",
)
def _render(spark, d):
    return read_table(spark, d, "legal_citation").select("citation_no", citations.render_citation(F.col).alias("rendered"))


# Every fifth raw citation is doubled with another reporter, so that strings that hold several occur.
_JAMMED = "CASE WHEN citation_no % 5 = 0 THEN coalesce(raw, '') || ' 1987 SCC (2) 41 JT 1987 (1) 9' WHEN citation_no % 5 = 1 THEN coalesce(raw, '') || ' AIR 1987 SC 77 . . .' ELSE raw END"


@query(
    "citation_tidy",
    rf"""WITH a AS (SELECT citation_no, trim(coalesce({_JAMMED}, '')) AS r FROM legal_citation),
b AS (SELECT citation_no, r, CASE WHEN regexp_matches(r, '\(\d{{4}}\)\s*\d+\s*SCC\s*\d+') THEN regexp_extract(r, '\(\d{{4}}\)\s*\d+\s*SCC\s*\d+') WHEN regexp_matches(r, '\d{{4}}\s*SCC\s*\(\d+\)\s*\d+') THEN regexp_extract(r, '\d{{4}}\s*SCC\s*\(\d+\)\s*\d+')
 WHEN regexp_matches(r, '\d{{4}}\s*\(\d+\)\s*S\.?\s?C\.?\s?C\.?\s*\d+') THEN regexp_extract(r, '\d{{4}}\s*\(\d+\)\s*S\.?\s?C\.?\s?C\.?\s*\d+') WHEN regexp_matches(r, '\d{{4}}\s*SCC\s*OnLine\s*\w+\s*\d+') THEN regexp_extract(r, '\d{{4}}\s*SCC\s*OnLine\s*\w+\s*\d+')
 WHEN regexp_matches(r, '\d{{4}}\s*INSC\s*\d+') THEN regexp_extract(r, '\d{{4}}\s*INSC\s*\d+') WHEN regexp_matches(r, 'AIR\s*\d{{4}}\s*[A-Z]{{2,4}}\s*\d+') THEN regexp_extract(r, 'AIR\s*\d{{4}}\s*[A-Z]{{2,4}}\s*\d+')
 WHEN regexp_matches(r, '\d{{4}}\s*AIR\s*\d+') THEN regexp_extract(r, '\d{{4}}\s*AIR\s*\d+') END AS best,
 trim(regexp_replace(regexp_replace(r, '\s*(\.\s*\.\s*\.|…)\s*$', ''), '(?i)\s+vs\.?\s+', ' v ', 'g'), ' ,;') AS plain FROM a)
SELECT citation_no, CASE WHEN regexp_matches(r, '(SCC|AIR|SCR|SCALE|JT)\b.*\b(SCC|AIR|SCR|SCALE|JT)\b') THEN coalesce(best, plain) ELSE plain END AS tidy FROM b""",
)
def _tidy(spark, d):
    return read_table(spark, d, "legal_citation").withColumn("raw", F.expr(_JAMMED)).select("citation_no", citations.tidy_citation(F.col("raw")).alias("tidy"))


def _issues(spark, d):
    """Issues 1 to 8 of every run of the evidence."""
    runs = read_table(spark, d, "evidence").select("run_id").where("run_id is not null").distinct()
    return runs.select("run_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("issue_no"))


@query(
    "coverage",
    """WITH r AS (SELECT DISTINCT run_id FROM evidence WHERE run_id IS NOT NULL), i AS (SELECT run_id, unnest(range(1, 9)) AS issue_no FROM r),
c AS (SELECT run_id, TRY_CAST(s AS INTEGER) AS issue_no, count(*) AS n FROM (SELECT run_id, unnest(list_distinct(supports_issues)) AS s FROM evidence) GROUP BY 1, 2)
SELECT i.run_id, CAST(i.issue_no AS INTEGER) AS issue_no, coalesce(n, 0) AS n FROM i LEFT JOIN c ON i.run_id = c.run_id AND i.issue_no = c.issue_no""",
)
def _coverage(spark, d):
    return coverage.coverage(read_table(spark, d, "evidence"), _issues(spark, d))


@query("tier_histogram", "SELECT run_id, authority_tier, count(*) AS n FROM evidence GROUP BY ALL")
def _tiers(spark, d):
    return coverage.histogram(read_table(spark, d, "evidence"), "run_id", "authority_tier")


@query(
    "summaries",
    """SELECT kind, binding_strength, "grounding" AS level, grouping(binding_strength, kind, "grounding") AS g, count(*) AS n
FROM evidence GROUP BY GROUPING SETS ((kind), (binding_strength), ("grounding"))""",
)
def _summaries(spark, d):
    rows = read_table(spark, d, "evidence").withColumnRenamed("grounding", "level")
    return coverage.summaries(rows, [["kind"], ["binding_strength"], ["level"]]).select("kind", "binding_strength", "level", F.col("grouping").alias("g"), "n")


@query(
    "round_comparison",
    """WITH a AS (SELECT run_id, gap_kind, count(*) AS n FROM gap_item WHERE loop_index = 0 GROUP BY ALL), b AS (SELECT run_id, gap_kind, count(*) AS n FROM gap_item WHERE loop_index = 1 GROUP BY ALL)
SELECT run_id, gap_kind, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after FROM a FULL JOIN b USING (run_id, gap_kind)""",
)
def _rounds(spark, d):
    rows = read_table(spark, d, "gap_item").where("run_id is not null and gap_kind is not null")
    before, after = (coverage.histogram(rows.where(F.col("loop_index") == i), "run_id", "gap_kind") for i in (0, 1))
    return coverage.compare_rounds(before, after, ["run_id", "gap_kind"])


@query(
    "gap_changes",
    """WITH a AS (SELECT DISTINCT run_id, gap_kind FROM gap_item WHERE loop_index = 0), b AS (SELECT DISTINCT run_id, gap_kind FROM gap_item WHERE loop_index = 1)
SELECT run_id, gap_kind, 'closed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT run_id, gap_kind, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT run_id, gap_kind, 'open' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
)
def _changes(spark, d):
    rows = read_table(spark, d, "gap_item").where("run_id is not null and gap_kind is not null")
    return coverage.changes_of_rounds(*(rows.where(F.col("loop_index") == i) for i in (0, 1)), ["run_id", "gap_kind"])


@query(
    "uncovered_issues",
    """WITH r AS (SELECT DISTINCT run_id FROM evidence WHERE run_id IS NOT NULL), i AS (SELECT run_id, unnest(range(1, 9)) AS issue_no FROM r)
SELECT run_id, CAST(issue_no AS INTEGER) AS issue_no FROM i WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.run_id = i.run_id AND list_contains(e.supports_issues, CAST(i.issue_no AS VARCHAR)))""",
)
def _uncovered(spark, d):
    covered = coverage.coverage(read_table(spark, d, "evidence"), _issues(spark, d))
    return covered.where("n = 0").select("run_id", "issue_no")


# No query text of the test tables has a compatibility form.
_NORM = r"regexp_replace(regexp_replace(trim(lower(query_text), ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g'), '[^\p{L}\p{N}\p{M}_\s]', '', 'g')"


@query(
    "query_identity",
    f"SELECT DISTINCT query_id, run_id, substring(sha1(concat_ws(':', {_NORM}, intent)), 1, 16) AS key FROM sub_query",
)
def _identity(spark, d):
    return read_table(spark, d, "sub_query").select("query_id", "run_id", planning.query_key(F.col("query_text"), F.col("intent")).alias("key")).distinct()


@query(
    "query_plan_clamp",
    """WITH f AS (SELECT query_id, run_id, min(priority) AS priority FROM sub_query GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority NULLS FIRST, query_id) AS n FROM f) SELECT query_id, run_id, n FROM n WHERE n <= 12""",
)
def _clamp(spark, d):
    rows = read_table(spark, d, "sub_query").groupBy("query_id", "run_id").agg(F.min("priority").alias("priority"))
    return planning.clamp(rows).select("query_id", "run_id", "n")


@query(
    "open_pairs",
    """WITH p AS (SELECT DISTINCT run_id, query_id, unnest(providers) AS provider FROM sub_query)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM raw_result r WHERE r.run_id = p.run_id AND r.query_id = p.query_id AND r.provider = p.provider)""",
)
def _open(spark, d):
    executed = read_table(spark, d, "raw_result").select("run_id", "query_id", "provider").distinct()
    return planning.open_pairs(read_table(spark, d, "sub_query"), executed)


@query(
    "pair_results",
    """WITH p AS (SELECT DISTINCT run_id, query_id, unnest(providers) AS provider FROM sub_query), c AS (SELECT run_id, query_id, provider, count(*) AS n FROM raw_result GROUP BY ALL)
SELECT p.run_id, p.query_id, p.provider, coalesce(c.n, 0) AS n FROM p LEFT JOIN c USING (run_id, query_id, provider)""",
)
def _pairs(spark, d):
    planned = read_table(spark, d, "sub_query").select("run_id", "query_id", F.explode("providers").alias("provider")).distinct()
    counts = read_table(spark, d, "raw_result").groupBy("run_id", "query_id", "provider").agg(F.count(F.lit(1)).alias("n"))
    return planned.join(counts, ["run_id", "query_id", "provider"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "provider_routing",
    """SELECT DISTINCT intent, CASE intent WHEN 'statute_text' THEN 'indiacode,tavily,serpapi' WHEN 'case_law' THEN 'indiankanoon,tavily,serpapi' WHEN 'related_precedent' THEN 'indiankanoon,serpapi'
 WHEN 'recent_development' THEN 'tavily,serpapi' WHEN 'regulatory_action' THEN 'tavily,serpapi' WHEN 'academic_commentary' THEN 'semantic_scholar,tavily,serpapi' WHEN 'counter_view' THEN 'tavily,serpapi'
 WHEN 'comparative' THEN 'tavily,serpapi' WHEN 'background' THEN 'tavily,serpapi' ELSE 'indiacode,indiankanoon,semantic_scholar,serpapi,tavily' END AS providers FROM sub_query""",
)
def _routing(spark, d):
    available = ["indiacode", "indiankanoon", "semantic_scholar", "serpapi", "tavily"]
    return read_table(spark, d, "sub_query").select("intent").distinct().withColumn("providers", F.array_join(planning.route(F.col("intent"), available), ","))


@query("stable_issues")
def _stable(spark, d):
    rows = planning.first_of_key(read_table(spark, d, "gap_item").where("issue is not null"), ["run_id", "loop_index", "issue"], [F.col("gap_no")])
    rows = rows.select("run_id", "loop_index", F.col("gap_no").alias("pos"), "issue")
    return planning.stable_issues(rows.where("loop_index = 0").drop("loop_index"), rows.where("loop_index = 1").drop("loop_index"))


@query(
    "date_formats",
    """SELECT ord, coalesce(CAST(try_strptime(t, '%Y-%m-%d') AS DATE), CAST(try_strptime(t, '%d %B %Y') AS DATE), CAST(try_strptime(t, '%d.%m.%Y') AS DATE)) AS parsed
FROM (SELECT ord, CASE ord % 4 WHEN 0 THEN strftime(published_at, '%Y-%m-%d') WHEN 1 THEN strftime(published_at, '%d %B %Y') WHEN 2 THEN strftime(published_at, '%d.%m.%Y') ELSE 'soon' END AS t FROM raw_result)""",
)
def _dates(spark, d):
    o = F.col("ord") % 4
    written = F.when(o == 0, F.date_format("published_at", "yyyy-MM-dd")).when(o == 1, F.date_format("published_at", "dd MMMM yyyy")).when(o == 2, F.date_format("published_at", "dd.MM.yyyy")).otherwise("soon")
    return read_table(spark, d, "raw_result").select("ord", planning.parse_date(written, "yyyy-MM-dd", "dd MMMM yyyy", "dd.MM.yyyy").alias("parsed"))
