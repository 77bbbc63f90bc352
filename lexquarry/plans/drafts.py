"""Queries over drafts: documents of kind draft carry markers; their paragraphs are the sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions.similarity import partial_ratio_col
from lexquarry.operators import drafting as D
from lexquarry.plans.registry import query
from lexquarry.sources.tables import read_table

_SECTIONS = r"""s AS (SELECT doc_id, unnest(range(len(p))) AS section_no, unnest(p) AS body FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE doc_kind = 'draft' AND text IS NOT NULL)),
b AS (SELECT doc_id || '-' || section_no AS section_id, doc_id, CAST(section_no AS INTEGER) AS section_no, body FROM s)"""


def _sections(spark, d):
    drafts = read_table(spark, d, "documents").where("doc_kind = 'draft' and text is not null")
    parts = drafts.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("section_no", "body"))
    return parts.select(F.concat_ws("-", "doc_id", "section_no").alias("section_id"), "doc_id", "section_no", "body")


@query(
    "markers",
    f"WITH {_SECTIONS}, m AS (SELECT section_id, regexp_extract_all(body, '\\[\\[ev:([a-zA-Z0-9_-]+)\\]\\]', 1) AS ids FROM b) "
    "SELECT section_id, CAST(unnest(range(len(ids))) AS INTEGER) AS pos, unnest(ids) AS evidence_id FROM m",
)
def _markers(spark, d):
    return D.markers(_sections(spark, d))


# Every third section gets markers that are run together.
_BROKEN = """body || CASE WHEN section_no % 3 = 0 THEN ' [[ev:aa1], [ev:bb2]] [[ev:cc3]] ev:cc3 ev:aa1' ELSE '' END"""


@query(
    "malformed_markers",
    f"""WITH {_SECTIONS}, h AS (SELECT section_id, {_BROKEN} AS body FROM b), l AS (SELECT section_id, unnest(regexp_extract_all(body, 'ev:([a-zA-Z0-9_-]+)', 1)) AS token FROM h),
t AS (SELECT section_id, unnest(regexp_extract_all(body, '\\[\\[ev:([a-zA-Z0-9_-]+)\\]\\]', 1)) AS token FROM h),
x AS (SELECT * FROM l EXCEPT ALL SELECT * FROM t) SELECT section_id, token, count(*) AS n FROM x GROUP BY ALL""",
)
def _malformed(spark, d):
    return D.malformed(_sections(spark, d).withColumn("body", F.expr(_BROKEN)))


@query(
    "marker_verify",
    f"""WITH {_SECTIONS}, m AS (SELECT section_id, doc_id, section_no, regexp_extract_all(body, '\\[\\[ev:([a-zA-Z0-9_-]+)\\]\\]', 1) AS ids FROM b),
k AS (SELECT section_id, section_no, CAST(unnest(range(len(ids))) AS INTEGER) AS pos, unnest(ids) AS evidence_id FROM m)
SELECT section_id, pos, evidence_id, CASE WHEN evidence_id[1] >= '8' AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.evidence_id = k.evidence_id) THEN 'unresolved'
 WHEN (section_no + pos) % 3 = 0 THEN 'out_of_scope' ELSE 'ok' END AS status FROM k""",
)
def _verify(spark, d):
    sections = _sections(spark, d)
    marks = D.markers(sections)
    # What each section was offered: every marker but each third.
    numbered = marks.join(sections.select("section_id", "section_no"), "section_id")
    offered = numbered.where("(section_no + pos) % 3 <> 0").select("section_id", "pos", "evidence_id")
    # Drafts name evidence of other tables; ids up to 7... are taken to be known.
    known = read_table(spark, d, "evidence").select("evidence_id").union(marks.where("substring(evidence_id, 1, 1) < '8'").select("evidence_id"))
    status = D.marker_status(marks, offered.select("section_id", "evidence_id"), known)
    # An id offered at one place of a section is offered at all of them.
    return status.join(offered.select("section_id", "pos", F.lit(True).alias("here")), ["section_id", "pos"], "left").select(
        "section_id", "pos", "evidence_id", F.when((F.col("status") == "ok") & F.col("here").isNull(), "out_of_scope").otherwise(F.col("status")).alias("status")
    )


@query(
    "established_first",
    f"""WITH {_SECTIONS}, m AS (SELECT doc_id, section_no, unnest(regexp_extract_all(body, '\\[\\[ev:([a-zA-Z0-9_-]+)\\]\\]', 1)) AS evidence_id FROM b),
f AS (SELECT doc_id, evidence_id, min(section_no) AS first_no FROM m GROUP BY ALL), t AS (SELECT DISTINCT doc_id, section_no FROM m)
SELECT t.doc_id, t.section_no, f.evidence_id FROM t JOIN f ON t.doc_id = f.doc_id AND f.first_no < t.section_no""",
)
def _established(spark, d):
    sections = _sections(spark, d)
    cited = D.markers(sections).join(sections.select("section_id", "doc_id", "section_no"), "section_id")
    return D.first_established(cited.select("doc_id", "section_no", "evidence_id"))


# Every third section gets a hedging phrase, each of the four in turn, as drafts of the test tables hold none.
_HEDGED = """body || CASE section_no % 12 WHEN 0 THEN ' On balance, it stands; on balance it must.' WHEN 3 THEN ' A compelling argument can be made.' WHEN 6 THEN ' This is the better view.' WHEN 9 THEN ' It may not have been accurate.' ELSE '' END"""


@query(
    "hedge_running",
    f"""WITH {_SECTIONS}, h AS (SELECT doc_id, section_no, lower({_HEDGED}) AS t FROM b),
c AS (SELECT doc_id, section_no, (length(t) - length(replace(t, 'a compelling argument can be made', ''))) // 33 + (length(t) - length(replace(t, 'on balance', ''))) // 10
 + (length(t) - length(replace(t, 'the better view', ''))) // 15 + (length(t) - length(replace(t, 'may not have been accurate', ''))) // 26 AS own FROM h)
SELECT doc_id, section_no, own, coalesce(sum(own) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "before" FROM c""",
)
def _hedges(spark, d):
    return D.running_hedges(_sections(spark, d).withColumn("body", F.expr(_HEDGED)))


_METHODS = ["sum", "difference", "ratio", "delta_pct", "cagr"]


@query(
    "calc_check",
    """WITH c AS (SELECT event_id, ['sum', 'difference', 'ratio', 'delta_pct', 'cagr'][event_id % 5 + 1] AS method, value AS a, CASE WHEN event_id % 11 = 0 THEN 0 ELSE value * 1.5 - 3 END AS b,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 4 + 1 END AS periods FROM events),
k AS (SELECT *, CASE method WHEN 'sum' THEN a + b WHEN 'difference' THEN a - b WHEN 'ratio' THEN a / nullif(b, 0) WHEN 'delta_pct' THEN (b - a) * 100 / nullif(a, 0)
  WHEN 'cagr' THEN CASE WHEN a > 0 AND b >= 0 AND periods > 0 THEN (power(b / a, 1.0 / periods) - 1) * 100 END END AS computed FROM c)
SELECT event_id, method, CAST(round(computed * 100) AS BIGINT) AS computed_100, abs(computed - a) <= greatest(abs(computed) * 0.01, 0.05) AS matches FROM k""",
)
def _calc(spark, d):
    e = F.col("event_id")
    method = F.element_at(F.array(*[F.lit(m) for m in _METHODS]), (e % 5 + 1).cast("int"))
    a, b = F.col("value"), F.when(e % 11 == 0, 0.0).otherwise(F.col("value") * 1.5 - 3)
    computed = D.recompute(method, F.array(a, b), F.when(e % 7 != 0, e % 4 + 1))
    rows = read_table(spark, d, "events").select("event_id", method.alias("method"), "value", computed.alias("computed"))
    return rows.select("event_id", "method", F.round(F.col("computed") * 100).cast("long").alias("computed_100"), D.calc_matches(F.col("computed"), F.col("value")).alias("matches"))


@query(
    "quote_check",
    """WITH q AS (SELECT ord, statement, verbatim_quote FROM evidence WHERE verbatim_quote IS NOT NULL AND statement IS NOT NULL),
p AS (SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(lower(statement), '[-–—]', ' ', 'g'), '[^\\p{L}\\p{N}\\p{M}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS s,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(verbatim_quote), '[-–—]', ' ', 'g'), '[^\\p{L}\\p{N}\\p{M}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS v FROM q)
SELECT ord, contains(v, s) OR contains(s, v) AS clean FROM p""",
)
def _quotes(spark, d):
    rows = read_table(spark, d, "evidence").where("verbatim_quote is not null and statement is not null")
    s, v = D.plain_quote(F.col("statement")), D.plain_quote(F.col("verbatim_quote"))
    return rows.select("ord", (F.contains(v, s) | F.contains(s, v)).alias("clean"))


@query("quote_similarity")
def _similar(spark, d):
    rows = read_table(spark, d, "evidence_candidate").where("statement is not null and verbatim_quote is not null")
    return rows.select("candidate_no", F.round(partial_ratio_col("statement", "verbatim_quote"), 6).alias("score"))


# Every fourth section cites a calculation of its own, every eighth also one that it lacks and a broken marker.
_CITED = """body || CASE WHEN section_no % 4 = 0 THEN ' [[calc:c1]]' ELSE '' END || CASE WHEN section_no % 8 = 0 THEN ' [[calc:none]] [[ev:aa1], [ev:bb2]]' ELSE '' END"""


@query(
    "render",
    f"""WITH {_SECTIONS}, e AS (SELECT section_id, section_no, {_CITED} AS body FROM b), c AS (SELECT evidence_id, arg_max(pinpoint, ord) AS pin FROM evidence GROUP BY evidence_id),
t AS (SELECT section_id, section_no, unnest(range(len(x))) AS pos, unnest(x) AS part, ids FROM (SELECT section_id, section_no,
  regexp_split_to_array(body, '\\[\\[(?:ev|calc):[a-zA-Z0-9_-]+\\]\\]') AS x, regexp_extract_all(body, '\\[\\[((?:ev|calc):[a-zA-Z0-9_-]+)\\]\\]', 1) AS ids FROM e)),
r AS (SELECT section_id, pos, part || CASE WHEN ids[pos + 1] IS NULL THEN '' WHEN ids[pos + 1] = 'calc:c1' THEN CASE section_no % 3 WHEN 0 THEN '12.5%' WHEN 1 THEN '3%' ELSE '0.25%' END
  WHEN starts_with(ids[pos + 1], 'calc:') THEN '[calc unresolved]' WHEN c.evidence_id IS NULL THEN ' [citation unresolved]'
  WHEN c.evidence_id[1] = 'a' THEN ' ([citation unresolved]' || coalesce(', ' || nullif(pin, ''), '') || ')' ELSE ' (Cited ' || c.evidence_id[:4] || coalesce(', ' || nullif(pin, ''), '') || ')' END AS piece
 FROM t LEFT JOIN c ON c.evidence_id = substring(ids[pos + 1], 4) AND starts_with(ids[pos + 1], 'ev:')),
w AS (SELECT section_id, string_agg(piece, '' ORDER BY pos) AS body FROM r GROUP BY section_id)
SELECT section_id, regexp_replace(body, '\\[*ev:[a-zA-Z0-9_-]+\\]*(?:,\\s*\\[*ev:[a-zA-Z0-9_-]+\\]*)*', '[citation unresolved]', 'g') AS rendered FROM w""",
)
def _render(spark, d):
    last = read_table(spark, d, "evidence").groupBy("evidence_id").agg(F.max_by("pinpoint", "ord").alias("pinpoint"))
    cited = last.withColumn("citation", F.when(F.col("evidence_id").startswith("a"), "").otherwise(F.concat(F.lit("Cited "), F.substring("evidence_id", 1, 4))))
    sections = _sections(spark, d).withColumn("body", F.expr(_CITED))
    result = F.when(F.col("section_no") % 3 == 0, 12.5).when(F.col("section_no") % 3 == 1, 3.0).otherwise(0.25)
    calcs = sections.select("section_id", F.lit("c1").alias("calc_id"), result.alias("claimed_result"), F.lit("%").alias("unit"))
    return D.render(sections, cited, calcs)


@query(
    "assemble",
    f"""WITH {_SECTIONS} SELECT doc_id, '# Draft ' || doc_id || chr(10) || chr(10) || string_agg('## ' || 'Part ' || section_no || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY section_no) AS article FROM b GROUP BY doc_id""",
)
def _assemble(spark, d):
    sections = _sections(spark, d)
    titles = sections.select("doc_id", F.concat(F.lit("Draft "), F.col("doc_id").cast("string")).alias("article_title")).distinct()
    return D.assemble(sections.withColumn("title", F.concat(F.lit("Part "), F.col("section_no").cast("string"))), titles)


@query("paren_spans")
def _spans(spark, d):
    return _sections(spark, d).select("section_id", F.posexplode(D.paren_spans_col("body")).alias("pos", "span"))


@query("voice_sections")
def _voice_sections(spark, d):
    return _sections(spark, d).select("section_id", D.voice_safe(F.col("body"), F.lower("body")).alias("safe"))


@query("quote_verify")
def _quote_verify(spark, d):
    """Every quotation before a marker against the quote of its evidence."""
    return D.verify_quotes(D.quoted_claims(_sections(spark, d)), read_table(spark, d, "evidence"))
