"""Queries over the texts of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators import passages
from lexquarry.plans.registry import query
from lexquarry.sources.tables import read_table

ISSUES = ["cess", "covenant", "escrow", "tariff", "mortgage", "subsidy"]


# The characters of the test tables that have a compatibility form, with it.
_FORMS = {"º": "o", "…": "...", "\u00a0": " ", "ﷺ": "صلى الله عليه وسلم", "²": "2", "½": "1⁄2", "™": "TM", "ﬂ": "fl", "№": "No"}


def _nfkc_sql(column: str) -> str:
    for char, form in _FORMS.items():
        column = f"replace({column}, '{char}', '{form}')"
    return f"nfc_normalize({column})"


@query(
    "normalize_text",
    rf"""WITH z AS (SELECT doc_id, {_nfkc_sql("text")} AS text FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}\p{{M}}_])-\n([\p{{L}}\p{{N}}\p{{M}}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g') AS t FROM z),
b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))),
  lambda x: NOT regexp_matches(x, '(?i)^(?:page +)?[0-9]+ *(?:of +[0-9]+)?$')) AS lines FROM a),
c AS (SELECT doc_id, trim(regexp_replace(array_to_string(lines, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11)) AS norm FROM b)
SELECT doc_id, norm, sha256(norm) AS content_hash FROM c""",
)
def _normalize(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", T.normalise_text(F.col("text")).alias("norm"))
    return docs.withColumn("content_hash", T.content_hash(F.col("norm")))


@query("nfkc_text", f"SELECT doc_id, {_nfkc_sql('text')} AS norm FROM documents")
def _nfkc(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.nfkc(F.col("text")).alias("norm"))


@query(
    "content_dedup",
    "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def _dedup(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null").groupBy(T.content_hash(F.col("text")).alias("content_hash"))
    return docs.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


# Windows of 2000 characters, cut after the last line end or full stop of their second half.
_PASSAGES = """RECURSIVE d AS (SELECT doc_id, text, replace(text, chr(13), 'r') AS flat, length(text) AS n FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, -1 AS span_no, CAST(-1 AS BIGINT) AS "start", CAST(0 AS BIGINT) AS "end" FROM d
 UNION ALL SELECT doc_id, span_no + 1, "end", CASE WHEN "end" + 2000 >= n THEN n WHEN a1 OR a2 THEN "end" + 2001 - least(CASE WHEN a1 THEN l1 ELSE 9999 END, CASE WHEN a2 THEN l2 ELSE 9999 END) ELSE "end" + 2000 END
 FROM (SELECT *, l1 > 0 AND l1 <= 1000 AS a1, l2 > 0 AND l2 <= 999 AS a2 FROM (SELECT *, strpos(w, chr(10)) AS l1, strpos(w, ' .') AS l2
  FROM (SELECT p.*, d.n, reverse(substring(flat, p."end" + 1, 2000)) AS w FROM p JOIN d ON p.doc_id = d.doc_id AND p."end" < d.n))))"""


@query(
    "passages",
    f"""WITH {_PASSAGES} SELECT p.doc_id, CAST(span_no AS INTEGER) AS span_no, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", sha1(substring(text, "start" + 1, "end" - "start")) AS hash
FROM p JOIN d ON p.doc_id = d.doc_id WHERE span_no >= 0""",
)
def _passages(spark, d):
    spans = T.spans_of(read_table(spark, d, "documents"), "doc_id", "text", T.cut_passages, 2000)
    return spans.select("doc_id", "span_no", "start", "end", F.sha1("span").alias("hash"))


@query(
    "passages_lossless",
    "SELECT doc_id, sha256(text) AS hash FROM documents WHERE length(text) > 0",
)
def _lossless(spark, d):
    spans = T.spans_of(read_table(spark, d, "documents"), "doc_id", "text", T.cut_passages, 2000)
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "span_no", "span")))
    return spans.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["span"]), ""), 256).alias("hash"))


@query(
    "chunks",
    """WITH RECURSIVE d AS (SELECT doc_id, text, replace(text, chr(13), 'r') AS flat, length(text) AS n FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, -1 AS span_no, CAST(-1 AS BIGINT) AS "start", CAST(0 AS BIGINT) AS "end", CAST(0 AS BIGINT) AS next FROM d
 UNION ALL SELECT doc_id, span_no + 1, next, stop, greatest(stop - 100, next + 1) FROM (SELECT *, CASE WHEN next + 2000 >= n THEN n WHEN l1 > 0 AND l1 < 799 THEN next + 2001 - l1 WHEN l2 > 0 AND l2 < 800 THEN next + 2001 - l2
   WHEN l3 > 0 AND l3 < 799 THEN next + 2001 - l3 ELSE next + 2000 END AS stop
  FROM (SELECT *, strpos(tail, chr(10) || chr(10)) AS l1, strpos(tail, chr(10)) AS l2, strpos(tail, ' .') AS l3
   FROM (SELECT p.*, d.n, reverse(substring(flat, p.next + 1201, 800)) AS tail FROM p JOIN d ON p.doc_id = d.doc_id AND (p."end" < d.n)))))
SELECT p.doc_id, CAST(span_no AS INTEGER) AS span_no, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", sha1(substring(text, "start" + 1, "end" - "start")) AS hash
FROM p JOIN d ON p.doc_id = d.doc_id WHERE span_no >= 0""",
)
def _chunks(spark, d):
    spans = T.spans_of(read_table(spark, d, "documents"), "doc_id", "text", T.cut_chunks, 2000, 100)
    return spans.select("doc_id", "span_no", "start", "end", F.sha1("span").alias("hash"))


@query(
    "full_or_digest",
    """WITH RECURSIVE d AS (SELECT doc_id, text, replace(text, chr(13), 'r') AS flat, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 3 END AS passes FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS "end", CAST(0 AS BIGINT) AS next FROM d
 UNION ALL SELECT doc_id, k + 1, stop, greatest(stop - 100, next + 1) FROM (SELECT *, CASE WHEN next + 2000 >= n THEN n WHEN l1 > 0 AND l1 < 799 THEN next + 2001 - l1 WHEN l2 > 0 AND l2 < 800 THEN next + 2001 - l2
   WHEN l3 > 0 AND l3 < 799 THEN next + 2001 - l3 ELSE next + 2000 END AS stop
  FROM (SELECT *, strpos(tail, chr(10) || chr(10)) AS l1, strpos(tail, chr(10)) AS l2, strpos(tail, ' .') AS l3
   FROM (SELECT p.*, d.n, reverse(substring(flat, p.next + 1201, 800)) AS tail FROM p JOIN d ON p.doc_id = d.doc_id AND (p."end" < d.n)))))
SELECT d.doc_id, max(k) AS n_chunks, CASE WHEN max(k) <= any_value(passes) THEN 'full' ELSE 'digest' END AS selection FROM d JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id""",
)
def _selection(spark, d):
    return passages.full_or_digest(read_table(spark, d, "documents"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(3), 2000, 100)


_STOP = """string_split('the and that for with this from would could shall may not are was were has have had been being which who whom whose any all such other than then upon under over into out its his her their our your there here when where what while about after before during between within without also more most said case court order section act code law legal', ' ')"""


@query(
    "token_counts",
    f"""WITH t AS (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: NOT list_contains({_STOP}, w))) AS term FROM documents)
SELECT term, count(*) AS n FROM t GROUP BY term""",
)
def _tokens(spark, d):
    return read_table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "issue_idf",
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: list_contains({ISSUES!r}, w))) AS term FROM documents),
n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
SELECT term, count(*) AS df, CAST(round(1000 * ln(1 + any_value(n.n) / (1 + count(*)))) AS BIGINT) AS idf_1000 FROM t, n GROUP BY term""",
)
def _idf(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    words = docs.select("doc_id", F.explode("t").alias("term")).where(F.col("term").isin(ISSUES)).distinct()
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(total).select("term", "df", F.round(1000 * F.log(1 + F.col("total") / (1 + F.col("df")))).cast("long").alias("idf_1000"))  # one row


# The phrases of the families, in this module's own words for DuckDB.
_FAMILIES = {
    "attribution": r"(?i)\b(submitted|submits|contended|contends|argued|argues|urged|urges|canvassed|it was (submitted|argued|urged|contended)|on behalf of the (appellant|respondent|petitioner|plaintiff|defendant|state)|counsel for|appearing for|learned counsel|according to (him|her|them)|(their|his|her) (submission|contention))\b",
    "court_voice": r"(?i)\b(we (hold|are of the (view|opinion)|conclude|agree|disagree|therefore|find)|it is held|held that|it is settled|in our (view|opinion|judgment|judgement)|for the (foregoing|above) reasons|we (affirm|reverse|remand|vacate)|the (appeals?|petitions?) (is|are) (allowed|dismissed)|it is (so )?ordered|accordingly, the|we therefore)\b",
    "dissent": r"(?i)\b(dissenting|dissents|dissent|respectfully dissent|concurring|i would)\b",
    "front_matter": r"(?i)\b(bench:|author:|coram|for the (appellant|respondent|petitioner)s?[\s\x{a0}]*:|advocates?([\s\x{a0}]+for)?|senior advocate|digitally signed|signature not verified|reportable|equivalent citations?)\b",
    "instrument": r"(?i)(\bsection[\s\x{a0}]+\d|\barticle[\s\x{a0}]+\d|§[\s\x{a0}]*\d|\bs\.[\s\x{a0}]*\d|\breg(ulation)?\.?[\s\x{a0}]*\d|\bcl\.[\s\x{a0}]*\d)",
}


@query(
    "discourse_counts",
    "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in _FAMILIES.items()) + " FROM documents WHERE text IS NOT NULL",
)
def _discourse(spark, d):
    counts = T.discourse_counts(F.col("text"))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", *[c.cast("long").alias(k) for k, c in counts.items()])


_WEIGHTS = {"attribution": -1.4, "court_voice": 1.6, "dissent": 1.2, "front_matter": -1.0, "instrument": 0.5}


@query(
    "passage_score",
    f"""WITH {_PASSAGES}, s AS (SELECT p.doc_id, span_no, substring(text, "start" + 1, "end" - "start") AS span, count(*) OVER (PARTITION BY p.doc_id) AS m FROM p JOIN d ON p.doc_id = d.doc_id WHERE span_no >= 0),
t AS (SELECT *, list_filter(regexp_extract_all(lower(span), '[a-z]{{3,}}'), lambda w: NOT list_contains(string_split('the and that for with this from would could shall may not are was were has have had been being which who whom whose any all such other than then upon under over into out its his her their our your there here when where what while about after before during between within without also more most said case court order section act code law legal', ' '), w)) AS toks FROM s),
u AS (SELECT doc_id, span_no, m, unnest(list_filter(toks, lambda w: list_contains(['cess', 'covenant', 'escrow', 'tariff', 'mortgage', 'subsidy'], w))) AS term FROM t),
g AS (SELECT doc_id, span_no, m, term, count(*) AS times FROM u GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM g),
i AS (SELECT doc_id, span_no, sum(times * ln(1 + m / (1 + df))) AS mass FROM c GROUP BY ALL)
SELECT t.doc_id, CAST(t.span_no AS INTEGER) AS span_no, round(3 * coalesce(mass, 0) / greatest(sqrt(len(toks)), 1) + """
    + " + ".join(f"({w}) * len(regexp_extract_all(span, '{_FAMILIES[k]}'))" for k, w in _WEIGHTS.items())
    + """ + CASE WHEN t.span_no / t.m > 0.85 THEN 1.2 WHEN t.span_no / t.m < 0.05 THEN 0.4 ELSE 0 END, 6) AS score
FROM t LEFT JOIN i ON t.doc_id = i.doc_id AND t.span_no = i.span_no""",
)
def _passage_score(spark, d):
    return passages.scored_passages(read_table(spark, d, "documents"), ISSUES).select("doc_id", "span_no", F.round("score", 6).alias("score"))


@query("digest_select")
def _digests(spark, d):
    scored = passages.scored_passages(read_table(spark, d, "documents"), ISSUES)
    return passages.digests(scored, 2, 5000).select("doc_id", "digest_no", F.length("digest").alias("size"))


@query(
    "round_robin_trim",
    """WITH e AS (SELECT source_id, candidate_no, row_number() OVER (PARTITION BY source_id ORDER BY candidate_no) AS k FROM evidence_candidate),
r AS (SELECT source_id, candidate_no, row_number() OVER (PARTITION BY source_id ORDER BY (k - 1) // 3, (k - 1) % 3) AS n FROM (SELECT *, 0 AS x FROM e))
SELECT source_id, candidate_no FROM r WHERE n <= 4""",
)
def _trim(spark, d):
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("candidate_no"))
    rows = read_table(spark, d, "evidence_candidate").select("source_id", "candidate_no").withColumn("k", number - 1)
    rows = rows.withColumn("item_no", F.floor(F.col("k") / 3)).withColumn("pass_no", F.col("k") % 3)
    return passages.round_robin(rows, "source_id", "pass_no", "item_no", F.lit(4)).select("source_id", "candidate_no")


@query(
    "reading_budget",
    """SELECT score.tier AS tier, CASE WHEN score.tier <= 2 THEN 3 WHEN score.tier = 3 THEN 2 ELSE 1 END AS passes,
 CASE WHEN score.tier <= 2 THEN 16 WHEN score.tier = 3 THEN 12 ELSE 8 END AS items, count(*) AS n FROM research_source GROUP BY ALL""",
)
def _budget(spark, d):
    passes, items = passages.reading_budget(F.col("score.tier"))
    return read_table(spark, d, "research_source").groupBy(F.col("score.tier").alias("tier"), passes.alias("passes"), items.alias("items")).agg(F.count(F.lit(1)).alias("n"))
