"""Queries over recorded responses, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.operators import ledger, merge
from lexquarry.plans.registry import query
from lexquarry.sources import fetching, providers
from lexquarry.sources.tables import read_table
from lexquarry.streaming import logs


def _responses(spark, d, provider, item, wrap):
    """The rows of raw_result as the responses they could have come from: one per run, query and provider."""
    rows = read_table(spark, d, "raw_result").where(F.col("provider") == provider)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda r: r["x"])
    grouped = rows.groupBy(F.concat_ws("/", "run_id", "query_id").alias("query_id")).agg(listed.alias("items"))
    return grouped.select("query_id", F.to_json(wrap(F.col("items"))).alias("response"))


_HITS = """WITH r AS (SELECT run_id || '/' || query_id AS query_id, provider, row_number() OVER (PARTITION BY run_id, query_id ORDER BY ord) AS provider_rank, url, title, snippet, published_at, venue
 FROM raw_result WHERE provider = '{0}' AND run_id IS NOT NULL AND query_id IS NOT NULL) SELECT query_id, provider, provider_rank, url, {1} FROM r WHERE provider_rank <= 10 AND url <> ''"""


@query("parse_web", _HITS.format("tavily", "title, substring(snippet, 1, 500) AS snippet, published_at"))
def _web(spark, d):
    item = F.struct("url", "title", F.col("snippet").alias("content"), F.col("published_at").cast("string").alias("published_date"))
    hits = providers.web_results(_responses(spark, d, "tavily", item, lambda x: F.struct(x.alias("results"))))
    return hits.drop("venue")


@query("parse_organic", _HITS.format("serpapi", "title, snippet, published_at"))
def _organic(spark, d):
    item = F.struct(F.col("url").alias("link"), "title", "snippet", F.date_format("published_at", "d MMM yyyy").alias("date"))
    number = lambda x: F.struct(F.transform(x, lambda r, i: F.struct((i + 1).alias("position"), r["link"].alias("link"), r["title"].alias("title"), r["snippet"].alias("snippet"), r["date"].alias("date"))).alias("organic_results"))
    return providers.organic_results(_responses(spark, d, "serpapi", item, number)).drop("venue")


@query(
    "parse_cases",
    _HITS.format("indiankanoon", "nullif(trim(regexp_replace(title, '<[^>]+>', '', 'g')), '') AS title, published_at, venue").replace("url, nullif", "'https://cases.test/doc/' || md5(url) || '/' AS url, nullif"),
)
def _cases(spark, d):
    item = F.struct(F.md5("url").alias("tid"), F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.date_format("published_at", "yyyy-MM-dd").alias("publishdate"), F.col("venue").alias("docsource"))
    hits = providers.case_results(_responses(spark, d, "indiankanoon", item, lambda x: F.struct(x.alias("docs"))), "https://cases.test/doc/")
    return hits.drop("snippet")


@query("parse_cited", _HITS.format("perplexity", "CASE WHEN provider_rank = 1 THEN 'answer' END AS snippet"))
def _cited(spark, d):
    hits = providers.cited_urls(_responses(spark, d, "perplexity", F.col("url"), lambda x: F.struct(F.lit("answer").alias("answer"), x.alias("citations"))))
    return hits.select("query_id", "provider", "provider_rank", "url", "snippet")


@query(
    "rejected_responses",
    "SELECT CAST(ord AS VARCHAR) AS query_id, CASE ord % 3 WHEN 0 THEN 'not_json' ELSE 'provider_error' END AS reason FROM raw_result WHERE ord % 3 <> 2",
)
def _rejected(spark, d):
    o = F.col("ord") % 3
    text = F.when(o == 0, "<html>").when(o == 1, '{"error": "no key"}').otherwise('{"results": []}')
    return providers.rejected(read_table(spark, d, "raw_result").select(F.col("ord").cast("string").alias("query_id"), text.alias("response")))


@query(
    "retry_classes",
    """WITH r AS (SELECT ord, [200, 404, 429, 503, NULL, 500, 301][ord % 7 + 1] AS status, CASE ord % 5 WHEN 0 THEN 'read timeout' WHEN 1 THEN 'TLS handshake failed' END AS error, ord % 3 AS attempt,
  CASE ord % 4 WHEN 0 THEN '5' WHEN 1 THEN '3600' WHEN 2 THEN 'soon' END AS wish FROM raw_result)
SELECT ord, CASE WHEN error = 'TLS handshake failed' THEN false WHEN error = 'read timeout' THEN true WHEN status = 429 OR status >= 500 THEN true WHEN status BETWEEN 400 AND 499 THEN false
  WHEN status BETWEEN 200 AND 399 THEN false ELSE true END AS retry, CASE wish WHEN '5' THEN 5.0 WHEN '3600' THEN 30.0 ELSE power(2.0, attempt) END AS wait FROM r""",
)
def _retry(spark, d):
    o = F.col("ord")
    statuses = F.array(*[F.lit(x).cast("int") for x in (200, 404, 429, 503, None, 500, 301)])
    status = F.element_at(statuses, (o % 7 + 1).cast("int"))
    error = F.when(o % 5 == 0, "read timeout").when(o % 5 == 1, "TLS handshake failed").otherwise(F.lit(None))
    wish = F.when(o % 4 == 0, "5").when(o % 4 == 1, "3600").when(o % 4 == 2, "soon")
    rows = read_table(spark, d, "raw_result")
    return rows.select("ord", fetching.retryable(status, F.coalesce(error, F.lit(""))).alias("retry"), fetching.backoff(o % 3, wish).alias("wait"))


@query(
    "fetch_outcome",
    """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'http_404' WHEN doc_id % 13 = 0 THEN 'too_large' WHEN doc_id % 11 = 0 THEN 'unsupported'
 WHEN coalesce(length(text), 0) < 50 THEN 'empty' WHEN length(text) < 400 THEN 'thin' ELSE 'ok' END AS outcome FROM documents) GROUP BY outcome""",
)
def _outcome(spark, d):
    i = F.col("doc_id")
    status, size = F.when(i % 9 == 0, 404).otherwise(200), F.when(i % 13 == 0, fetching.MAX_BYTES + 1).otherwise(1000)
    mime = F.when(i % 11 == 0, "image/png").otherwise("text/html")
    rows = read_table(spark, d, "documents").select(fetching.outcome(status, size, F.length("text"), mime).alias("outcome"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("html_pages")
def _html_pages(spark, d):
    return extracted(read_table(spark, d, "documents").where("text is not null"))


def extracted(rows):
    """The text of each row (doc_id, text), written into a page and read out of it again."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.regexp_replace(F.regexp_replace(escaped, "\r", " "), "\n", "</p><p>")
    page = F.concat(F.lit("<html><head><style>x</style></head><body><nav>menu</nav><script>var a = '</p>';</script><p>"), body, F.lit("</p><footer>end</footer></body></html>"))
    return fetching.extract_html(rows.select(F.col("doc_id").cast("string").alias("url"), page.alias("html"))).select(F.col("url").cast("long").alias("doc_id"), "text")


@query(
    "pdf_quality",
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t FROM documents WHERE doc_kind = 'scan' AND text IS NOT NULL),
s AS (SELECT doc_id, avg(CASE WHEN length(trim(t)) >= 20 THEN 1.0 ELSE 0.0 END) AS share FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN share < 0.5 THEN 0.4 WHEN share < 0.9 THEN 0.75 ELSE 0.95 END AS confidence, share >= 0.5 AS is_quotable FROM s""",
)
def _pdf(spark, d):
    scans = read_table(spark, d, "documents").where("doc_kind = 'scan' and text is not null")
    pages = scans.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page_no", "text"))
    return fetching.pdf_quality(pages).drop("text")


@query(
    "host_pacing",
    """WITH r AS (SELECT ord, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, fetched_at, lag(fetched_at) OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#:]*)', 1)) ORDER BY fetched_at) AS b FROM raw_result)
SELECT host, count(*) AS n FROM r WHERE epoch_us(fetched_at) - epoch_us(b) < 864000000000 GROUP BY host""",
)
def _pacing(spark, d):
    rows = read_table(spark, d, "raw_result").select(F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)).alias("host"), F.col("fetched_at").alias("ts"))
    return fetching.pacing(rows, F.lit(1 / 864000)).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query(
    "budget_admission",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, event_id, n, cost <= 50000 AS admitted, CASE WHEN cost <= 50000 THEN cost ELSE 0 END AS used FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, a.used + e.cost <= 50000, a.used + CASE WHEN a.used + e.cost <= 50000 THEN e.cost ELSE 0 END FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1)
SELECT user_id, event_id, admitted FROM a""",
)
def _admission(spark, d):
    calls = read_table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("ord"), F.round(F.col("value") * 100).cast("double").alias("cost"))
    return ledger.admissions(calls, 50000.0).select(F.col("run_id").alias("user_id"), F.col("ord").alias("event_id"), "admitted")


@query(
    "budget_ledger",
    """SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS spent, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def _ledger(spark, d):
    log = read_table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("ord"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return ledger.running_totals(log).select(F.col("ord").alias("event_id"), "spent", "n")


@query(
    "spend_rollup",
    "SELECT event_type, user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost FROM events GROUP BY ROLLUP (event_type, user_id)",
)
def _rollup(spark, d):
    return ledger.rollup(read_table(spark, d, "events").withColumn("cost", F.round(F.col("value") * 100).cast("long")), "event_type", "user_id")


@query(
    "error_rows",
    """SELECT node, kind, count(*) AS n FROM (SELECT 'fetch' AS node, 'empty_text' AS kind FROM documents WHERE coalesce(text, '') = ''
UNION ALL SELECT 'ground', 'no_quote' FROM evidence WHERE verbatim_quote IS NULL) GROUP BY ALL""",
)
def _errors(spark, d):
    empty = read_table(spark, d, "documents").where("coalesce(text, '') = ''").withColumnRenamed("doc_id", "id")
    bare = read_table(spark, d, "evidence").where("verbatim_quote is null").withColumnRenamed("evidence_id", "id")
    rows = ledger.error_rows((empty, "fetch", "empty_text"), (bare, "ground", "no_quote"))
    return rows.groupBy("node", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_100 FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def _windows(spark, d):
    events = logs.file_stream(spark, "events", d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))
    counts = logs.drain(logs.windowed_counts(events), "windows")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("value").alias("value_100"))


@query("stream_first_deliveries", "SELECT raw_id, count(*) AS n FROM (SELECT DISTINCT raw_id FROM raw_result) GROUP BY raw_id")
def _deliveries(spark, d):
    rows = logs.file_stream(spark, "raw_result", d).select("raw_id", "fetched_at")
    first = logs.drain(logs.first_deliveries(rows, "raw_id", "fetched_at", "4000 days"), "deliveries")
    return first.groupBy("raw_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_upsert",
    "SELECT evidence_id, max(ord) AS ord, arg_max(loop_index, ord) AS loop_index FROM evidence GROUP BY evidence_id",
)
def _stream_upsert(spark, d):
    rows = logs.file_stream(spark, "evidence", d).select("evidence_id", "ord", "loop_index")

    def fold(batch, before):
        both = batch if before is None else batch.unionByName(before)
        return merge.latest_by(both, ["evidence_id"], [F.col("ord")]).drop("first_ord")

    return logs.latest_table(rows, fold, ["evidence_id"], "upsert")
