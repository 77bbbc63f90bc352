"""Queries over search results and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions.urls import canonical_url, host_of, host_suffixes, is_blocked, is_junk
from lexquarry.operators import authority, merge, scoring
from lexquarry.plans.registry import query
from lexquarry.sources import fetching
from lexquarry.sources.tables import read_table

_CANONICAL = r"""
u AS (SELECT ord, raw_id, url, provider, query_id, title, snippet,
   lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
   regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '^www\.', '') AS host,
   regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
   list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '=') AND NOT list_contains(
     ['utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','ref','source','mc_cid','mc_eid'], lower(split_part(p, '=', 1)))) AS pairs
 FROM raw_result),
k AS (SELECT *, array_to_string(pairs, '&') AS query FROM u),
c AS (SELECT *, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS page,
   host IN ('scconline.com','manupatra.com','westlawindia.com','lexisnexis.com') AS blocked,
   host IN ('toprankers.com','byjus.com','vedantu.com','unacademy.com','geeksforgeeks.org','javatpoint.com','tutorialspoint.com','legalbites.in','lawctopus.com','cleartax.in','taxguru.in') AS junk
 FROM k)"""


@query("canonical_url", f"WITH {_CANONICAL} SELECT ord, page FROM c")
def _canonical(spark, d):
    return read_table(spark, d, "raw_result").select("ord", canonical_url(F.col("url")).alias("page"))


@query(
    "host_filters",
    f"WITH {_CANONICAL} SELECT host, count(*) AS n, bool_or(blocked) AS blocked, bool_or(junk) AS junk FROM c GROUP BY host",
)
def _hosts(spark, d):
    url = F.col("url")
    hosts = read_table(spark, d, "raw_result").groupBy(host_of(url).alias("host"))
    return hosts.agg(F.count(F.lit(1)).alias("n"), F.bool_or(is_blocked(url)).alias("blocked"), F.bool_or(is_junk(url)).alias("junk"))


@query(
    "search_merge",
    f"""WITH {_CANONICAL}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(length(snippet), 0) + 2 * coalesce(length(title), 0) DESC, ord) AS n
  FROM c WHERE NOT blocked AND NOT junk),
a AS (SELECT page, array_to_string(list_sort(list(DISTINCT provider)), ',') AS discovered_by, array_to_string(list_sort(list(DISTINCT query_id)), ',') AS provenance, min(ord) AS ord
  FROM r GROUP BY page)
SELECT a.page, a.discovered_by, a.provenance, r.raw_id, r.title, r.snippet, a.ord FROM a JOIN r ON a.page = r.page AND r.n = 1""",
)
def _merge(spark, d):
    merged = merge.search_merge(read_table(spark, d, "raw_result"))
    return merged.withColumns({c: F.array_join(c, ",") for c in ("discovered_by", "provenance")})


@query(
    "merge_counters",
    f"""WITH {_CANONICAL}, s AS (SELECT page, count(DISTINCT provider) AS p FROM c WHERE NOT blocked AND NOT junk GROUP BY page)
SELECT (SELECT count(*) FROM c) AS n_input, (SELECT count(*) FROM c WHERE blocked) AS n_blocked, (SELECT count(*) FROM c WHERE junk AND NOT blocked) AS n_junk,
 (SELECT count(*) FROM s) AS n_survivors, (SELECT count(*) FROM s WHERE p > 1) AS n_multi_provider""",
)
def _counters(spark, d):
    return merge.merge_counters(read_table(spark, d, "raw_result"))


@query(
    "latest_delivery",
    """SELECT raw_id, max(ord) AS ord, arg_max(fetched_at, ord) AS fetched_at, arg_max(provider, ord) AS provider, min(ord) AS first_ord FROM raw_result GROUP BY raw_id""",
)
def _latest(spark, d):
    rows = read_table(spark, d, "raw_result").select("raw_id", "ord", "fetched_at", "provider")
    return merge.latest_by(rows, ["raw_id"], [F.col("ord")])


@query(
    "insert_ignore",
    """WITH t AS (SELECT raw_id, ord, provider FROM raw_result QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY ord) = 1)
SELECT raw_id, ord, provider FROM t""",
)
def _insert(spark, d):
    rows = read_table(spark, d, "raw_result").select("raw_id", "ord", "provider")
    middle = rows.agg(F.expr("percentile(ord, 0.5)").alias("m"))
    old = rows.join(middle, F.col("ord") <= F.col("m")).drop("m")
    old = merge.insert_ignore(old.limit(0), old, ["raw_id"], ["ord"])
    new = rows.join(middle, F.col("ord") > F.col("m")).drop("m")
    return merge.insert_ignore(old, new, ["raw_id"], ["ord"])


@query(
    "upsert_evidence",
    """WITH f AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ord) = 1),
l AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ord DESC) = 1)
SELECT f.evidence_id, f.kind, f.statement, l."grounding", l.quote_start, l.quote_end FROM f JOIN l USING (evidence_id)""",
)
def _upsert(spark, d):
    rows = read_table(spark, d, "evidence").select("evidence_id", "kind", "statement", "grounding", "quote_start", "quote_end", "ord")
    first = rows.groupBy("evidence_id").agg(F.min_by(F.struct(*rows.columns[1:]), "ord").alias("r")).select("evidence_id", "r.*")
    last = rows.groupBy("evidence_id").agg(F.max_by(F.struct(*rows.columns[1:]), "ord").alias("r")).select("evidence_id", "r.*")
    return merge.upsert_columns(first.drop("ord"), last.drop("ord"), ["evidence_id"], ["grounding", "quote_start", "quote_end"])


_RULES_SQL = """rules(rule_no, domain, tier, court, body, kind) AS (VALUES
 (0, 'sci.gov.in', 1, 'supreme_court', 'Supreme Court of India', 'judgment'),
 (1, 'digiscr.sci.gov.in', 1, 'supreme_court', 'Supreme Court of India', 'judgment'),
 (2, 'indiacode.nic.in', 1, 'none', NULL, 'statute'),
 (3, 'egazette.gov.in', 1, 'none', NULL, 'gazette_notification'),
 (4, 'judgments.ecourts.gov.in', 2, 'high_court', NULL, 'judgment'),
 (5, 'hcservices.ecourts.gov.in', 2, 'high_court', NULL, 'judgment'),
 (6, 'sebi.gov.in', 2, 'none', 'SEBI', 'regulator_circular'),
 (7, 'rbi.org.in', 2, 'none', 'RBI', 'regulator_circular'),
 (8, 'mca.gov.in', 2, 'none', 'MCA', 'regulator_circular'),
 (9, 'cci.gov.in', 2, 'none', 'CCI', 'regulator_circular'),
 (10, 'irdai.gov.in', 2, 'none', 'IRDAI', 'regulator_circular'),
 (11, 'trai.gov.in', 2, 'none', 'TRAI', 'regulator_circular'),
 (12, 'incometaxindia.gov.in', 2, 'none', 'CBDT', 'regulator_circular'),
 (13, 'cbic.gov.in', 2, 'none', 'CBIC', 'regulator_circular'),
 (14, 'ibbi.gov.in', 2, 'none', 'IBBI', 'regulator_circular'),
 (15, 'nclat.nic.in', 3, 'tribunal_appellate', 'NCLAT', 'tribunal_order'),
 (16, 'nclt.gov.in', 3, 'tribunal', 'NCLT', 'tribunal_order'),
 (17, 'greentribunal.gov.in', 3, 'tribunal', 'NGT', 'tribunal_order'),
 (18, 'lawcommissionofindia.nic.in', 3, 'none', 'Law Commission of India', 'law_commission_report'),
 (19, 'prsindia.org', 4, 'none', 'PRS Legislative Research', 'committee_report'),
 (20, 'ssrn.com', 4, 'none', NULL, 'academic'),
 (21, 'papers.ssrn.com', 4, 'none', NULL, 'academic'),
 (22, 'academic.oup.com', 4, 'none', NULL, 'academic'),
 (23, 'link.springer.com', 4, 'none', NULL, 'academic'),
 (24, 'jstor.org', 4, 'none', NULL, 'academic'),
 (25, 'semanticscholar.org', 4, 'none', NULL, 'academic'),
 (26, 'indiankanoon.org', 5, 'none', NULL, 'hint'),
 (27, 'barandbench.com', 5, 'none', NULL, 'legal_news'),
 (28, 'livelaw.in', 5, 'none', NULL, 'legal_news'),
 (29, 'scconline.com', 5, 'none', NULL, 'firm_commentary'),
 (30, 'indiacorplaw.in', 5, 'none', NULL, 'firm_commentary'),
 (31, 'vinodkothari.com', 5, 'none', NULL, 'firm_commentary'),
 (32, 'mondaq.com', 5, 'none', NULL, 'firm_commentary'),
 (33, 'nishithdesai.com', 5, 'none', NULL, 'firm_commentary'),
 (34, 'cyrilshroff.com', 5, 'none', NULL, 'firm_commentary'),
 (35, 'khaitanco.com', 5, 'none', NULL, 'firm_commentary'),
 (36, 'trilegal.com', 5, 'none', NULL, 'firm_commentary'),
 (37, 'azbpartners.com', 5, 'none', NULL, 'firm_commentary'))"""


# The hosts of the test data are invented; each source takes the host of a rule by its number, and every
# eleventh another one, so that all branches are passed.
_OTHERS = ["delhihighcourt.nic.in", "x.gov.in", "nlujournal.ac.in", "example.org", "indiankanoon.org/doc/77/"]
_SPREAD = [f"https://www.{rule[0]}/a" for rule in authority.RULES] + [f"https://a.{o}" for o in _OTHERS]


@query(
    "authority_resolve",
    f"""WITH {_RULES_SQL}, s AS (SELECT source_id, run_id, source_type, {_SPREAD!r}[(ord % {len(_SPREAD)}) + 1] AS url FROM research_source),
h AS (SELECT *, regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', '') AS host FROM s),
r AS (SELECT h.*, (SELECT min(rule_no) FROM rules WHERE h.host = domain OR ends_with(h.host, '.' || domain)) AS rule_no FROM h)
SELECT source_id, run_id, url,
 CASE WHEN kind = 'hint' AND regexp_matches(url, '/doc/\\d+') THEN 2 WHEN rule_no IS NOT NULL THEN tier WHEN regexp_matches(host, 'highcourt|hc\\.in|hcourt\\.gov\\.in$') THEN 2
  WHEN regexp_matches(host, '\\.(gov|nic)\\.in$') THEN 3 WHEN regexp_matches(host, 'journal|nlsiu|nujs|nluj|nlu') THEN 4 ELSE 6 END AS tier,
 CASE WHEN kind = 'hint' AND regexp_matches(url, '/doc/\\d+') THEN 'high_court' WHEN rule_no IS NOT NULL THEN court
  WHEN regexp_matches(host, 'highcourt|hc\\.in|hcourt\\.gov\\.in$') THEN 'high_court' ELSE 'none' END AS court_level_resolved,
 body AS issuing_body_resolved,
 CASE WHEN kind = 'hint' AND regexp_matches(url, '/doc/\\d+') THEN 'judgment' WHEN kind = 'hint' THEN coalesce(source_type, 'other') WHEN rule_no IS NOT NULL THEN kind
  WHEN regexp_matches(host, 'highcourt|hc\\.in|hcourt\\.gov\\.in$') THEN 'judgment' WHEN regexp_matches(host, '\\.(gov|nic)\\.in$') THEN coalesce(source_type, 'other')
  WHEN regexp_matches(host, 'journal|nlsiu|nujs|nluj|nlu') THEN 'academic' ELSE coalesce(source_type, 'other') END AS resolved_type
FROM r LEFT JOIN rules USING (rule_no)""",
)
def _authority(spark, d):
    spread = F.array(*[F.lit(u) for u in _SPREAD])
    sources = read_table(spark, d, "research_source").select("source_id", "run_id", "source_type", F.element_at(spread, (F.col("ord") % len(_SPREAD) + 1).cast("int")).alias("url"))
    return authority.resolve_authority(sources, "url", "source_type").drop("source_type")


@query(
    "authority_weight",
    """SELECT score.tier AS tier, CASE score.tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 WHEN 4 THEN 0.5 WHEN 5 THEN 0.3 ELSE 0.0 END AS weight,
 CASE WHEN jurisdiction NOT IN ('IN', 'IN_STATE') THEN greatest(score.tier, 4) ELSE score.tier END AS capped, count(*) AS n
FROM research_source GROUP BY ALL""",
)
def _weights(spark, d):
    tier = F.col("score.tier")
    rows = read_table(spark, d, "research_source").groupBy(
        tier.alias("tier"), authority.authority_weight(tier).cast("double").alias("weight"),
        authority.cap_foreign_tier(tier, F.coalesce("jurisdiction", F.lit("IN")), F.lit("IN")).alias("capped"),
    )
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query(
    "host_suffixes",
    """WITH h AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':\\d*$', ''), '^www\\.', '') AS host FROM raw_result),
p AS (SELECT host, string_split(host, '.') AS parts FROM h)
SELECT host, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '.'))) AS suffix FROM p""",
)
def _suffixes(spark, d):
    hosts = read_table(spark, d, "raw_result").select(host_of(F.col("url")).alias("host")).distinct()
    return hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("suffix"))


_SCORED = """s AS (SELECT s.source_id, s.run_id, s.ord, s.source_type, s.score.tier AS tier, s.score.authority AS authority, s.score.relevance AS rel, len(s.discovered_by) AS n,
  s.decided_or_published_on AS published, (s.ord % 7) AS o,
  CASE WHEN s.source_type NOT IN ('legal_news', 'regulator_circular', 'gazette_notification') THEN 1.0 WHEN published IS NULL THEN 0.5
    ELSE round(greatest(0.05, power(0.5, greatest(0, date_diff('day', published, DATE '2031-06-30')) / 365)), 3) END AS recent,
  CASE o WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 WHEN 3 THEN 0.3 WHEN 4 THEN 0.4 ELSE 1.0 END AS retr,
  CASE WHEN o = 6 THEN NULL ELSE s.ord % 500 END AS cites FROM research_source s),
t AS (SELECT *, round(CASE WHEN cites IS NULL THEN 0.4 * authority + 0.3 * least(n / 3.0, 1.0) + 0.3 * retr
  ELSE 0.35 * authority + 0.2 * least(n / 3.0, 1.0) + 0.2 * retr + 0.25 * least(log10(1 + cites) / 3, 1.0) END, 4) AS reliable FROM s)"""


def _scored(spark, d):
    o = F.col("ord") % 7
    status = F.when(o == 0, 200).when(o == 1, 403).when(o == 2, 301).when(o == 3, 500).when(o == 4, F.lit(None)).otherwise(200)
    rows = read_table(spark, d, "research_source").select(
        "source_id", "run_id", "ord", F.col("score.tier").alias("tier"), F.col("score.relevance").alias("rel"),
        F.col("score.authority").alias("authority"),
        scoring.recency(F.col("source_type"), F.col("decided_or_published_on"), F.lit("2031-06-30").cast("date")).alias("recent"),
        scoring.reliability(F.col("score.authority"), F.size("discovered_by"), scoring.retrievability(status), F.when(o != 6, F.col("ord") % 500)).alias("reliable"),
    )
    return rows.withColumn("composite", scoring.composite(F.col("authority"), F.col("rel"), F.col("reliable"), F.col("recent")))


@query(
    "source_score",
    f"""WITH {_SCORED} SELECT source_id, run_id, CAST(round(recent * 1000) AS BIGINT) AS recent_1000, CAST(round(reliable * 1000) AS BIGINT) AS reliable_1000,
 CAST(round((0.35 * authority + 0.35 * rel + 0.15 * reliable + 0.15 * recent) * 1000) AS BIGINT) AS composite_1000 FROM t""",
)
def _score(spark, d):
    thousand = lambda c: F.round(c * 1000).cast("long")
    composite = 0.35 * F.col("authority") + 0.35 * F.col("rel") + 0.15 * F.col("reliable") + 0.15 * F.col("recent")
    return _scored(spark, d).select(
        "source_id", "run_id", thousand(F.col("recent")).alias("recent_1000"), thousand(F.col("reliable")).alias("reliable_1000"), thousand(composite).alias("composite_1000")
    )


@query("quota_select", """WITH s AS (SELECT source_id, run_id, ord, score.tier AS tier, score.relevance AS relevance, score.composite AS composite FROM research_source),
a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY composite DESC, ord) AS n FROM s WHERE tier <= 2 AND relevance >= 0.35),
f AS (SELECT run_id, source_id FROM a WHERE n <= 3),
h AS (SELECT run_id, count(*) AS had FROM f GROUP BY run_id),
b AS (SELECT s.*, coalesce(had, 0) AS had, row_number() OVER (PARTITION BY s.run_id ORDER BY relevance DESC, s.ord) AS n FROM s LEFT JOIN h USING (run_id)
  WHERE tier <= 2 AND NOT EXISTS (SELECT 1 FROM f WHERE f.run_id = s.run_id AND f.source_id = s.source_id)),
g AS (SELECT run_id, source_id FROM f UNION ALL SELECT run_id, source_id FROM b WHERE n <= 3 - had),
e AS (SELECT run_id, source_id FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY relevance DESC, ord) = 1),
p AS (SELECT *, 'tier' AS quota FROM g UNION ALL SELECT *, 'relevance' FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.run_id = e.run_id AND g.source_id = e.source_id)),
k AS (SELECT run_id, count(*) AS taken FROM p GROUP BY run_id),
z AS (SELECT s.run_id, s.source_id, taken, row_number() OVER (PARTITION BY s.run_id ORDER BY composite DESC, s.ord) AS n FROM s JOIN k USING (run_id)
  WHERE composite >= 0.45 AND relevance >= 0.35 AND NOT EXISTS (SELECT 1 FROM p WHERE p.run_id = s.run_id AND p.source_id = s.source_id))
SELECT * FROM p UNION ALL SELECT run_id, source_id, 'fill' FROM z WHERE n <= greatest(0, 18 - taken)""")  # fmt: skip
def _quota(spark, d):
    rows = read_table(spark, d, "research_source").select("source_id", "run_id", "ord", "score.tier", "score.relevance", "score.composite")
    return scoring.select_by_quota(rows)


@query(
    "relevance_batches",
    """WITH b AS (SELECT source_id, run_id, score.relevance AS r, ord, CAST(floor((row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1) / 25) AS INTEGER) AS batch FROM research_source),
a AS (SELECT *, bool_or(batch % 3 <> 1 AND ord % 10 <> 0) OVER (PARTITION BY run_id, batch) AS answered FROM b)
SELECT source_id, run_id, batch, CASE WHEN NOT answered THEN 0.4 WHEN batch % 3 <> 1 AND ord % 10 <> 0 THEN r ELSE 0.3 END AS relevance FROM a""",
)
def _batches(spark, d):
    rows = read_table(spark, d, "research_source").select("source_id", "run_id", "ord", F.col("score.relevance").alias("relevance"))
    rows = scoring.batched(rows, ["run_id"], "ord")
    recorded = rows.where("batch % 3 <> 1 and ord % 10 <> 0").select("run_id", "batch", "source_id", "relevance")
    return scoring.with_relevance(rows.select("run_id", "batch", "source_id"), recorded).select("source_id", "run_id", "batch", "relevance")


@query(
    "quota_shortfalls",
    """SELECT run_id, 'min_tier12' AS quota, count(*) FILTER (WHERE score.tier <= 2) AS have FROM research_source GROUP BY run_id HAVING count(*) FILTER (WHERE score.tier <= 2) < 3""",
)
def _shortfalls(spark, d):
    return scoring.shortfalls(read_table(spark, d, "research_source").select("run_id", F.col("score.tier").alias("tier")))


@query("quota_dropped")
def _dropped(spark, d):
    rows = read_table(spark, d, "research_source").select("source_id", "run_id", "ord", "score.tier", "score.relevance", "score.composite")
    return scoring.dropped(rows, scoring.select_by_quota(rows))


@query(
    "instrument_quota",
    """WITH i AS (SELECT DISTINCT run_id, unnest(['Municipal Lighting Act', 'Drug Prices Act']) AS instrument FROM research_source),
c AS (SELECT i.run_id, instrument, source_id, row_number() OVER (PARTITION BY i.run_id, instrument ORDER BY contains(lower(coalesce(title, '')), substring(lower(instrument), 1, 30)) DESC, score.composite DESC, ord) AS n
 FROM i JOIN research_source s ON i.run_id = s.run_id WHERE source_type = 'statute' OR (source_type = 'subordinate_legislation' AND contains(lower(coalesce(title, '')), substring(lower(instrument), 1, 30))))
SELECT i.run_id, i.instrument, source_id FROM i LEFT JOIN c ON i.run_id = c.run_id AND i.instrument = c.instrument AND n = 1""",
)
def _instruments(spark, d):
    rows = read_table(spark, d, "research_source").select("source_id", "run_id", "ord", "title", "source_type", "score.composite")
    names = F.explode(F.array(F.lit("Municipal Lighting Act"), F.lit("Drug Prices Act"))).alias("instrument")
    return scoring.best_per_instrument(rows, rows.select("run_id").distinct().select("run_id", names))


@query(
    "host_caps",
    """WITH h AS (SELECT DISTINCT CASE ord % 5 WHEN 0 THEN 'api.indiankanoon.org' WHEN 1 THEN 'nclt.gov.in' WHEN 2 THEN 'x.indiacode.nic.in' WHEN 3 THEN 'notnclat.gov.in' ELSE provider || '.example.org' END AS host FROM raw_result)
SELECT host, CASE WHEN host = 'api.indiankanoon.org' OR host = 'nclt.gov.in' OR host = 'x.indiacode.nic.in' THEN 1 ELSE 2 END AS in_flight,
 CASE WHEN host = 'api.indiankanoon.org' OR host = 'nclt.gov.in' OR host = 'x.indiacode.nic.in' THEN 1.0 ELSE 2.0 END AS per_second FROM h WHERE host IS NOT NULL""",
)
def _host_caps(spark, d):
    o = F.col("ord") % 5
    host = F.when(o == 0, "api.indiankanoon.org").when(o == 1, "nclt.gov.in").when(o == 2, "x.indiacode.nic.in").when(o == 3, "notnclat.gov.in").otherwise(F.concat("provider", F.lit(".example.org")))
    return fetching.host_caps(read_table(spark, d, "raw_result").select(host.alias("host")).where("host is not null"))


@query(
    "provider_caps",
    "SELECT DISTINCT provider, CASE provider WHEN 'tavily' THEN 8 WHEN 'exa' THEN 8 WHEN 'perplexity' THEN 4 WHEN 'indiankanoon' THEN 2 WHEN 'indiacode' THEN 2 WHEN 'serpapi' THEN 6 WHEN 'semantic_scholar' THEN 4 ELSE 4 END AS in_flight FROM raw_result",
)
def _provider_caps(spark, d):
    return read_table(spark, d, "raw_result").select("provider").distinct().withColumn("in_flight", fetching.provider_cap(F.col("provider")))


@query(
    "fetch_strategy",
    """WITH u AS (SELECT ord, title, snippet, CASE WHEN ord % 3 = 0 THEN 'https://www.indiankanoon.org/doc/' || ord || '/' WHEN ord % 3 = 1 THEN 'https://indiankanoon.org/search/?q=' || ord ELSE url END AS u FROM raw_result),
s AS (SELECT *, CASE WHEN regexp_matches(u, '(?i)^https?://(www\\.)?indiankanoon\\.org/doc/[0-9]+') THEN 'indiankanoon' ELSE 'http' END AS strategy FROM u)
SELECT ord, strategy, CASE WHEN strategy = 'indiankanoon' AND coalesce(title, '') <> '' THEN title ELSE snippet END AS text FROM s""",
)
def _strategy(spark, d):
    o = F.col("ord") % 3
    url = F.when(o == 0, F.concat(F.lit("https://www.indiankanoon.org/doc/"), "ord", F.lit("/"))).when(o == 1, F.concat(F.lit("https://indiankanoon.org/search/?q="), "ord")).otherwise(F.col("url"))
    rows = read_table(spark, d, "raw_result").withColumn("strategy", fetching.strategy_of(url))
    return rows.select("ord", "strategy", fetching.fetched_text(F.col("strategy"), F.col("title"), F.col("snippet")).alias("text"))


@query(
    "text_ladder",
    """WITH t AS (SELECT doc_id, text AS whole, substring(text, 1, length(text) // 2) AS chosen, substring(text, 1, length(text) // 3) AS main FROM documents)
SELECT doc_id, length(CASE WHEN coalesce(length(main), 0) >= 400 THEN main WHEN coalesce(length(chosen), 0) >= 400 THEN chosen WHEN coalesce(length(whole), 0) > coalesce(length(main), 0) THEN whole ELSE main END) AS size FROM t""",
)
def _ladder(spark, d):
    part = lambda k: F.expr(f"substring(text, 1, length(text) div {k})")
    return read_table(spark, d, "documents").select("doc_id", F.length(fetching.choose_text(part(3), part(2), F.col("text"))).alias("size"))
