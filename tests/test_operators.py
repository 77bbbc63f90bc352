"""Vectors and properties of the operators of the core."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexquarry.functions import citations, similarity, text, urls
from lexquarry.operators import coverage, drafting, grounding, ledger, linking, merge, passages, planning, scoring, sections
from lexquarry.sources import fetching, providers, recorded, sinks


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given_", "wanted"),
    [
        ("HTTPS://WWW.X.org:8080/A//?b=2&a=1&b=3&c=&utm_source=z&Ref=1#f", "https://x.org/A?b=2&b=3&a=1"),
        ("http://x.org/", "http://x.org"),
        ("https://x.org/a?q=a%20b+c&n=%7ex*y&m=%zz&k=a=b%3D", "https://x.org/a?q=a+b+c&n=~x%2Ay&m=%25zz&k=a%3Db%3D"),
        ("https://m.x.org/en/98", "https://m.x.org/en/98"),
    ],
)
def test_canonical_url(spark, given_, wanted):
    assert one(spark, urls.canonical_url(F.col("u")), u=given_) == wanted


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("The les-\nsee  paid\trent.\n\n\n\n  page 7 of 12 \n\nClause 4 stands. ", "The lessee paid rent.\n\nClause 4 stands."),
        ("a\n12\nb\nPAGE 3\nc\n1of 2\nd", "a\nb\nc\nd"),
        ("a\n- 12 -\nb", "a\n- 12 -\nb"),
        ("Page 3 of\nx", "Page 3 of\nx"),
        ("\u00a0ﬁne\u00a0print № 5 ½\u2003", "fine print No 5 1\u20442"),
        ("", ""),
        (None, None),
    ],
)
def test_normalise_text(spark, raw, wanted):
    once = one(spark, text.normalise_text(F.col("t")), t=raw)
    assert once == wanted and one(spark, text.normalise_text(F.col("t")), t=once) == wanted


@pytest.mark.parametrize(
    ("family", "t", "n"),
    [
        ("attribution", "It was argued on behalf of the State that he submitted, on behalf of the tenant, nothing.", 3),
        ("court_voice", "We therefore hold. THE APPEALS ARE DISMISSED; the petition is allowed. It is so ordered.", 4),
        ("dissent", "I would respectfully dissent; dissents, dissenting", 4),
        ("front_matter", "Bench:Rao. Coram Rao. For the appellants :x, advocates for y", 4),
        ("instrument", "§ 5, Section  12, section\u00a07, s. 4, reg 9, Regulation. 3, cl.2, subsection 4", 7),
    ],
)
def test_discourse(spark, family, t, n):
    assert one(spark, text.discourse_counts(F.col("t"))[family], t=t) == n


@given(st.text(alphabet="ab. \n", max_size=400), st.integers(4, 60))
@settings(max_examples=200, deadline=None)
def test_passages_lossless(t, size):
    spans = list(text.cut_passages(t, size))
    assert "".join(t[a:b] for a, b in spans) == t
    assert all(b - a <= size for a, b in spans)


@given(st.text(alphabet="ab. \n", max_size=400), st.integers(20, 60), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_chunks_cover(t, size, overlap):
    spans = list(text.cut_chunks(t, size, overlap))
    seen = {i for a, b in spans for i in range(a, b)}
    assert seen == set(range(len(t))) and all(b - a <= size for a, b in spans)


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.lcs_length(a, b) == table[-1][-1]


def test_partial_ratio():
    assert similarity.partial_ratio("abc", "xxabcxx") == 100
    assert similarity.partial_ratio("", "x") == 0
    assert similarity.token_set_ratio("issue alpha", "alpha issue") == 100


@pytest.mark.parametrize(
    ("doc", "quote", "level"),
    [
        ("The rent tribunal found that clause 14 of the lease binds later owners.", "clause 14 of the lease binds later owners", "exact"),
        ("The  bench   read  ‘later   owner’   to   mean   buyers.", "'later owner' to mean buyers.", "normalized"),
        ("Here a later owner within clause 14(2) of the lease may not be released from the rent in arrear", "a later owner within clause 14(2) of the leas may not be releasd from the rent", "fuzzy"),
        ("The bench sent the matter back for want of notice.", "Each partner answers for every loss of the firm", "ungrounded"),
        ("anything", "xyz123", "ungrounded"),
        (None, "some quote of ten", "ungrounded"),
        ("text", None, "ungrounded"),
    ],
)
def test_ground(spark, doc, quote, level):
    claims = spark.createDataFrame([(1, doc, quote)], "claim_id long, text string, quote string")
    row = grounding.ground(claims).first()
    assert row.level == level
    if level == "exact":
        assert doc[row.start : row.end] == quote


def test_ground_short_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "x a b y")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "a b"), (8, ""), (9, None)], "quote_id long, quote string")
    assert {tuple(r) for r in grounding.ground_exact(docs, quotes).collect()} == {(1, 7, 0, 3), (3, 7, 2, 5)}


def test_ground_short_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x ‘a’  b"), (2, ""), (3, "a b"), (4, "ab\n'a' b c")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "'a' b"), (8, "“"), (9, "a' b c"), (10, "‘a’ b")], "quote_id long, quote string")
    want = {(1, 7), (4, 7), (4, 9), (1, 10), (4, 10)}
    assert {tuple(r) for r in grounding.ground_normalised(docs, quotes).collect()} == want
    assert {(r.doc_id, r.quote_id) for r in grounding._streamed(docs, quotes, most=6).collect()} == want


def test_binding(spark):
    cases = [("commentary_opinion", 1, True, "opinion"), ("holding", 1, True, "binding"), ("holding", 1, False, "persuasive"), ("holding", 3, True, "persuasive"), ("holding", 5, True, "informative")]
    frame = spark.createDataFrame(cases, "k string, t int, m boolean, w string")
    assert frame.where(grounding.binding_strength(F.col("k"), F.col("t"), F.col("m")) != F.col("w")).count() == 0


@pytest.mark.parametrize(
    ("raw", "kind", "field", "value"),
    [
        ("2021 INSC 77", "case", "neutral", "2021 INSC 77"),
        ("2022:BHC:815", "case", "court", "Bombay High Court"),
        ("(2019) 8 SCC 212", "case", "reporter", "(2019) 8 SCC 212"),
        ("AIR 2004 SC 61", "case", "court", "Supreme Court of India"),
        ("2018 SCC OnLine Kar 90", "case", "scc_online", "2018 SCC OnLine Kar 90"),
        ("Criminal Appeal No. 58 of 2017", "case", "case_number", "Criminal Appeal No. 58 of 2017"),
        ("Section 14B(2)(a) of the Harvel Drug Prices Act, 1989", "statute", "section", "14B(2)(a)"),
        ("RBI/2019-20/318", "circular", "circular", "RBI/2019-20/318"),
        ("hello", "other", "neutral", None),
    ],
)
def test_parse_citation(spark, raw, kind, field, value):
    c = one(spark, citations.parse_citation(F.col("r")), r=raw)
    assert c.kind == kind and c[field] == value


@pytest.mark.parametrize(
    ("raw", "tidy"),
    [
        ("2001 AIR 417 2001 SCR (1) 55 2001 SCC (2) 618 JT 2001 (2) 90", "2001 SCC (2) 618"),
        ("2001 SCC (2) 618 (2001) 2 SCC 618", "(2001) 2 SCC 618"),
        ("(2001)2 SCC 618 and AIR 2001SC417", "(2001)2 SCC 618"),
        ("(2001)2SCC618 and AIR2001SC417", "(2001)2SCC618 and AIR2001SC417"),
        ("2003 (4) S.C.C. 12 AIR 2003 SC 9 JT 1", "2003 (4) S.C.C. 12"),
        ("AIR 2003 Bombay 9 SCR", "AIR 2003 Bombay 9 SCR"),
        ("(2001) 2 SCC 618", "(2001) 2 SCC 618"),
        ("Harvel Mills And Anr VS. Ruvali Port Trust . . .", "Harvel Mills And Anr v Ruvali Port Trust"),
        ("Ruvali Port Co. ...", "Ruvali Port Co."),
        ("Harvel Mills v Ruvali Port…", "Harvel Mills v Ruvali Port"),
        ("", ""),
        (None, ""),
    ],
)
def test_tidy_citation(spark, raw, tidy):
    assert one(spark, citations.tidy_citation(F.col("r")), r=raw) == tidy


def test_coverage_keeps_zero(spark):
    evidence = spark.createDataFrame([("r", ["1"]), ("r", ["1", "2", "2", "x"])], "run_id string, supports_issues array<string>")
    issues = spark.createDataFrame([("r", i) for i in (1, 2, 3)], "run_id string, issue_no int")
    assert {r.issue_no: r.n for r in coverage.coverage(evidence, issues).collect()} == {1: 2, 2: 1, 3: 0}


def test_batches(spark):
    rows = spark.createDataFrame([("r", str(i), i) for i in range(60)], "run_id string, source_id string, ord long")
    sizes = scoring.batched(rows, ["run_id"], "ord").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [25, 25, 10]


def test_stable_issues(spark):
    schema = "run_id string, pos long, issue string"
    before = spark.createDataFrame([("r", 1, "Rent arrears"), ("r", 2, "Notice to quit"), ("r", 3, "Repairs of roof")], schema)
    after = spark.createDataFrame([("r", 1, "Notice to quit (form)"), ("r", 2, "Stamp duty on assignment")], schema)
    got = planning.stable_issues(before, after).orderBy("pos").collect()
    assert [r.issue for r in got] == ["Rent arrears", "Notice to quit", "Repairs of roof", "Stamp duty on assignment"]


@pytest.mark.parametrize(
    ("method", "values", "periods", "wanted"),
    [("sum", [1.0, 2.0, 3.0], None, 6), ("difference", [5.0, 3.0], None, 2), ("ratio", [1.0, 0.0], None, None), ("delta_pct", [50.0, 75.0], None, 50), ("cagr", [100.0, 121.0], 2, 10), ("cagr", [100.0, 121.0], None, None)],
)
def test_recompute(spark, method, values, periods, wanted):
    frame = spark.createDataFrame([(method, values, periods)], "m string, v array<double>, p int")
    got = frame.select(drafting.recompute(F.col("m"), F.col("v"), F.col("p"))).first()[0]
    assert got == wanted if wanted is None else abs(got - wanted) < 1e-9


def test_admission(spark):
    calls = spark.createDataFrame([("r", i, i, c) for i, c in enumerate((3.0, 5.0, 2.0, 1.0))], "run_id string, ts long, ord long, cost double")
    assert [r.admitted for r in ledger.admissions(calls, 9.0).orderBy("ord").collect()] == [True, True, False, True]


def test_money_is_exact(spark):
    calls = spark.createDataFrame([("r", i, i, 0.1) for i in range(12)] + [("r", 12, 12, None)], "run_id string, ts long, ord long, cost double")
    assert [r.admitted for r in ledger.admissions(calls, "1.0").orderBy("ord").collect()] == [True] * 10 + [False] * 2 + [True]


def test_backoff(spark):
    rows = [(2, None, 4.0), (0, "7", 7.0), (0, "99", 30.0), (0, "Wed, 01 Jan 2020 00:00:12 GMT", 12.0), (1, "Tue, 31 Dec 2019 00:00:00 GMT", 0.0), (1, "soon", 2.0)]
    frame = spark.createDataFrame(rows, "n int, r string, want double")
    got = frame.select("want", fetching.backoff(F.col("n"), F.col("r"), now=F.lit("2020-01-01 00:00:00").cast("timestamp")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_malformed_is_a_multiset(spark):
    bodies = spark.createDataFrame([("s", "[[ev:a]] ev:a ev:b"), ("t", None)], "section_id string, body string")
    assert {(r.token, r.n) for r in drafting.malformed(bodies).collect()} == {("a", 1), ("b", 1)}


def test_render(spark):
    text_ = "A [[ev:x]]. B[[ev:y]], [[ev:none]] up [[calc:c]] or [[calc:d]] [[ev:q1], [ev:q2]]"
    bodies = spark.createDataFrame([("s", text_), ("t", "")], "section_id string, body string")
    cited = spark.createDataFrame([("x", "2020 INSC 1", "para 4"), ("y", "", None)], "evidence_id string, citation string, pinpoint string")
    calcs = spark.createDataFrame([("s", "c", 12.50, "%"), ("t", "d", 1.0, None)], "section_id string, calc_id string, claimed_result double, unit string")
    got = {r.section_id: r.rendered for r in drafting.render(bodies, cited, calcs).collect()}
    assert got == {"t": "", "s": "A  (2020 INSC 1, para 4). B ([citation unresolved]),  [citation unresolved] up 12.5% or [calc unresolved] [citation unresolved]"}
    assert drafting.render(bodies, cited.drop("pinpoint")).where("section_id = 's'").first().rendered.startswith("A  (2020 INSC 1). B")


def test_hedges(spark):
    bodies = [(1, 0, "On balance, the better view holds; on balance."), (1, 1, "It may not have been accurate."), (1, 2, "None.")]
    got = drafting.running_hedges(spark.createDataFrame(bodies, "doc_id long, section_no int, body string")).orderBy("section_no").collect()
    assert [(r.own, r.before) for r in got] == [(3, 0), (1, 3), (0, 4)]


def test_outline(spark):
    rows = [("r", 0, "A", [1, 9], ["B"]), ("r", 1, "B", [2], ["A", "A"]), ("r", 2, "A", None, ["B", "A", "?"]), ("e", 0, "A", [], None)]
    out = sections.valid_outline(spark.createDataFrame(rows, "run_id string, section_no int, title string, issue_refs array<int>, depends_on array<string>"), F.lit(3)).collect()
    got = {(r.run_id, r.section_no): (r.issue_refs, r.depends_nos) for r in out}
    assert got[("r", 0)] == ([1], []) and got[("r", 1)] == ([2], [0, 0]) and got[("r", 2)][1] == [1, 0] and got[("e", 0)] == ([1, 2, 3], [])


def test_digests_hold_their_size(spark):
    rows = [(1, i, "x" * 40, float(s)) for i, s in enumerate((0, 5, 1, 9, 2, 0, 0))]
    passages_ = spark.createDataFrame(rows, "doc_id long, span_no int, span string, score double")
    out = [r.digest for r in passages.digests(passages_, 2, 100).orderBy("digest_no").collect()]
    assert len(out) == 2 and out == [passages.OMISSION.join(["x" * 40] * 2)] * 2
    assert [len(r.digest) for r in passages.digests(passages_, 1, 30).collect()] == []


def test_settled_quotes(spark):
    rows = [(1, "holding", None, None), (2, "holding", "q", "ungrounded"), (3, "commentary_opinion", "q", "ungrounded"), (4, None, "q", "fuzzy"), (5, None, "q", None)]
    stand, errors = grounding.settle_quotes(spark.createDataFrame(rows, "n int, kind string, quote string, level string"))
    assert {(r.n, r.quote, r.level) for r in stand.collect()} == {(1, None, "exact"), (3, None, "ungrounded"), (4, "q", "fuzzy")}
    assert {r.n for r in errors.collect()} == {2, 5}


def test_attribution(spark):
    rows = [("HARVEL RENT LAW REVIEW", "Gazette", "2001-02-03", "academic", '"Harvel Rent Law Review", Gazette, 2001'), ("X vs Y on 7 March 1996", None, None, "judgment", "X v Y"),
            ("", None, "2001-02-03", "judgment", ""), ("Rent Rules", "Board", None, "statute", "Rent Rules"), (None, "Board", None, None, "Board"), (None, None, None, None, "")]
    frame = spark.createDataFrame(rows, "t string, o string, d string, k string, want string").withColumn("d", F.col("d").cast("date"))
    got = frame.select("want", citations.attribute_source(F.col("t"), F.col("o"), F.col("d"), F.coalesce("k", F.lit(""))).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, "s", None, None), (2, "s" * 501, None, 0.5), (3, None, None, 0.5), (4, "s", "q" * 4001, 2.0), (5, "s", "q", 2.0)], "n int, statement string, verbatim_quote string, llm_confidence double")
    kept, rest = linking.quarantine(rows, linking.evidence_rules())
    assert [r.n for r in kept.collect()] == [1] and {(r.n, r.reason) for r in rest.collect()} == {(2, "statement"), (3, "statement"), (4, "verbatim_quote"), (5, "llm_confidence")}


def test_text_ladder(spark):
    long, mid, short = "m" * 400, "s" * 450, "w" * 9
    rows = [(long, mid, short, long), ("m", mid, short, mid), ("m", None, short, short), ("m" * 20, "s", short, "m" * 20), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, c string, want string")
    got = frame.select("want", fetching.choose_text(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_recorded_and_sinks(spark, tmp_path):
    folder = tmp_path / "recorded"
    folder.mkdir()
    (folder / "exa.jsonl").write_text('{"query_id": "q", "limit": 5, "payload": "{}"}\noops\n{"query_id": "p", "limit": 9, "payload": null}\n')
    (folder / "tavily.jsonl").write_text("")
    recorded.register(spark)
    rows = spark.read.format("recorded_responses").load(str(folder)).collect()
    assert [(r.provider, r.query_id, r.asked, r.payload, r.error) for r in rows] == [("exa", "q", 5, "{}", None), ("exa", None, None, None, "JSONDecodeError"), ("exa", "p", 9, None, None)]
    assert spark.read.format("recorded_responses").option("limit", 9).load(str(folder)).where("error is null").count() == 1
    log = spark.createDataFrame([(1, None)], "n int, x string").withColumn("ts", F.lit("2020-01-02").cast("timestamp"))
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"), "ts")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert sinks.as_json(log, "n").first().payload.startswith('{"x":null,"ts":')
    sinks.write_articles(spark.createDataFrame([(7, "# T\n\nbody")], "doc_id long, article string"), str(tmp_path / "articles"))
    assert next((tmp_path / "articles" / "doc_id=7").glob("*.txt")).read_text().strip() == "# T\n\nbody"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 3)], "k int, x string, y int")
    once = merge.upsert_columns(old, new, ["k"], ["y"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", 1), (2, "b", 9), (3, "d", 3)}
    assert {tuple(r) for r in merge.upsert_columns(once, new, ["k"], ["y"]).collect()} == {tuple(r) for r in once.collect()}


def test_providers(spark):
    frame = spark.createDataFrame(
        [("q", '{"organic_results":[{"position":2,"title":"t","link":"http://a/b","snippet":"s","date":"3 Jan 2020"},{"position":3,"title":"no link"}]}'), ("e", '{"error":"Invalid API key."}'), ("n", "oops")],
        "query_id string, response string",
    )
    rows = providers.organic_results(frame).collect()
    assert [(r.query_id, r.provider_rank, str(r.published_at)) for r in rows] == [("q", 2, "2020-01-03")]
    assert {tuple(r) for r in providers.rejected(frame).collect()} == {("e", "provider_error"), ("n", "not_json")}
    cases = spark.createDataFrame([("q", '{"docs":[{"tid":"9","title":"<b>T</b>","headline":"","docsource":"X","publishdate":"2020-05-01"}]}')], "query_id string, response string")
    row = providers.case_results(cases, "https://c/doc/").first()
    assert (row.url, row.title, row.snippet, row.venue) == ("https://c/doc/9/", "T", None, "X")
    assert providers.no_results(spark).count() == 0


def test_html():
    assert fetching.html_text("<nav>m</nav><p>a <b>b</b></p><script>x='</p>'</script><p>c &amp; d</p>") == "a b\nc & d"
    assert fetching.html_text("") == ""
