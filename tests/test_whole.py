"""Queries that do their whole job on rows that SQL or a filter would leave out."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.functions import similarity
from lexquarry.operators import drafting, grounding
from lexquarry.plans import records, registry
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def _lines(text):
    lines = (" ".join(x.split()) for x in text.replace("\r", " ").split("\n"))
    return "\n".join(x for x in lines if x)


def test_html_pages(spark):
    texts = ["plain > text", "a < b && c &lt; d", "<b>bold</b>\n\n<script>x</script>\r\ny", "धारा 29क  § 5\n“नियम” – ‘ü’", "&amp;amp; &copy", "", "\n \t\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in records.extracted(rows).collect()} == {i: _lines(t) for i, t in enumerate(texts)}


def test_html_pages_of_all_documents(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null").collect()
    got = registry.QUERIES["html_pages"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, _lines(r.text)) for r in documents)


def _best_stretch(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    return max(similarity.ratio(short, long[max(0, i) : min(m, i + n)]) for i in range(1 - n, m))


@given(st.text(alphabet="abcé", min_size=1, max_size=12), st.text(alphabet="abcé😀", min_size=1, max_size=30))
@settings(max_examples=500, deadline=None)
def test_partial_ratio_is_the_optimum(a, b):
    assert abs(similarity.partial_ratio(a, b) - _best_stretch(a, b)) < 1e-9


def test_partial_ratio_at_the_back():
    # The last letter stands nowhere in the shorter text, yet the stretch before it is the best one.
    assert similarity.partial_ratio("bcda", "xxxxbcz") == 200 * 2 / 7


def test_quote_similarity_of_all_candidates(spark):
    rows = spark.read.parquet(f"{FOLDER}/evidence_candidate.parquet").where("statement is not null and verbatim_quote is not null").collect()
    assert any(len(r.statement) > 200 for r in rows) and any(len(r.verbatim_quote) > 400 for r in rows)
    got = sorted((r.candidate_no, r.score) for r in registry.QUERIES["quote_similarity"](spark, FOLDER).collect())
    assert [x for x, _ in got] == sorted(r.candidate_no for r in rows)
    texts = {r.candidate_no: (r.statement, r.verbatim_quote) for r in rows}
    for no, score in got[::40]:
        a, b = texts[no]
        assert abs(score - (_best_stretch(a, b) if a and b else 100.0 * (a == b))) < 1e-5


def _kept(before, after):
    parts = lambda t: (Counter(drafting.paren_spans(t)), Counter(re.findall(r'["“]([^"”]{3,})["”]', t)))
    return parts(before) == parts(after)


@pytest.mark.parametrize(
    ("before", "after", "safe"),
    [
        ("It held (IBC, s. 29A(c)) so.", "So it held (IBC, s. 29A(c)).", True),
        ("It held (IBC, s. 29A(c)) so.", "It held (IBC, s. 29A(d)) so.", False),
        ("It held (a) and (a).", "It held (a).", False),
        ("It held (a) and (b).", "It held (b) and (a).", True),
        ("It said “the law” and (x).", "And (x): it said “the law”.", True),
        ('It said "the law".', 'It said "The law".', False),
        ('It said "the law" and "the law".', 'It said "the law".', False),
        ('It said "no".', 'It said "No".', True),
        ("(open", "open", True),
        ("“नियम लागू” है", "“नियम” है", False),
    ],
)
def test_voice_safe(spark, before, after, safe):
    frame = spark.createDataFrame([(before, after)], "a string, b string")
    assert frame.select(drafting.voice_safe(F.col("a"), F.col("b")).alias("x")).first().x is safe is _kept(before, after)


def test_voice_of_all_sections(spark, tmp_path):
    text = "No brackets.\n\nHeld (IBC, s. 29A(c)) so.\n\nHeld (see above) so.\n\nIt said “The law”.\n\nIt said “the law”."
    rows = spark.createDataFrame([(1, "draft", text), (2, "draft", None), (3, "scan", "(A)")], "doc_id long, doc_kind string, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.section_id: r.safe for r in registry.QUERIES["voice_sections"](spark, str(tmp_path)).collect()}
    assert got == {"1-0": True, "1-1": False, "1-2": True, "1-3": False, "1-4": True}
    drafts = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_kind = 'draft' and text is not null").collect()
    bodies = {f"{r.doc_id}-{i}": body for r in drafts for i, body in enumerate(r.text.split("\n\n"))}
    got = {r.section_id: r.safe for r in registry.QUERIES["voice_sections"](spark, FOLDER).collect()}
    assert got == {k: _kept(body, body.lower()) for k, body in bodies.items()}


def test_quote_verify(spark, tmp_path):
    law = "No resolution applicant shall be eligible to submit a plan if such person is an undischarged insolvent"
    slips = law.replace("eligible", "eligibel").replace("insolvent", "insolvant")
    other = "The appeal was dismissed with costs on the ground of limitation alone"
    text = (
        f'Held “{law}” [[ev:e1]].\n\nHeld "{slips}", [[ev:e1]] and “{other}” [[ev:e1]].\n\nHeld “{law[20:60].upper()}—” [[ev:e1]] and “{law}” [[ev:e2]].'
        f"\n\nHeld “{law}” [[ev:e9]], “too short” [[ev:e1]], “{law}” with no marker, “{'—' * 12}” [[ev:e1]]."
    )
    spark.createDataFrame([(1, "draft", text)], "doc_id long, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("e1", law), ("e1", law), ("e2", None)], "evidence_id string, verbatim_quote string").write.parquet(f"{tmp_path}/evidence.parquet")
    got = registry.QUERIES["quote_verify"](spark, str(tmp_path)).collect()
    assert sorted((r.section_id, r.evidence_id, r.status) for r in got) == [
        ("1-0", "e1", "clean"), ("1-1", "e1", "close"), ("1-1", "e1", "diverging"), ("1-2", "e1", "clean"), ("1-2", "e2", "no_quote"),
        ("1-3", "e1", "diverging"), ("1-3", "e9", "unresolved"),
    ]
    assert all((r.score is None) == (r.status not in ("close", "diverging")) for r in got)
    assert all(abs(r.score - _best_stretch(slips.lower(), law.lower())) < 1e-9 for r in got if r.status == "close")


def _places(text, quote):
    n = len(quote)
    return [_best_stretch(quote, text[a : a + n]) for a in range(len(text) - n + 1)]


def test_fuzzy_place_off_the_grid():
    rng = random.Random(3)
    found = 0
    for _ in range(50):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(40)]
        text = " ".join(words)
        a = rng.randrange(20, 90)
        quote = list(text[a : a + 80])
        for i in rng.sample(range(80), rng.randint(3, 9)):
            quote[i] = rng.choice("0123456789")
        quote = "".join(quote)
        scores = _places(text, quote)
        place = grounding.fuzzy_place(text, quote)
        assert (place is not None) == (max(scores) >= 92)
        if place:
            found += 1
            assert abs(scores[place[0]] - max(scores)) < 1e-9 and place[1] - place[0] == 80
    assert 5 < found < 45


def test_ground_keeps_a_passage_near_the_threshold(spark):
    passage = "the resolution applicant shall not be eligible to submit a plan where it is a related party of the debtor"
    quote = "".join("#" if i % 20 == 7 else c for i, c in enumerate(passage))
    claims = [(k, "x" * k + " " + passage + " and further the Tribunal observed as follows in paragraph 7.", quote) for k in range(40)]
    got = grounding.ground(spark.createDataFrame(claims, "claim_id long, text string, quote string")).collect()
    assert {(r.level, r.start - r.claim_id) for r in got} == {("fuzzy", 1)}


@given(st.text(alphabet="abcd e", min_size=12, max_size=60), st.lists(st.tuples(st.integers(0, 80), st.sampled_from("abcdx"), st.sampled_from("idr")), max_size=9), st.text(alphabet="abcd e", max_size=40), st.sampled_from([85.0, 92.0]))
@settings(max_examples=300, deadline=None)
def test_no_window_is_lost(quote, edits, around, least):
    text = list(quote)
    for at, letter, kind in edits:
        at %= len(text) + 1
        text[at : at + (kind != "i")] = [] if kind == "d" else [letter]
    text = around[::2] + "".join(text) + around
    if len(text) < len(quote):
        return
    n = len(quote)
    scores = [similarity.partial_ratio(quote, text[x : x + n]) for x in range(len(text) - n + 1)]
    possible = similarity.possible_windows(quote, text, least)
    assert all(possible[x] for x, s in enumerate(scores) if s >= least)
    found = similarity.best_window(quote, text, least)
    assert (found is None) == (max(scores) < least) and (found is None or scores[found] == max(scores))
