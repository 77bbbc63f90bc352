"""The training-data operators against brute force, on edge cases, and on held-out accuracy."""

import base64
import random
from collections import Counter, defaultdict
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.llm import abuse, canonical, components, cutoff, encode, leak, linear, near, queries, spans, survivor, variants
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"
LONG = "word " * 30_000


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert not got.duplicated().any() if name.endswith("_found") else True
    if name in queries.ORACLES:
        assert rows(got) == rows(connect(FOLDER).execute(queries.ORACLES[name]).df())


# 1


def shared_by_force(records, least):
    held = defaultdict(set)
    for key, text in records:
        for s in range(len(text or "") - least + 1):
            held[text[s : s + least]].add(key)
    return {k for v in held.values() if len(v) > 1 for k in v}


def test_shared_spans(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdé क🙂") for _ in range(600))
    records = [("a", base[:300]), ("b", "x" + base[50:290]), ("c", base[120:600]), ("d", None), ("e", ""), ("f", "short"), ("a", base[:300]), ("g", "z" * 400), ("h", "z" * 199)]
    records += [(f"r{i}", "".join(rng.choice("xyz") for _ in range(150)) + base[i : i + 195 + i]) for i in range(12)]
    frame = spark.createDataFrame([(*r, 1) for r in records], "id string, text string, start int")
    assert {r[0] for r in spans.sharing_ids(frame, 200).collect()} == shared_by_force(records, 200)
    amount = {r.id: r for r in spans.shared_amount(frame, 200).collect()}
    held = defaultdict(set)
    for key, text in records:
        for s in range(len(text or "") - 199):
            held[text[s : s + 200]].add(key)
    for key, text in records:
        covered = {i for s in range(len(text or "") - 199) if len(held[text[s : s + 200]]) > 1 for i in range(s, s + 200)}
        assert not text or amount[key].shared_chars == len(covered)
    assert all(sum(s.end - s.begin for s in r.spans) == r.shared_chars for r in amount.values())


def test_shared_spans_empty(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert spans.sharing_ids(empty).count() == 0 and spans.shared_amount(empty).count() == 0


@given(st.text(alphabet="ab", min_size=220, max_size=260))
@settings(max_examples=20, deadline=None)
def test_passages_of_a_shared_stretch(text):
    assert set(spans.passages("c" * 30 + text, 200)) & set(spans.passages(text + "d" * 50, 200))


# 2


@pytest.mark.parametrize(
    ("field", "a", "b", "same"),
    [
        ("case_name", "Suresh Hoslozan v State of Thulloor", "S. Hoslozan vs. The State of Thulloor & Ors.", True),
        ("case_name", "Hoslozan, Suresh v State of Thulloor", "SURESH HOSLOZAN versus Govt. of Thuloor etc.", True),
        ("case_name", "Usha Rao v Kesriko Telecom Ltd (No. 2)", "Usha Rao v Kesriko Telecom Ltd", False),
        ("case_name", "Usha Rao v Kesriko Telecom Ltd (II)", "Uhsa Rao v Kesriko Telecom Limited - 2", True),
        ("case_name", "Wm. Tolpeppa v Darkuri Motors", "William Tolpeppa v Darkuri Motors Pvt Ltd", True),
        ("case_name", "Vellalo Papers Ltd v Anil Rao", "Vellalo Minerals Ltd v Anil Rao", False),
        ("act_name", "Etalpur Municipal Lighting Act, 1977", "Act of 1977 on Municipal Lighting, Etalpur", True),
        ("act_name", "Etalpur Municipal Lighting Act, 1977", "Etalpur Municipal Lighting Act, 1993", False),
        ("act_name", "Etalpur Municipal Lighting Act, 1977", "EMLA, 1977", True),
        ("act_name", "Etalpur Municipal Lighting Act, 1977", "Etalpur Municipal Lighting Act, '77", True),
        ("court", "National Insolvency Tribunal", "National Insolvency Appellate Tribunal", False),
        ("court", "High Court of Judicature at Ruvali", "Rvuali H.C.", True),
    ],
)
def test_variants_match(field, a, b, same):
    x, y = variants.parse(field, a), variants.parse(field, b)
    assert (x == y or variants.match(field, x, y)) == same


def test_variant_pairs(spark):
    names = [("court", n) for n in ("Ruvali High Court", "ruvali high court", "Ruvali HC", "Harvel High Court", "n/a", "-", "", " ", None, "ibid", "Ruvali HC")]
    names += [("act_name", n) for n in ("Harvel Drug Prices Act, 1989", "Harvel Drug Prices Act", "the said Act", "Act", "Harvel Stamp Act, 1966")]
    names += [("case_name", n) for n in ("A Raodesh v State of Harvel", "Anil Raodesh v State of Harvel", "Asha Raodesh v State of Harvel", LONG)]
    frame = spark.createDataFrame([(*n, "entity") for n in names], "field_name string, name string, entity string")
    got = {tuple(r) for r in variants.variant_pairs(frame).collect()}
    assert got == {
        ("court", "Ruvali HC", "Ruvali High Court"), ("court", "Ruvali HC", "ruvali high court"), ("court", "Ruvali High Court", "ruvali high court"),
        ("act_name", "Harvel Drug Prices Act", "Harvel Drug Prices Act, 1989"),
    }  # fmt: skip  (A Raodesh may be Anil or Asha: it pairs with neither)
    assert variants.variant_pairs(frame.limit(0)).count() == 0


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_near(a, b):
    full = variants.near(a, b, 20)
    assert variants.near(b, a, 20) == full and (variants.near(a, b, 1) == full if full <= 1 else variants.near(a, b, 1) is None)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.components(frame).collect()} == {x: find(x) for x in parent}
    assert components.components(frame.limit(0)).count() == 0


# 3


def test_cut_values(spark):
    rng = random.Random(2)
    nouns, verbs = ["the court", "a tenant", "the auditor", "an exporter"], ["recorded", "waived", "paid", "contested"]
    full = [f"{rng.choice(nouns).capitalize()} {rng.choice(verbs)} {rng.randrange(10**5)} entries of {rng.choice(nouns)}; {rng.choice(nouns)} {rng.choice(verbs)} them in {rng.randrange(1990, 2030)}." for _ in range(600)]
    cut = [t[: rng.randrange(30, len(t) - 12)] + rng.choice(["", "…", " ...", "[…]"]) for t in full[:120]]
    cut = [t for t in cut if t.rstrip()[-1] not in ".;"] + [t for t in cut if t.endswith("...")]
    values = [("snippet", f"f{i}", t, 1) for i, t in enumerate(full)] + [("snippet", f"c{i}", t, 1) for i, t in enumerate(cut)]
    values += [("snippet", "n", None, 1), ("snippet", "e", "", 1), ("snippet", "b", "  ", 1), ("snippet", "l", LONG + "ends.", 1), values[0]]
    got = {r.record_id for r in cutoff.cut_values(spark.createDataFrame(values, "field_name string, record_id string, value string, score int")).collect()}
    assert not got & {"n", "e", "b"}
    assert len(got & {f"c{i}" for i in range(len(cut))}) >= 0.95 * len(cut)
    assert sum(r.startswith("f") for r in got) <= 0.02 * len(full)


def test_cut_values_empty(spark):
    assert cutoff.cut_values(spark.createDataFrame([], "field_name string, record_id string, value string")).count() == 0


# 4


def near_by_force(records, t=0.8, least=20):
    bags = [(table, key, Counter(near._words(text))) for table, key, text in set(records) if key and text and len(near._words(text)) >= least]
    out = set()
    for i, (ta, a, x) in enumerate(bags):
        for tb, b, y in bags[:i]:
            if ta == tb and a != b and 2 * (x & y).total() >= t * (x.total() + y.total()) - 1e-9:
                out.add((ta, *sorted((a, b))))
    return out


def test_near_pairs(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    records = []
    for i in range(60):
        base = [rng.choice(words[: rng.choice((8, 60))]) for _ in range(rng.randrange(18, 45))]
        for j in range(rng.randrange(1, 5)):
            copy = base[:]
            for _ in range(rng.randrange(0, 8)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(1, 3)
            rng.shuffle(copy)
            records.append((rng.choice(("x", "y")), f"{i}-{j}", " ".join(copy)))
    records += [("x", "null", None), ("x", "empty", ""), ("x", "few", "one two"), records[0], ("x", "again", records[0][2]), (records[0][0], "same", records[0][2].upper())]
    frame = spark.createDataFrame([(*r, 5) for r in records], "table_name string, id string, text string, m int")
    want = near_by_force(records)
    assert len(want) > 40 and {tuple(r) for r in near.near_pairs(frame).collect()} == want
    monkeypatch.setattr(near, "CELL", 7)  # lists of frequent words cut into cells
    monkeypatch.setattr(near, "ORDERED_WORDS", 5)
    assert {tuple(r) for r in near.near_pairs(frame).collect()} == want
    groups = {(r.table_name, r.id): r.group_id for r in near.near_groups(frame).collect()}
    assert all(groups[t, a] == groups[t, b] for t, a, b in want)
    assert near.near_pairs(frame.limit(0)).count() == 0


def test_near_long(spark):
    frame = spark.createDataFrame([("x", "a", LONG), ("x", "b", LONG + "more")], "table_name string, id string, text string")
    assert near.near_pairs(frame).count() == 1


# 5


def test_map_values(spark):
    reference = spark.createDataFrame([("kind", "holding", 1), ("kind", "obiter", 2), ("kind", "holding", 3), ("kind", None, 4)], "field_name string, canon_value string, s1 int")
    typed = ["Holding", "hloding", " holding (llm)", "ratio decidendi", "obiter dictum", "holding", "weather", "", " ", None, "???", LONG, "Holding"]
    values = spark.createDataFrame([("kind", t, 1) for t in typed] + [("other", "holding", 1)], "field_name string, typed_value string, e1 int")
    want = {"Holding": "holding", "hloding": "holding", " holding (llm)": "holding", "ratio decidendi": "holding", "obiter dictum": "obiter", "weather": "", "": "", " ": "", "???": "", LONG: ""}
    for room in (100_000, 1):
        got = canonical.map_values(values, reference, max_forms=room).collect()
        assert {r.typed_value: r.canon_value for r in got if r.field_name == "kind"} == want
        assert [r.canon_value for r in got if r.field_name == "other"] == [""]
    assert canonical.map_values(values, reference.limit(0)).where("canon_value <> ''").count() == 0
    assert canonical.map_values(values.limit(0), reference).count() == 0


# 6


def test_best_rows(spark):
    t = datetime(2031, 1, 5)
    rows_ = [
        (1, "r", "http://www.A.org:80/x/?b=1&utm_source=q&a=2#f", " long title ", date(2030, 1, 1), "p", t),
        (2, "r", "https://a.org/x?a=2&b=1", "a longer title", date(2040, 1, 1), "q", t),
        (3, "r", "https://a.org/X?a=2&b=1", "other page", None, "q", t),
        (4, "r", "https://a.org/x?a=2&b=1", None, date(2030, 1, 1), None, t),
        (5, "s", "http://b.org", None, None, "unknown", t),
        (6, "s", "http://b.org/", "  ", None, None, None),
        (7, "s", None, "t", None, "p", t),
        (8, None, "http://b.org/", "t", None, "p", t),
    ]
    raw = spark.createDataFrame([(*r, "n") for r in rows_], "ord long, run_id string, url_canonical string, title string, published_at date, provider string, fetched_at timestamp, page string")
    trust = spark.createDataFrame([("p", 5, 1), ("q", 5, 1), ("p", 3, 1)], "provider string, trust int, ord int")
    assert {tuple(r) for r in survivor.p6_found(raw, trust).collect()} == {(1, 2, 1, 1), (5, -1, -1, -1)}
    assert survivor.p6_found(raw.limit(0), trust).count() == 0 and survivor.p6_found(raw, trust.limit(0)).count() == 2


def test_truth_discovery(spark):
    rng = random.Random(9)
    claims = [(f"o{i}", "f", f"v{i}" if rng.random() < p else f"w{rng.randrange(3)}", s) for i in range(80) for s, p in (("good", 0.95), ("fair", 0.8), ("bad", 0.2), ("bad2", 0.2))]
    claims += [("o1", "f", None, "good"), (None, "f", "x", "good"), claims[0]]
    frame = spark.createDataFrame(claims, "object string, field string, value string, source string")
    winners, rates = survivor.truth_discovery(frame)
    right = sum(r.value == "v" + r.object[1:] for r in winners.collect())
    rate = {r.source: r.r for r in rates.collect()}
    votes = defaultdict(Counter)
    for o, _, v, s in set(claims):
        if o and v:
            votes[o][v] += 1
    plain = sum(min(v for v in c if c[v] == max(c.values())) == "v" + o[1:] for o, c in votes.items())
    assert right >= plain and rate["good"] > rate["fair"] > rate["bad"]
    assert winners.groupBy("object", "field").count().where("count > 1").count() == 0


# 7


@pytest.fixture(scope="module")
def merge():
    with open(encode.DEFAULT_VOCABULARY, "rb") as f:
        return encode.Merger(f.read())


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["", None, " ", "a'sab 's  's don't x''s \n's \t 'll're", "   x  \n\n y　 z  ", "नमस्ते ½²x १२३", "😀😀 it's<|endoftext|>", "'", "\n'd", "a\r\n\r\n b", "\x85 x \x1c\x1fy", "naïve"]


def test_encode(spark):
    texts = [*ODD, LONG, "the the the", "the the the"]
    frame = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in encode.encode(frame, lexicon_words=50).collect()}
    assert [got[i] for i in range(len(texts))] == reference_ids(texts)
    assert encode.encode(frame.limit(0)).count() == 0


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encode_any_text(merge, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    words = [w for w in (b" the", b"the", b"a", b"  ", b"\n") if w]
    lexicon = encode.Lexicon.build(words, merge)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for first, end, data, offsets in encode._slices(batch, 0):
        ids, at = encode.encode_slice(data, offsets, lexicon, merge)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(end - first)]
    assert got == reference_ids(texts)


def test_lexicon_is_minimal(merge):
    words = [b"walking", b"talking", b"walked", b"talked", b"walk"]
    lexicon = encode.Lexicon.build(words, merge)
    assert lexicon.edges.shape[0] - 1 == 13  # the root, four states after w and after t each, and four shared ones
    data = np.frombuffer(b"".join(words) + b"walkin", np.uint8)
    starts = np.cumsum([0, *map(len, words)])
    places = lexicon.places(data, starts, np.array([*map(len, words), 6]))
    assert places.tolist() == [sorted(words).index(w) for w in words] + [-1]


# 8


def test_leaks(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, "x, ONE  two-three four; five six seven eight nine\nten eleven twelve. y"), (2, "one two three four five six seven eight nine ten eleven and twelve"),
        (3, None), (4, ""), (5, LONG + item.lower()), (5, LONG + item.lower()), (6, "one one two three four five six seven eight nine ten eleven twelve"),
    ]
    frame = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item, "s"), (8, "too short", "s"), (9, None, "s"), (10, item, "s")], "item_id long, text string, suite string")
    want = {(d, i) for d in (1, 5, 6) for i in (7, 10)}
    assert {tuple(r) for r in leak.leaked(frame, items).collect()} == want
    assert {tuple(r) for r in leak.leaked(frame, items, max_windows=20).collect()} == want
    assert leak.leaked(frame, items.limit(0)).count() == 0 and leak.leaked(frame.limit(0), items).count() == 0
    held = leak.NgramSet([(7, item)], 12)
    assert leak.remove_spans("before. " + item + "! after", held).split() == ["before.", "!", "after"]


# 9


def test_normal_words():
    for typed, plain in (("bаstаrd", "bastard"), ("s-l-u-t", "slut"), ("motheeeerfucker", "motherfucker"), ("fucki​ng", "fucking"), ("RAT$", "rats"), ("rate", "rate")):
        assert abuse.normal_words(typed)[0] == (plain,)
    assert abuse.normal_words("w***e")[0] == ("*w***e",) and abuse.normal_words("5,000")[0] == ("<n>",)


def labelled(n, seed):
    rng = random.Random(seed)
    calm = ["the court recorded entry {n}", "a tenant paid {n} rupees", "the hearing of {g} is on monday {n}", 'the panel held that "idiot" was an insult in {n}']
    bad = ["you are a stupid idiot {p}", "all {g} are vermin and should go", "shut up you idiot number {n}"]
    people = ["Anil", "Usha", "Omar", "Hema"]
    out = []
    for i in range(n):
        lines = [rng.choice(calm) for _ in range(rng.randrange(2, 6))]
        y = i % 4 == 0
        if y:
            lines.insert(rng.randrange(len(lines)), rng.choice(bad))
        text = "\n".join(x.format(n=rng.randrange(999), g=rng.choice(abuse.GROUPS), p=rng.choice(people)) for x in lines)
        out.append((i, text, int(y)))
    return out


def test_abuse(spark):
    train, test = labelled(240, 1), labelled(200, 2)
    test = [(i + 1000, t, y) for i, t, y in test] + [(5000, None, 0), (5001, "", 0), (5002, LONG + "\nyou are a stupid idiot Anil", 1), (5003, " ", 0)]
    docs = spark.createDataFrame([(i, t, "s", 0.0) for i, t, _ in train + test], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, "a", 1 - y if i % 40 == 7 else y) for i, _, y in train] + [(None, "a", 1), (3, "b", None)], "doc_id long, annotator string, abusive int")
    got = {r.doc_id for r in abuse.to_review(docs, labels).collect()}
    truth = {i for i, _, y in test if y}
    flagged = {i for i in got if i >= 1000}
    assert len(flagged & truth) >= 0.9 * len(truth) and len(flagged - truth) <= 0.05 * len(test)
    rates = abuse.source_rates(docs, labels).first()
    assert rates.n == len(train) + len(test) and 0 < rates.rate < 1
    assert abuse.to_review(docs, labels.limit(0)).count() == 0 and abuse.to_review(docs.limit(0), labels).count() == 0


def test_counterfactual_penalty():
    rows_ = [np.array([1, 2]), np.array([1, 3]), np.array([4, 2]), np.array([4, 3])] * 30
    y = np.array([1.0, 1, 0, 1] * 30)
    pairs = (linear.Rows([np.array([4, 2])]), linear.Rows([np.array([4, 3])]))
    free = linear.Logistic(4).fit(linear.Rows(rows_), y, np.ones(len(y)))
    tied = linear.Logistic(4).fit(linear.Rows(rows_), y, np.ones(len(y)), pairs=pairs, tie=5.0)
    assert abs(tied.w[2] - tied.w[3]) < 0.3 * abs(free.w[2] - free.w[3])


def test_vocabulary_bytes():
    with open(encode.DEFAULT_VOCABULARY, "rb") as f:
        line = f.readline().split()
    assert base64.b64decode(line[0]) and int(line[1]) == 0
