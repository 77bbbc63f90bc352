"""Operators for training data that leave no part of their job out."""

import datetime
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import abuse, canonical, leak, near, queries, survivor, variants
from lexquarry.session import settle

FOLDER = "/root/testdata/sf0.001"
ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen"


def test_frequent_tokens_are_compared(spark):
    names = ["Farida Navnekar v State of Vindra", "F. Navnekr v State of Vidra"]
    names += [f"Farida {w} v State of Vindra" for w in ("Ostrell", "Quimbay", "Tarkhan")] + [f"{w} Navnekar v State of Vindra" for w in ("Gopinath", "Zubeda")]
    names += [f"Meena {w} v Union of Vidra" for w in ("Navnekr", "Holkersen", "Pirzada")]
    rows = [("case_name", n) for n in names] + [("court", n) for n in ("Ruvali High Court", "Ruvli Hgh Court", "Harvel High Court", "Harvl High Cort", "Ruvali HC")]
    rows += [("act_name", n) for n in ("Harvel Drug Prices Act, 1989", "Harvel Drg Pices Act, 1989", "Harvel Drug Prices Act", "Harvel Stamp Act, 1966")]
    frame = spark.createDataFrame(rows, "field_name string, name string")
    hot, warm, cold = ({tuple(r) for r in variants.variant_pairs(frame, hot).collect()} for hot in (0.5, 2, 10**9))
    assert hot == warm == cold
    groups = {(r.field_name, r.name): (r.entity, r.links) for r in variants.variant_groups(frame, 2).collect()}
    assert all(groups[f, a][0] == groups[f, b][0] and groups[f, a][1] > 0 for f, a, b in cold)
    assert ("case_name", "F. Navnekr v State of Vidra", "Farida Navnekar v State of Vindra") in hot


def test_all_forms_that_match_meet(spark):
    fold = {"0": "K. Kumar v Sea Corp", "1": "Kiran K. v Sea Corp", "2": "R K v S M", "3": "Ram Kumar v Sita M.", "4": "State v A B C", "5": "State v Anil Bose Chand"}
    fold |= {"6": "Farida N. v State", "7": "F. Navnekar v State", "8": "R. Kr. v Mohan", "9": "Ram Kumar v M."}
    fold |= {"a": "Ab Cd Ef Ramk Sitk Tarak v Qureshi", "b": "A C E Ramkrish Sitkumar Tarakeshwar v Qureshi"}
    rows = [("case_name", n) for n in fold.values()] + [("court", n) for n in ("R K M Bench", "Rohan Kota M Bench", "R K Z", "Rohan Kota Zed")]
    rows += [("act_name", n) for n in ("B C Act, 1989", "Bose Chand Act, 1989", "Bose Chand D Act, 1989", "B Chand E Act, 1989")]
    frame = spark.createDataFrame(rows, "field_name string, name string")
    parsed = variants._parsed(frame).withColumn("form_no", F.monotonically_increasing_id())
    forms = [(f, variants.parse(f, n)) for f, n in rows]
    want = {(f, *sorted((x.key, y.key))) for f, x in forms for g, y in forms if f == g and x != y and variants.match(f, x, y)}
    assert all(variants.match("case_name", *(variants.parse("case_name", fold[k]) for k in p)) for p in ("01", "10", "23", "45", "67", "89", "ab", "ba"))
    for hot in (1, variants.HOT):
        got = variants._verified(variants._met(settle(parsed, "forms"), hot)).collect()
        assert {(r.field_name, *sorted((r.x, r.y))) for r in got} == want


def test_tokens_are_assigned_at_least_cost():
    words = ["k", "kr", "kumar", "kuma", "kiran", "kirann", "r", "ram", "ramesh", "rumesh", "kumra"]
    draw = random.Random(7)
    for _ in range(400):
        xs, ys = (tuple(draw.choices(words, k=4)) for _ in range(2))
        costs = [[variants.token_cost(x, y) for x, y in zip(xs, p)] for p in itertools.permutations(ys)]
        assert variants.assign(xs, ys) == min((sum(c) for c in costs if None not in c), default=None), (xs, ys)


def test_near_lists_are_cut_without_many_copies(spark, monkeypatch):
    # 40 texts of one frequent vocabulary, lengths 20 to 59, and a copy of each with a word more
    words = [f"w{k}" for k in range(90)]
    draw = random.Random(5)
    texts = [draw.sample(words, 20 + k) for k in range(40)]
    texts += [w + ["more"] for w in texts]
    bags = [Counter(w) for w in texts]
    want = {tuple(sorted((f"{i}", f"{j}"))) for i, x in enumerate(bags) for j, y in enumerate(bags[:i]) if 10 * (x & y).total() >= 4 * (x.total() + y.total())}
    rows = [("t", f"{k}", " ".join(w)) for k, w in enumerate(texts)] + [("t", "0", " ".join(texts[7])), ("t", "twin", " ".join(texts[0])), ("t", "twin", " ".join(texts[7]))]
    for cell, part, most in ((10**6, 128, 1), (4, 128, 3), (1, 128, 3), (4, 3, 99)):
        monkeypatch.setattr(near, "CELL", cell)
        monkeypatch.setattr(near, "_PART", part)
        frame = spark.createDataFrame(rows[:80], "table_name string, id string, text string")
        got = [(r.id_a, r.id_b) for r in near.near_pairs(frame).collect()]
        assert len(got) == len(want) and set(got) == want
        held, cells = near.vectors(frame, 20)
        batches = held.select("table_name", "rid", "m", *near._SIGNS, "rare", "often").toArrow().to_batches()
        posted = sum(b.num_rows for b in near._postings(0.8, cells)(iter(batches)))
        whole = posted if cell == 10**6 else whole
        assert posted <= most * whole, (cell, posted, whole)
    monkeypatch.setattr(near, "_TIMES", 1)  # ordered words that stand in a text more often are held as rare ones
    monkeypatch.setattr(near, "_PART", 128)
    rows += [("t", "more", " ".join(texts[9] + texts[9][:20])), ("t", "yet more", " ".join(texts[9] + texts[9][1:20]))]
    got = [(r.id_a, r.id_b) for r in near.near_pairs(spark.createDataFrame(rows, "table_name string, id string, text string")).collect()]
    assert len(got) == len(set(got)) and want < set(got) and {("0", "twin"), ("7", "twin"), ("0", "7"), ("0", "47"), ("more", "yet more")} <= set(got) and ("9", "more") not in set(got)


def test_tokens_meet_by_the_index():
    words = ["navnekar", "navnekr", "navenkar", "nvnekra", "farida", "fari", "f", "fr", "vindra", "vidra", "ram", "rama", "abcdefghijklmnopqrstuvwxyz", "bacdefghijklmnopqrstuvwxzy", "abcdefghijklmnopqrstuvwx"]
    words += [w + v for w in ("anticonstitution", "ramachandrasekharap") for v in ("", "lly", "al", "la", "aly")] + ["acdbefghijklmnopqrstuv", "abcdefghijklmnopqrstuvw"]
    keys = {w: list(variants._neighbourhood(w)) for w in words}
    for x in words:
        for y in words:
            if x != y and variants.token_cost(x, y) is not None:
                a, b = ({r: {k for q, k in keys[w] if q == r} for r in range(3)} for w in (x, y))
                assert a[0] & b[0] or a[1] & b[2] or a[2] & b[1], (x, y)


def test_truth_of_urls(spark):
    day, at = datetime.date(2020, 1, 1), datetime.datetime(2021, 1, 1)
    rows = [(10 * k + i, "r", u.format(k), "t", day, p, at) for k in range(6) for i, (u, p) in enumerate([("https://a.org/{}", "p"), (" https://a.org/{} ", "q"), ("http://www.A.org:80/{}/#x", "s")])]
    raw = spark.createDataFrame(rows, "ord long, run_id string, url_canonical string, title string, published_at date, provider string, fetched_at timestamp")
    got = {(r.first_ord, r.field): r.value for r in survivor.p6_truth(raw).collect()}
    assert got == {(10 * k, f): v for k in range(6) for f, v in (("title", "t"), ("published_at", "2020-01-01"), ("url_canonical", f"https://a.org/{k}"))}


def test_truth_that_does_not_settle(spark):
    claims = spark.createDataFrame([("o", "f", "v", "a"), ("o", "f", "v", "b"), ("o", "f", "w", "c")], "object string, field string, value string, source string")
    with pytest.raises(RuntimeError, match="did not settle in 1 rounds"):
        survivor.truth_discovery(claims, max_rounds=1)


def test_removal_is_confirmed(monkeypatch):
    monkeypatch.setattr(leak, "window_hashes", lambda ids, n: np.zeros(max(len(ids) - n + 1, 0), np.uint64))
    held = leak.NgramSet([(7, ITEM)], 12)
    swapped = "two one three four five six seven eight nine ten eleven twelve"
    assert leak.remove_spans(swapped, held) == swapped
    assert leak.remove_spans(f"a {ITEM} b", held).split() == ["a", "b"]


def test_cleaned(spark):
    other = " ".join(f"w{i}" for i in range(14))
    docs = [(1, f"x, {ITEM.upper()}. y"), (2, ITEM.replace("six", "and")), (3, None), (4, ""), (5, f"a {other} {ITEM} b"), (5, f"a {other} {ITEM} b")]
    docs += [(6, f"{' '.join(ITEM.split()[:6])} {other} {' '.join(ITEM.split()[6:])}"), (7, "İ " + ITEM)]
    frame = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (10, other)], "item_id long, text string")
    want = [(1, "x,. y"), (2, docs[1][1]), (3, None), (4, ""), (5, "a b"), (5, "a b"), (6, ITEM.replace(" seven", "  seven")), (7, "İ")]
    plain = lambda rows: sorted((r.doc_id, r.text and " ".join(r.text.replace(" .", ".").split())) for r in rows)
    for room in (leak.MAX_WINDOWS, 20):
        assert plain(leak.cleaned(frame, items, max_windows=room).collect()) == [(k, t and " ".join(t.split())) for k, t in want]
    assert plain(leak.cleaned(frame, items.limit(0)).collect()) == sorted((k, t and " ".join(t.replace(" .", ".").split())) for k, t in docs)


def test_cleaned_documents_leak_nothing(spark):
    documents, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "eval_item"))
    cleaned = queries.QUERIES["p8_cleaned"](spark, FOLDER)
    assert cleaned.count() == documents.count()
    leaky = {r.doc_id for r in leak.leaked(documents, items).collect()}
    changed = {r.doc_id for r in cleaned.join(documents.withColumnRenamed("text", "was"), "doc_id").where("not text <=> was").collect()}
    assert changed == leaky


def test_groups_named_by_the_texts():
    texts = [f"all wexholmers are late {i}. They spoke against those hill farmers; all of us went." for i in range(3)]
    assert [g for g in abuse.groups_in(texts) if g not in abuse.GROUPS] == ["hill farmers", "wexholmers"]
    swap = abuse.Swapper(["old people", "wexholmers"], {"anil"})
    assert swap("the court sat".split(), random.Random(1)) is None
    seen = {" ".join(swap("some old people met".split(), random.Random(i))) for i in range(20)}
    assert seen == {"some old people met", "some wexholmers met"}


def test_a_group_is_not_taken_for_abuse():
    """A group that stands only in abusive training documents scores nearer to others in neutral sentences held out."""
    rng = random.Random(4)
    docs = []
    for i in range(240):
        lines = [f"the court recorded entry {rng.randrange(99)} for {rng.choice(['women', 'farmers', 'students'])}" for _ in range(3)]
        if i % 4 == 0:
            lines.insert(rng.randrange(4), f"all {'wexholmers' if i % 8 else rng.choice(['women', 'farmers'])} are vermin and should go")
        docs.append(("\n".join(lines), float(i % 4 == 0), 1.0))
    held = abuse.Words()

    def gap(tie):
        model = abuse.fit(docs, tie=tie)
        score = lambda t: float(model.w[abuse.sentence_row(held.sentences(t)[0], held)].sum())
        frames = ["the tribunal heard {} on monday", "a report by {} was filed", "the court recorded entry 7 for {}"]
        return np.mean([abs(score(f.format("wexholmers")) - score(f.format(g))) for f in frames for g in ("women", "farmers")])

    assert gap(3.0) < 0.6 * gap(0.0)


def test_a_form_of_two_entries_maps_to_none():
    twice = canonical.GramIndex([("kind", "over view"), ("kind", "overview")], {"kind": Counter()})
    assert twice.best("kind", "Over  View") == [(1.0, "over view"), (1.0, "overview")]
