"""Visual forms, leakage, near-duplicates: against brute force, with nulls, empty texts, copies, ties and clashing columns."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import leakage, neardup, visual


@pytest.mark.parametrize("a,b", [
    ("Café", "Café"), ("Ａｂｃ１２", "Abc12"), ("ﬁle", "file"), ("pa​ge", "page"), ("a b", "a b"), ("Раge", "Page"), ("Неllo", "Hello"), ("o­k", "ok"),
    ("a\r\nb", "a\nb"), ("а́", "á"), ("Å", "Å"),
])
def test_same_look(a, b):
    assert visual.visible(a) == visual.visible(b) and visual.folded(a) == visual.folded(b)


@pytest.mark.parametrize("a,b", [("page", "Page"), ("café", "cafe"), ("m²", "m2"), ("straße", "strasse"), ("a b", "ab"), ("a b", "a\nb"), ("10", "1O"), ("½", "1/2"), ("a  b", "a b")])
def test_other_look(a, b):
    assert visual.visible(a) != visual.visible(b)


def test_folding():
    assert visual.folded("STRASSE") == visual.folded("straße") and visual.folded("①") == "1" and visual.visible(None) is None and visual.folded("") == ""


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_stable(s):
    v = visual.visible(s)
    assert visual.visible(v) == v
    assert visual._SUSPECT.search(s) or v == s
    f = visual.folded(s)
    assert visual.folded(f) == f


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(1, 0x17F)] + list("–—‘’“”•€…"), max_size=20))
def test_fast_path_equals_slow_path(s):
    slow = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s.replace("\r\n", "\n").replace("\r", "\n")).translate(visual._TABLE))
    assert visual.visible(s) == slow


def test_pairs_and_classes(spark):
    rows = [(1, "Page one"), (2, "Pаge one"), (3, "page one"), (4, None), (5, ""), (6, "​"), (7, "Page one"), (7, "Page one"), (8, "x" * 200_000), (9, "x" * 199_999 + "ｘ"), (None, "Page one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("raw_key", F.lit(1)).withColumn("id", F.lit("z"))
    got = sorted(tuple(r) for r in visual.same_look_pairs(df).collect())
    assert got == [(1, 2), (2, 7), (5, 6), (8, 9)]
    c = {(r["id"], r["class_id"], r["n_members"], r["n_spellings"]) for r in visual.same_look_classes(df).collect()}
    assert (2, 1, 4, 2) in c and (3, 3, 1, 1) in c
    assert visual.same_look_pairs(df.limit(0)).count() == 0
    r = df.where("doc_id = 2").select(visual.visible_form("text").alias("v"), visual.folded_form("text").alias("f")).first()
    assert (r["v"], r["f"]) == ("Page one", "page one")


def test_hot_group_is_split(spark):
    from tessella.llm.util import group_pairs

    df = spark.createDataFrame([("k", i) for i in range(60)] + [("l", 1), (None, 2), (None, 3)], "k string, i int")
    got = {tuple(r) for r in group_pairs(df, "k", "i", ["i"], block=7).select("i_a", "i_b").collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}


WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "to"] * 5


def brute_leaks(docs, items, n=12):
    w = lambda t: re.findall(r"[^\W_]+", visual.folded(t)) if t else []
    grams = lambda t: {tuple(w(t)[i : i + n]) for i in range(len(w(t)) - n + 1)}
    return sorted({(d, i) for d, t in docs for i, s in items if d is not None and i is not None and t and s and grams(t) & grams(s)})


def test_leakage_against_brute_force(spark):
    rnd = random.Random(5)
    item = lambda: " ".join(rnd.choice(WORDS) if rnd.random() < 0.7 else f"name{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 50)))
    items = [(i, item()) for i in range(120)] + [(500, None), (501, ""), (502, "short one"), (None, "x " * 20)]
    items.append((503, items[3][1]))
    docs = []
    for d in range(260):
        body = [rnd.choice(["alpha", "beta", "gamma", *WORDS]) for _ in range(rnd.randrange(0, 90))]
        if rnd.random() < 0.6:
            w = items[rnd.randrange(120)][1].split()
            n = rnd.choice([8, 11, 12, 13, 20, 60])
            a = rnd.randrange(max(1, len(w) - n + 1))
            cut = w[a : a + n]
            style = rnd.randrange(4)
            cut = [x.upper() for x in cut] if style == 1 else [x + rnd.choice([",", ";", " -"]) for x in cut] if style == 2 else [x.replace("a", "а").replace("n", "n​") for x in cut] if style == 3 else cut
            k = rnd.randrange(len(body) + 1)
            body[k:k] = cut
        docs.append((d, rnd.choice([" ", "\n", " "]).join(body)))
    docs += [(900, None), (901, ""), (902, items[3][1] + " zz " + items[3][1])]
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("d", F.lit(1))
    ii = spark.createDataFrame(items, "item_id long, text string").withColumn("i", F.lit(1))
    want = brute_leaks(docs, items)
    assert want
    assert sorted(tuple(r) for r in leakage.leaked_items(dd, ii).collect()) == want
    assert sorted(tuple(r) for r in leakage.leaked_items(dd, ii, block_words=200).collect()) == want
    assert leakage.leaked_items(dd, ii.limit(0)).count() == 0 and leakage.leaked_items(dd.limit(0), ii).count() == 0


def test_index_loses_no_item():
    rnd = random.Random(2)
    items = [(i, [rnd.choice(WORDS) for _ in range(rnd.randrange(12, 40))]) for i in range(80)]
    ix = leakage.PassageIndex(items)
    for k, (_, w) in enumerate(items):
        for j in range(len(w) - 11):
            assert k in ix.search(sorted({ix.vocab[x] for x in w[j : j + 12]}))


def brute_pairs(rows, k, t, least):
    s = {}
    for i, x in rows:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if x is not None and len(w) >= max(k, least):
            s[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= t}


def edited(rnd, w, rate):
    out = []
    for x in w:
        r = rnd.random()
        if r < rate / 3:
            continue
        out.append(f"e{rnd.randrange(99)}" if r < 2 * rate / 3 else x)
        if r > 1 - rate / 3:
            out.append("ins")
    return out


@pytest.mark.parametrize("k,t,region", [(3, 0.6, 64), (5, 0.8, 64), (3, 0.6, 3)])
def test_near_duplicates_against_brute_force(spark, k, t, region):
    rnd = random.Random(11)
    rows = []
    for g in range(14):
        base = [f"t{rnd.randrange(900)}" for _ in range(rnd.randrange(125, 220))]
        for c in range(rnd.randrange(1, 7)):
            rows.append((f"g{g:02}c{c}", " ".join(edited(rnd, base, rnd.choice([0.0, 0.01, 0.03, 0.1])))))
    rows += [("n1", None), ("n2", ""), ("n3", "too short"), ("n4", "A " * 130), ("n5", "a " * 140)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("id", F.lit(0)).withColumn("rep", F.lit(0))
    r = neardup.near_duplicates(df, shingle=k, threshold=t, min_words=120, region=region)
    got = [tuple(x) for x in r.pairs().select("id_a", "id_b").collect()]
    want = brute_pairs(rows, k, t, 120)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= (0.97 if region == 64 else 0.9) * len(want)
    cls = {x["id"]: x["class_id"] for x in r.classes().collect()}
    assert all(cls[a] == cls[b] for a, b in got) and cls["n4"] == cls["n5"] and "n3" not in cls


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    r = neardup.near_duplicates(df)
    assert r.pairs().count() == 0 and r.classes().count() == 0
