"""Cases of the review: each failed before its finding was settled."""

import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessella.llm import leakage, names, neardup, residue, visual


@pytest.mark.parametrize("text,bit", [
    ("This site can't be reached", 8), ("The requested resource cannot be displayed", 8), ("This document cannot be shown", 8), ("That file has expired", 8), ("Stacktrace", 8), ("EXCEPTION in thread main", 8),
    ("JAVA SCRIPT désactivé", 8), ("12345 12345 12345", 4), ("The requested topic is shown to partners", 0),
])
def test_short_lines_are_tried_on_all_patterns(text, bit):
    assert residue.flag_line(text) & (bit or 31) == bit


@pytest.mark.parametrize("finder", [residue._FIND_FILLER, residue._FIND_MESSAGE, residue._FIND_DETAIL])
def test_lookup_passes_every_alternative(finder):
    alts = residue._alternatives(finder.pattern.pattern)
    assert len(alts) > 10 and sum(re.compile(a, re.I).groups for a in alts) == finder.pattern.groups

    @settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.sampled_from(alts).flatmap(lambda a: st.from_regex(re.compile(a, re.I))))
    def check(text):
        assert finder.search(text, text.lower()) == bool(finder.pattern.search(text))

    check()


def test_dense_regions_lose_no_pair(spark):
    rnd = random.Random(3)
    base = [f"t{rnd.randrange(900)}" for _ in range(160)]
    rows = [(f"d{i:03}", " ".join(f"e{i}x{j}" if rnd.random() < 0.065 else w for j, w in enumerate(base))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    pairs = lambda region: {tuple(r) for r in neardup.near_duplicates(df, shingle=3, threshold=0.6, region=region).pairs().collect()}
    got = pairs(4)
    assert got == pairs(10**6)
    sets = {i: set(zip(w, w[1:], w[2:])) for i, t in rows for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert len(want) > 400 and got <= want and len(got) >= 0.99 * len(want)


def test_sketches_agree_as_bytes(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, 240, dtype=np.uint32)
    rows = []
    for share in (0.0, 0.3, 0.7, 1.0):
        b = np.where(rng.random(240) < share, a, rng.integers(0, 1 << 32, 240, dtype=np.uint32)).astype(np.uint32)
        rows.append((neardup._packed(a).tolist(), neardup._packed(b).tolist(), int(((a & 255) == (b & 255))[: neardup.SKETCH].sum())))
    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, n int")
    assert df.where(f"{neardup._agree('x', 'y')} <> n").count() == 0


def classes(spark, strings):
    return {r["name"]: r["class_id"] for r in names.link_names(spark.createDataFrame([(x,) for x in strings], "name string")).collect()}


COMPANIONS = [f"{a}{b}" for a in ("Zortu", "Plixe", "Quandi", "Wexal", "Brinto", "Hulve", "Jasti", "Kopra", "Lumfi", "Mirdo") for b in ("man", "rel", "dok", "vix", "gup", "tis", "bon", "zaf", "lem", "cor")]


def test_frequent_typo_of_a_common_word_is_linked(spark):
    got = classes(spark, [f"{c} Spindle" for c in COMPANIONS] + [f"{c} Sipndle" for c in COMPANIONS[:9]])
    assert all(got[f"{c} Spindle"] == got[f"{c} Sipndle"] for c in COMPANIONS[:9]) and len(set(got.values())) == len(COMPANIONS)


def test_few_names_of_two_words_stay_apart(spark):
    got = classes(spark, [f"{c} {w}" for c in COMPANIONS[::17] for w in ("Gable", "Sable")])
    assert len(got) == len(set(got.values())) == 12


def test_word_with_spellings_of_its_own_stays_apart(spark):
    forms = ["Zortuman {} GmbH", "Zortuman {}", "zortuman {} Ltd", "{}, Zortuman", "ZORTUMAN {} Inc.", "Zortuman  {} Media"]
    got = classes(spark, [f.format(w) for f in forms for w in ("Gable", "Sable")] + [f"{c} Gable" for c in COMPANIONS[1:90]])
    assert got["Zortuman Gable"] != got["Zortuman Sable"] and len(set(got.values())) == 91


LONG = "We keep records of visits for a season and hand some of them to partners whenever the law asks for it, as the section on partners explains in more detail below. "


@pytest.mark.parametrize("filler", [
    "This is dummy text for the layout.", "Lorem Ipsum", "LOREM IPSUM", "BLINDTEXT", "Placeholder Copy", "YOUR TEXT GOES HERE", "Ceci est un texte de remplissage.", "Texto de relleno", "Please replace this paragraph.",
    "The writer will supply the rest.", "Sample page.", "Heading two.", "words words words",
])
def test_filler_in_long_blocks(filler):
    for text in (LONG + filler, filler + " " + LONG, LONG + filler + " " + LONG):
        assert len(text) > 160 and residue.flag_line(text) & 4
    assert residue.flag_line(LONG * 2) == 0


def brute(sets, threshold):
    ids = sorted(sets)
    vocab = {g: k for k, g in enumerate(sorted({g for x in sets.values() for g in x}))}
    m = np.zeros((len(ids), len(vocab)), np.float32)
    for j, i in enumerate(ids):
        m[j, [vocab[g] for g in sets[i]]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    both, n = both.astype(float), n.astype(float)
    a, b = np.nonzero(np.triu(both / (n[:, None] + n[None, :] - both) >= threshold, 1))
    return {(ids[x], ids[y]) for x, y in zip(a, b)}


def test_recall_at_the_threshold_in_a_region_of_thousands(spark):
    """2,000 edits of one text, of similarity about 0.6 to each other, among texts of their own: one region of every tree."""
    rnd = random.Random(8)
    base = [f"t{rnd.randrange(900)}" for _ in range(150)]
    rows = [(f"d{i:04}", " ".join(f"e{i}x{j}" if rnd.random() < 0.042 else w for j, w in enumerate(base))) for i in range(1200)]
    rows += [(f"z{i:04}", " ".join(f"u{rnd.randrange(5000)}" for _ in range(130))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {(r["a"], r["b"]) for r in neardup.near_duplicates(df, shingle=3, threshold=0.6).links.select("a", "b").collect()}
    want = brute({i: set(zip(w, w[1:], w[2:])) for i, t in rows for w in [t.split()]}, 0.6)
    assert len(want) > 50_000 and got <= want and len(got) >= 0.95 * len(want)


def test_regions_adapt_their_depth():
    label = lambda *v: sum(x << (48 - 16 * k) for k, x in enumerate(v))
    rows = [(0, label(1, 1, 1, 1)), (0, label(1, 2, 1, 1)), (0, label(2, 1, 1, 1)), (0, label(2, 1, 1, 1)), (0, label(2, 1, 1, 2)), (0, label(2, 1, 2, 1)), (0, label(2, 2, 1, 1)), (0, label(2, 3, 1, 1)), (1, label(2, 3, 1, 1))]
    no, size = neardup._regions(np.array([t for t, _ in rows]), np.array([x for _, x in rows], np.int64), 4)
    # two labels share one value only and are a region; six that do are cut at the second value, where four and one and one are left
    assert no.tolist() == [0, 0, 1, 1, 1, 1, 2, 3, 4] and size.tolist() == [2, 4, 1, 1, 1]
    no, size = neardup._regions(np.array([t for t, _ in rows]), np.array([x for _, x in rows], np.int64), 1)
    assert no.tolist() == [0, 1, 2, 2, 3, 4, 5, 6, 7]


def test_near_duplicates_with_ids_of_either_kind_and_small_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    base = [[f"w{rnd.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = [(k, " ".join(w if rnd.random() > 0.02 else "x" for w in base[k % 12])) for k in range(120)] + [(200, None), (201, ""), (202, "a b"), (3, " ".join(base[3]))]
    df = spark.createDataFrame(rows[:-1], "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("key", F.lit("k"))
    sets = {i: set(zip(*(w[k:] for k in range(5)))) for i, t in rows[:-1] if t for w in [t.split()] if len(w) >= 5}
    want = brute(sets, 0.8)
    for region in (64, 2):
        got = {tuple(r) for r in neardup.near_duplicates(df, region=region).pairs().collect()}
        assert got <= want and len(got) >= 0.99 * len(want)
    assert neardup.near_duplicates(df.limit(0)).pairs().count() == 0


def test_hot_text_with_an_odd_variant(spark):
    """Copies collapse before texts are paired."""
    rows = [(i, "Page one") for i in range(3000)] + [(9000, "P\u0430ge one"), (9001, "page one"), (9002, "\u13e2age \u2c9fne"), (9003, "Rage one"), (9004, "\u13a1age one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in visual.same_look_pairs(df).collect()}
    assert got == {(i, j) for i in range(3000) for j in (9000, 9002)} | {(9000, 9002), (9003, 9004)}


def test_wand_equals_scoring_all(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(80)]
    items = [(k, [rnd.choice(words) if rnd.random() < 0.8 else f"r{rnd.randrange(300)}" for _ in range(rnd.randrange(12, 60))], [f"a{k}"]) for k in range(150)]
    ix = leakage.PassageIndex(items)
    score = lambda k, ts: sum(float(x) for t in ts for i, x in zip(ix.item[ix.term_at[t] : ix.term_at[t + 1]], ix.impact[ix.term_at[t] : ix.term_at[t + 1]]) if i == k)
    for _ in range(200):
        terms = sorted(set(rnd.sample(range(len(ix.vocab)), rnd.randrange(1, 15))) | set(rnd.choice(ix.seqs).tolist()[:5]))
        for theta in (0.3, 0.7, 1.0):
            assert sorted(ix.search(terms, theta)) == [k for k in range(150) if score(k, terms) >= theta - 1e-4]


def test_overlap_of_question_and_answer(spark):
    words = [f"q{k}" for k in range(24)]
    items = spark.createDataFrame([(1, " ".join(words), "Yes, it is"), (2, " ".join(words[::-1]), None), (3, "too short", "x")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, " ".join(words).upper() + " yes IT is"), (2, "a " + " ".join(words[:15]) + " b yes it"), (3, " ".join(words[:11])), (4, None), (5, "z " + " ".join(words[::-1]))], "doc_id long, text string")
    for block in (1_000_000, 5):
        got = sorted((r["doc_id"], r["item_id"], round(r["question_overlap"], 3), r["answer_found"]) for r in leakage.leaks(docs, items, block_words=block).collect())
        assert got == [(1, 1, 1.0, True), (2, 1, round(4 / 13, 3), False), (5, 2, 1.0, None)]
    assert leakage.leaks(docs, items, answer=None).where("answer_found IS NOT NULL").count() == 0


def test_sliced_join(spark):
    from tessella.llm.util import sliced_join

    a = spark.createDataFrame([("k", 1), ("l", 2), (None, 3)], "key string, x int")
    b = spark.createDataFrame([("k", i) for i in range(50)] + [("l", 1), (None, 1)], "key string, y int")
    for block in (7, 1000):
        got = sorted((r["key"], r["x"], r["y"]) for r in sliced_join(a, b, "key", "y", block).collect())
        assert got == sorted([("k", 1, i) for i in range(50)] + [("l", 2, 1)])
