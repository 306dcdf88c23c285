"""Text scalars against cases of their definitions, and against a plain Python reading of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions import text as tx

CLAUSES = [
    ("The library hands its loan lists on and shares borrower names with couriers", "share", True), ("Loan lists are kept here; we do not release them", "share", False), ("Borrower names will never be disclosed", "share", False),
    ("The archive does not forward notes except to its auditors", "share", True), ("We do not print bills at night. Couriers get a copy when we share routes.", "share", True),
    ("a receipt is shared with you at the desk", "share", False), ("The museum does not lend maps, but it shares sketches with schools", "share", True),
    ("At the gate we gather ticket numbers", "collect", True), ("No guard may enter, and we do not gather ticket numbers", "collect", False), ("The kiosk captures nothing", "collect", True),
    ("In spring we sell visitor records to bakers", "sale", True), ("We do not sell visitor records.", "sale", False),
    ("Ask the desk and we will cease selling your visitor records.", "sale", False), ("The shop sells lamps and rugs.", "sale", False),
    ("we never trade guest data unless a guest signs the form", "sale", True),
    ("At the fair, third parties gather stamps of visitors", "tpc", True), ("At the fair, third parties do not gather stamps", "tpc", False),
    ("On this website, sponsors track browsing of the menu.", "tpc", True), ("Sponsors track lorries.", "tpc", False),
    ("The menu page of our site loads tags operated by analytics companies which note usage.", "tpc", True),
    ("We obtain usage figures through third-party apps.", "tpc", True), ("We gather your seat number.", "tpc", False), ("", "share", False),
]


@pytest.fixture(scope="module")
def clauses(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CLAUSES)], "i int, s string, kind string, want boolean")
    s = F.col("s")
    got = F.when(F.col("kind") == "share", tx.positive_sharing(s)).when(F.col("kind") == "collect", tx.positive_collection(s)).when(F.col("kind") == "sale", tx.implicit_sale(s)).otherwise(tx.third_party_collects(s))
    return df.select("i", got.alias("got")).collect()


def test_clause_predicates(clauses):
    wrong = [CLAUSES[r["i"]] for r in clauses if r["got"] != CLAUSES[r["i"]][2]]
    assert not wrong


@pytest.mark.parametrize("pattern,hits,misses", [
    (lx.CATEGORY, ["two sponsors", "marketing agencies", "a subcontractor", "credit bureau", "billing gateways", "social network"], ["we advertise lamps", "a cloudy day"]),
    (lx.GENERIC, ["a third party", "3rd-party", "unrelated firms", "other entities", "external bodies"], ["another page", "the first party"]),
    (lx.SHARING, ["it forwards the list", "lists were released", "provided with a copy", "handed on", "they work with printers"], ["it provides heat", "shareholders"]),
    (lx.COLLECTION, ["it captures voices", "sets cookies", "using web beacons", "serves ads"], ["collection of poems", "a set of plates"]),
])
def test_lexicons(pattern, hits, misses):
    assert all(re.search(pattern, h) for h in hits)
    assert not any(re.search(pattern, m) for m in misses)


def test_match_spans_and_windows(spark):
    text = "They release notes. Notes released late, never releasing more."
    r = spark.createDataFrame([(text,), ("",), (None,)], "s string").select(
        tx.match_spans(F.col("s"), lx.SHARING).alias("m"), tx.clause_window(F.lit("a clerk waits at noon. Nobody comes."), F.lit(0), 200).alias("w")
    ).collect()
    assert [x["start"] for x in r[0]["m"]] == [m.start() for m in re.finditer(lx.SHARING, text)]
    assert r[1]["m"] == [] and r[2]["m"] is None
    assert r[0]["w"] == "a clerk waits at noon"


def test_segmentation(spark):
    r = spark.createDataFrame([("a b.\nc\nd e\n\nxy\n" + "long " * 100,)], "t string").select(
        tx.reflow("t" if False else F.col("t")).alias("r"), tx.dedupe_adjacent(F.array(*map(F.lit, ["a", "a", "b", "a"]))).alias("d"),
        tx.sentence_segments(F.array(F.lit("One. Two! " * 80), F.lit("short. text"))).alias("s"), tx.split_sentences(F.lit("A b. C d? E")).alias("p"),
        tx.join_lead_in(F.lit("Bring along:"), F.lit("spoons")).alias("j1"), tx.join_lead_in(F.lit("Bring along"), F.lit("spoons")).alias("j2"), tx.join_lead_in(F.lit(""), F.lit("x")).alias("j3"),
    ).first()
    assert r["r"] == ["a b.", "c d e", "xy " + ("long " * 100).strip()]
    assert tx.reflowed("") == [] and tx.reflowed("\n\n ab\n") == []
    many = tx.reflowed("\n".join(["word"] * 200_000))
    assert " ".join(many).count("word") == 200_000 and max(map(len, many)) <= 410
    assert r["d"] == ["a", "b", "a"]
    assert len(r["s"]) == 161 and r["s"][-1] == "short. text"
    assert r["p"] == ["A b.", "C d?", "E"]
    assert (r["j1"], r["j2"], r["j3"]) == ("Bring along: spoons", "Bring along: spoons", "x")


def test_kinds_labels_purposes(spark):
    ads = "# edition 4\nlampmarket.example, 77, DIRECT, ab\nrugfair.example, 8, RESELLER\n"
    rows = [(ads, "ads_txt"), ('{"sellers": [{"seller_id": "9"}]}', "sellers_json"), ('{"vendorListVersion": 5, "vendors": {}}', "tcf_gvl"), ('{"vendors": [{"name": "Lamp"}]}', "vendors_json"), ("Dear reader", ""), ("", "")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", tx.machine_readable_kind(F.col("t")).alias("got")).collect())
    one = spark.range(1)
    p = one.select(*[tx.purposes_of(F.lit(x)).alias(f"p{i}") for i, x in enumerate(["a spring campaign with coupons", "weekly statistics of the hall", "alarm against fraud at the till", "checkout of a basket", "", "statistics of a campaign"])]).first()
    assert [p[i] for i in range(6)] == [["advertising"], ["analytics"], ["security"], ["services"], [], ["advertising", "analytics"]]
    lab = one.select(tx.platform_label(F.lit("Data safety of Lamp Fair: no data shared with third parties"), F.lit("")).alias("a"), tx.platform_label(F.lit("App Privacy of Lamp Fair. Data linked to you: seat"), F.lit("")).alias("b"), tx.platform_label(F.lit("text"), F.lit("")).alias("c"), tx.platform_label(F.lit("x"), F.lit("play_data_safety")).alias("e")).first()
    assert (lab["a"]["shares"], lab["b"]["shares"], lab["c"]["has_label"], lab["e"]["shares"]) == (False, True, False, True)


def test_jaccard_of_nothing(spark):
    e = F.array().cast("array<string>")
    r = spark.range(1).select(tx.jaccard(e, e).alias("a"), tx.jaccard(F.array(F.lit("x")), e).alias("b"), tx.jaccard(F.lit(None).cast("array<string>"), e).alias("c"), tx.jaccard(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"))).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1.0, 0.0, 1.0, 0.5)
