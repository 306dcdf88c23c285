import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessella.operators import annotate, evaluate, labels, report, typology
from tessella.functions import entities as en


def test_latency_percentile(spark):
    rows = [("a", float(i)) for i in range(20)] + [("b", 0.5)] + [("c", 2.0)] * 7 + [("d", None)]
    df = spark.createDataFrame(rows, "k string, seconds double")
    got = {r["k"]: r for r in evaluate.latency(df, by=["k"]).collect()}
    assert got["a"]["p95"] == 19.0 and got["b"]["p95"] == 0.5 and got["c"]["p95"] == 2.0 and got["b"]["under"] == 1.0 and abs(got["a"]["mean"] - 9.5) < 1e-9 and "d" not in got
    assert tuple(evaluate.latency(df.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 1.0)
    rnd = random.Random(0)
    xs = [round(rnd.random() * 3, 1) for _ in range(137)]
    r = evaluate.latency(spark.createDataFrame([(x,) for x in xs], "seconds double")).first()
    assert r["p95"] == sorted(xs)[min(len(xs) - 1, int(0.95 * len(xs)))]


def test_relevance_and_agreement(spark):
    p = spark.createDataFrame([("t", "1", True, ["a"]), ("t", "2", False, []), ("u", "3", True, ["b", "a"])], "target_id string, doc_id string, relevant boolean, facets array<string>")
    g = spark.createDataFrame([("t", "1", 1), ("t", "2", 1), ("u", "3", 0), ("u", "9", 1), ("v", "8", 0)], "target_id string, doc_id string, gold int")
    r = evaluate.relevance(p, g).first()
    assert (r["tp"], r["fn"], r["fp"], r["targets"], r["complete"]) == (1, 2, 1, 2, 0) and abs(r["recall"] - 1 / 3) < 1e-9
    assert evaluate.relevance(p.limit(0), g.limit(0)).first()["recall"] == 0.0
    gold = spark.createDataFrame([("t", ["a"]), ("u", ["a", "c"]), ("w", [])], "target_id string, facets array<string>")
    a = evaluate.agreement(p, gold).first()
    assert (a["n"], a["exact"]) == (2, 1) and abs(a["mean_jaccard"] - (1 + 1 / 3) / 2) < 1e-9
    only = spark.createDataFrame([("t", "2")], "target_id string, doc_id string")
    assert evaluate.agreement(p, gold, only).first()["exact"] == 0
    s = evaluate.summary(evaluate.coverage(spark.createDataFrame([(True,), (False,)], "classified boolean")), "coverage", 0.9, "Coverage").first()
    assert s["summary"].startswith("Coverage: 50.0%") and not s["passed"]
    pr = spark.createDataFrame([(str(i), True) for i in range(30)], "clause_id string, correct boolean")
    assert evaluate.propagation(pr).first()["passed"] and not evaluate.propagation(pr.limit(29)).first()["passed"]
    types, onto = spark.createDataFrame([("Email ",), ("email",), ("zz",), (None,)], "data_type string"), spark.createDataFrame([("email",)], "name string")
    o = evaluate.ontology_accommodation(types, onto).first()
    assert (o["n"], o["known"], o["missing"]) == (2, 1, 1) and [r["name"] for r in evaluate.unknown_data_types(types, onto).collect()] == ["zz"]


def test_gold_sheets(spark):
    rel = spark.createDataFrame([("1", "t", "a", "1"), ("1", "t", "b", "0"), ("1", "t", "c", ""), ("2", "u", "d", None), ("2", "u", "e", "x")], "label_order string, target_id string, doc_id string, gold_relevant string")
    assert {(r["doc_id"], r["gold"]) for r in labels.relevance_gold(rel).collect()} == {("a", 1), ("b", 0)}
    typ = spark.createDataFrame([("t", "a", "x;y"), ("t", "b", " y ; z"), ("u", "c", "none"), ("v", "d", " ")], "target_id string, doc_id string, gold_facets string")
    assert {r["target_id"]: r["facets"] for r in labels.typology_gold(typ).collect()} == {"t": ["x", "y", "z"], "u": []}
    pres = spark.createDataFrame([(1, "t", "yes"), (2, "t", "0"), (3, "u", "TRUE"), (4, "v", "")], "_row int, target_id string, gold_pp_present string")
    assert {r["target_id"]: r["present"] for r in labels.presence_gold(pres, "gold_pp_present").collect()} == {"t": False, "u": True}
    order = labels.shuffled_targets(rel)
    assert sorted(r["label_order"] for r in order.collect()) == [1, 2]
    more = spark.createDataFrame([(f"x{i}",) for i in range(9)] + [("t",), ("u",)], "target_id string")
    again = {r["target_id"]: r["label_order"] for r in labels.shuffled_targets(more, spark.createDataFrame([("u", "1"), ("t", "2")], "target_id string, label_order string")).collect()}
    assert again["u"] < again["t"] and sorted(again.values()) == list(range(1, 12))
    steps = labels.target_steps(rel, typ, spark.createDataFrame([("t", "1", "0")], "target_id string, gold_pp_present string, gold_list_present string"), spark.createDataFrame([("t", "1"), ("t", "")], "target_id string, gold_correct string"))
    t = {r["target_id"]: r for r in steps.collect()}["t"]
    assert (t["docs_done"], t["docs_total"], t["s1"], t["s3"], t["clauses_total"], t["clauses_done"]) == (2, 3, False, True, 2, 1)
    assert {r["goal"] for r in labels.progress(steps).collect()} == set(labels.LABEL_GOALS)


def test_sheets_keep_gold(spark):
    c = spark.createDataFrame([("t", "a", "prose", True, "e" * 300, "privacy_policy", "u", "website", ["x"])], "target_id string, doc_id string, medium string, relevant boolean, evidence string, role string, url string, target_type string, facets array<string>")
    first = labels.relevance_sheet(c)
    assert first.columns == list(labels.RELEVANCE) and len(first.first()["predicted_evidence"]) == 200
    again = labels.relevance_sheet(c, first.withColumn("gold_relevant", F.lit("1")).withColumn("notes", F.lit("n"))).first()
    assert (again["gold_relevant"], again["notes"], again["label_order"]) == ("1", "n", "1")
    manual = spark.createDataFrame([("t", "m1", "https://x", "manual"), ("t", "m1", "https://x", "manual")], "target_id string, doc_id string, url string, role string")
    assert labels.reconcile_manual_docs(labels.reconcile_manual_docs(first, manual), manual).count() == 2
    pres = spark.createDataFrame([], ", ".join(f"{x} string" for x in labels.PRESENCE))
    assert labels.ensure_presence_rows(labels.ensure_presence_rows(pres, first), first).count() == 1


SENTENCES = [
    ("We share your email address with advertisers.", {("we", "email address", "COLLECT", "collect"), ("advertiser", "email address", "COLLECT", "be_shared")}),
    ("We do not sell your personal information.", {("unspecified third party", "personal information", "NOT_COLLECT", "be_sold")}),
    ("We do not collect location data.", {("we", "geolocation", "NOT_COLLECT", "collect")}),
    ("Do you collect cookies?", set()), ("", set()),
    ("We collect your name and email address.", {("we", "person name", "COLLECT", "collect"), ("we", "email address", "COLLECT", "collect")}),
]


def test_graph_sentences(spark):
    df = spark.createDataFrame([(str(i), 0, s) for i, (s, _) in enumerate(SENTENCES)] + [("sub", 0, "We collect personal information such as your email address and phone number."), ("kid", 0, "We collect names from children.")], "doc_id string, sent_id int, text string")
    nodes, edges = annotate.build_graphs(df)
    got = {}
    for r in edges.collect():
        got.setdefault(r["graph_id"], set()).add((r["src"], r["dst"], r["etype"], r["action"]))
    for i, (s, want) in enumerate(SENTENCES):
        assert got.get(str(i), set()) == want, s
    assert {x[:2] for x in got["sub"] if x[2] == "SUBSUME"} == {("personal information", "email address"), ("personal information", "phone number")}
    assert edges.where("graph_id = 'kid'").first()["subject"] == "child" and nodes.where("ntype = 'DATA'").count() > 0


def test_lists_pointers_and_cycles_in_graphs(spark):
    page = "<h1>Notice</h1><p>We collect:</p><ul><li>your email address</li><li>phone numbers</li></ul><p>We collect your location. We share this information with advertisers.</p><p>Identifiers include device codes. Device codes include identifiers.</p>"
    df = spark.createDataFrame([("d", page), ("n", None)], "doc_id string, raw string")
    nodes, edges = annotate.build_graphs(annotate.document_sentences(df))
    got = {(r["src"], r["dst"], r["etype"]) for r in edges.collect()}
    assert {("we", "email address", "COLLECT"), ("we", "phone number", "COLLECT"), ("we", "geolocation", "COLLECT"), ("advertiser", "geolocation", "COLLECT")} <= got
    assert len({x for x in got if x[2] == "SUBSUME"}) == 1  # the second would close a cycle
    assert nodes.where("name = 'geolocation' AND ntype = 'DATA'").count() == 1
    many = "We share names such as " + ", ".join(f"{chr(97 + i)}lpha codes" for i in range(15)) + " and zeta codes."
    assert len([e for e in annotate.tag_sentence(many) if e[4] == "SUBSUME"]) == 16


def test_sentences_of_a_page():
    page = "<nav><p>Start</p></nav><h1>Notice</h1><p>One. Two!</p><p>We keep: these:</p><ul><li>names. dates</li></ul><p>No colon</p><ul><li>item</li></ul><table><tr><td>Lamp</td><td>counts of the hall</td></tr></table>"
    got = [(v, t) for _, v, _, t in annotate.page_sentences(page)]
    assert got == [(0, "Notice"), (0, "One."), (0, "Two!"), (0, "We keep: these:"), (0, "names."), (0, "dates"), (1, "We keep these names."), (1, "dates"), (0, "No colon"), (0, "item"), (0, "counts of the hall")]
    assert annotate.page_sentences(None) == annotate.page_sentences("") == []


def test_companies_are_whole_words(spark):
    one = spark.range(1)
    v = lambda x: one.select(annotate.normalize_entity(F.lit(x), ("meta",)).alias("v")).first()["v"]
    assert v("the Meta group") == "meta" and v("metadata vendor") == "metadata vendor"


def test_graph_findings(spark):
    from tessella.operators import graph

    n = spark.createDataFrame([("g", "we", "ENTITY"), ("g", "x", "DATA"), ("g", "y", "DATA"), ("g", "z", "DATA")], "graph_id string, name string, ntype string")
    e = spark.createDataFrame([("g", "we", "x", "COLLECT"), ("g", "x", "we", "COLLECT"), ("g", "x", "y", "SUBSUME"), ("g", "y", "x", "SUBSUME"), ("g", "y", "z", "SUBSUME"), ("g", "z", "z", "SUBSUME"), ("g", "we", "x", "SUBSUME"), ("g", "we", "q", "COLLECT")], "graph_id string, src string, dst string, etype string")
    got = {(r["src"], r["dst"], r["etype"], r["problem"]) for r in graph.validate(n, e).collect()}
    assert got == {("x", "we", "COLLECT", "not from entity to data"), ("z", "z", "SUBSUME", "loop"), ("we", "x", "SUBSUME", "ends of two types"), ("we", "q", "COLLECT", "unknown end"), ("x", "y", "SUBSUME", "cycle"), ("y", "x", "SUBSUME", "cycle")}


def test_unfinished_iterations_fail(spark):
    import pytest

    from tessella.operators import components, graph, hierarchy

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.closure(chain, max_rounds=2)
    with pytest.raises(RuntimeError):
        components.connected_components(chain, "src", "dst", max_rounds=1, small=0)
    with pytest.raises(RuntimeError):
        hierarchy.expand_hierarchy(spark.createDataFrame([(str(i), [str(i - 1)] if i else []) for i in range(40)], "id string, parents array<string>"), max_rounds=2)


def test_numbering_over_ranges(spark):
    from tessella.operators.scratch import numbered

    rows = [(f"k{i:04}", i % 7) for i in range(500)]
    got = {r["k"]: r["no"] for r in numbered(spark.createDataFrame(rows, "k string, g int").repartition(5), ["g", "k"], "no").collect()}
    assert got == {k: n for n, (g, k) in enumerate(sorted((g, k) for k, g in rows), 1)}


def test_normalisation_and_links(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    assert [v(annotate.normalize_data(F.lit(x))) for x in ("IP addresses", "the information", "precise location", "shoe sizes")] == ["ip address", "unspecified data", "precise geolocation", "shoe size"]
    assert [v(annotate.normalize_entity(F.lit(x), ("google", "google analytics"))) for x in ("our site", "Google Analytics", "other third parties", "ad networks")] == ["we", "google analytics", "unspecified third party", "ad network"]
    ln = spark.createDataFrame([("d", "a", "b", 1), ("d", "b", "c", 2), ("d", "c", "e", 3), ("d", "a", "x", 0), ("d", "p", "q", 1), ("d", "q", "p", 2)], "doc_id string, src string, dst string, ord int")
    got = {r["src"]: r["target"] for r in annotate.follow_links(ln).collect()}
    assert got["a"] == got["b"] == got["c"] == "e" and got["p"] == got["q"] == "p"
    long = spark.createDataFrame([("d", f"n{i:03}", f"n{i + 1:03}", 0) for i in range(300)], "doc_id string, src string, dst string, ord int")
    assert {r["target"] for r in annotate.follow_links(long).collect()} == {"n300"}
    sp = spark.createDataFrame([("d", 0, 0, "DATA", "emails", False), ("d", 1, 0, "DATA", "this data", True), ("d", 2, 0, "ENTITY", "they", True)], "doc_id string, sent_id int, start int, label string, text string, demonstrative boolean")
    assert {r["text"]: r["antecedent"] for r in annotate.antecedents(sp).collect()} == {"emails": None, "this data": "emails", "they": None}


def test_carry(spark):
    rows = [("d", i, q, lead, skip) for i, (q, lead, skip) in enumerate([(0, 0, 0), (1, 1, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 0, 0)])]
    df = spark.createDataFrame(rows, "doc_id string, pos int, q int, lead int, skip int").select("doc_id", "pos", *[(F.col(c) == 1).alias(c) for c in ("q", "lead", "skip")])
    got = {r["pos"]: r["carried"] for r in typology.carried(df, ["doc_id"], "pos", "q", "lead", "skip", 2).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False}


def test_carry_in_order_equals_windows():
    rnd = random.Random(5)
    rows = [(f"d{i}", p, rnd.random() < 0.3, rnd.random() < 0.5, rnd.random() < 0.2) for i in range(40) for p in range(rnd.randrange(1, 30))]
    cols = list(zip(*rows))
    t = pa.table({"doc_id": cols[0], "fp": [[]] * len(rows), "pos": cols[1], "seg": ["s"] * len(rows), "q": cols[2], "lead": cols[3], "skip": cols[4]})
    got = [(r["doc_id"], r["pos"]) for b in typology._carry_on(iter(t.to_batches(max_chunksize=7)), 3) for r in b.to_pylist()]
    want = []
    for i in dict.fromkeys(cols[0]):
        lead = left = 0
        for _, p, q, ends, skip in [r for r in rows if r[0] == i]:
            if not skip and q:
                lead, left = ends, 3
            elif not skip:
                if not (lead and left > 0):
                    left -= 1
                    continue
                left -= 1
            else:
                continue
            want.append((i, p))
    assert got == want


def test_nothing_is_cut_off(spark):
    """Segments, names and rows beyond any round number count, unless a bound is asked for."""
    idle = ["Nothing happens in this room at all."] * 900
    last = "We share your data with vendors such as Hotjar."
    ads = "\n".join(f"firm{i}.example, {i}, DIRECT" for i in range(1500))
    text = "\n".join([*idle, last]) + " privacy policy, cookies, consent, personal data"
    rows = [("far", "privacy_policy", "Privacy", text, [*idle, last], ""), ("reg", "ads_txt", "", ads, [], ads)]
    df = spark.createDataFrame(rows, "doc_id string, role string, title string, text string, segments array<string>, raw string").withColumns({"target_id": F.lit("t"), "target_type": F.lit("website"), "url": F.lit("https://a.example/p")})
    got = {r["doc_id"]: r for r in typology.classify_documents(df, GAZ).collect()}
    assert got["far"]["named_orgs"] == ["hotjar"] and len(got["reg"]["named_orgs"]) == 1500
    brief = {r["doc_id"]: r for r in typology.classify_documents(df, GAZ, limits=typology.BRIEF).collect()}
    assert brief["far"]["named_orgs"] == [] and len(brief["reg"]["named_orgs"]) == 200


def grid(heads, rows):
    return "<table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_tables_decide(spark):
    """Tables of a page: processors, vendors, consent lists, and names in the tables of a policy."""
    from tessella.functions.html import with_tables

    firms = ["Google", "Hotjar", "Stripe", "Twilio", "Criteo"]
    many = [[f, "x"] for f in firms] + [[f"Firm {i}", "x"] for i in range(6)]
    rows = [
        ("sub", "subprocessor_list", "Team", grid(["Sub-processor", "Purpose"], [["Hotjar", "maps"], ["Stripe", "pay"]])), ("two", "help_doc", "Team", grid(["Sub-processor", "Purpose"], [["Hotjar", "maps"]])),
        ("long", "", "Team", grid(["Vendor", "Note"], many)), ("short", "", "Team", grid(["Vendor", "Note"], many[:10])), ("pol", "privacy_policy", "Privacy", grid(["Vendor", "Note"], [["Twilio", "calls"]])),
    ]
    df = spark.createDataFrame(rows, "doc_id string, role string, title string, raw string").withColumns({"target_id": F.lit("t"), "target_type": F.lit("website"), "url": F.lit("https://a.example/p")})
    df = df.withColumn("text", F.when(F.col("doc_id") == "pol", POLICY).otherwise("short")).withColumn("segments", F.array("text"))
    got = {r["doc_id"]: (r["medium"], r["reason"], r["facets"]) for r in typology.classify_documents(with_tables(df, "raw"), GAZ).collect()}
    assert got["sub"] == ("structured", "subprocessor_table", ["structured:named"]) and got["two"][1] == "help_doc"
    assert got["long"][:2] == ("structured", "vendor_table") and got["short"][0] is None  # twelve rows with the headers, and eleven
    assert got["pol"][0] == "prose" and "prose:named" in got["pol"][2]


GAZ = en.Gazetteer((("acme", "company"), ("google", "company"), ("google analytics", "service"), ("hotjar", "service"), ("stripe", "company"), ("twilio", "company"), ("criteo", "company")))
POLICY = "We collect personal information. Your rights matter. We use cookies with your consent. We share data with service providers such as Hotjar. Third parties may collect information about you. " * 6


def test_typology_cascade(spark):
    docs = [
        ("park", "website", "privacy_policy", "", "This domain is for sale", "x", ""), ("ads", "website", "ads_txt", "", "", "t", "a.com, 1, DIRECT\n"), ("appads", "play_store_app", "ads_txt", "", "", "t", "a.com, 1, DIRECT\n"),
        ("list", "website", "vendor_list", "", "List of vendors", "Google Analytics Google Hotjar Stripe Twilio Criteo", ""), ("help", "website", "help_doc", "", "Help", "short", ""), ("tos", "website", "", "", "Terms of Service", POLICY, ""),
        ("prose", "website", "privacy_policy", "https://a.example/privacy", "Privacy Policy", POLICY, ""), ("none", "website", "", "", "Hi", "short", ""), ("play", "play_store_app", "play_data_safety", "", "", "Data safety. This app may share data", ""),
        ("plat", "website", "privacy_policy", "https://policies.google.com/privacy", "Privacy Policy", POLICY, ""), ("null", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(docs, "doc_id string, target_type string, role string, url string, title string, text string, raw string").withColumn("target_id", F.lit("t"))
    df = df.withColumn("segments", F.split(F.coalesce("text", F.lit("")), r"(?<=\.) ")).withColumn("first_party", F.array(F.lit("acmeshop")))
    c = typology.classify_documents(df, GAZ)
    got = {r["doc_id"]: r for r in c.collect()}
    assert {k: v["medium"] for k, v in got.items()} == {
        "park": None, "ads": "machine_readable", "appads": None, "list": "structured", "help": "other_doc", "tos": None, "prose": "prose", "none": None, "play": "structured", "plat": None, "null": None,
    }
    assert got["prose"]["facets"] == ["prose:category", "prose:generic", "prose:named"] and got["prose"]["named_orgs"] == ["hotjar"]
    assert got["play"]["facets"] == ["structured:generic"] and got["ads"]["named_orgs"] == ["a.com"] and got["list"]["facets"] == ["structured:named"]
    assert got["park"]["reason"] == "parked_domain" and got["tos"]["reason"] == "tos_page" and got["plat"]["reason"] == "generic_platform_policy" and got["null"]["reason"] == "unrecognised"
    t = typology.assemble_targets(c).first()
    assert t["classified"] and t["relevant_docs"] == 4
    ver = spark.createDataFrame([("short", 1)], "t string, main_third int").select(F.sha1("t").alias("text_hash"), "main_third")
    assert {r["doc_id"]: r["facets"] for r in typology.classify_documents(df, GAZ, ver).collect()}["none"] == ["prose:generic"]


def test_read_models(spark):
    r = spark.createDataFrame([("t", f"e{i % 11:02}", f"d{i % 9}", "a", False, "third", ["p"], ["policy"]) for i in range(200)], "target_id string, entity string, data_type string, action string, negative boolean, party string, purposes array<string>, sources array<string>")
    m = report.graph_model(r, 8)
    assert {x["entity"] for x in m.collect()} >= {"+3 more"} and {x["data_type"] for x in m.collect()} >= {"+1 more"}
    docs = spark.createDataFrame([("t", "d1", "privacy_policy", "https://a/p", True, "mail Long.Name@a.example or x@b.example", [("m", "mailto:privacy@a.example?subject=x")])], "target_id string, doc_id string, role string, url string, ok boolean, text string, links array<struct<text:string,href:string>>")
    assert report.rights_info(docs).first()["emails"] == ["privacy@a.example", "x@b.example", "long.name@a.example"]
    tg = spark.createDataFrame([("t", ["prose:named"]), ("u", [])], "target_id string, facets array<string>")
    cl = spark.createDataFrame([("t", "d1", "prose"), ("u", "d2", None)], "target_id string, doc_id string, medium string")
    rows = report.analysis_rows(tg, cl, r, report.rights_info(docs))
    assert rows.groupBy("section").count().count() == 5 and rows.where("section = 'relation'").count() == r.count()
    one = spark.createDataFrame([("t", "https://a.example/x", "T", "website"), ("v", None, None, None)], "target_id string, url string, name string, target_type string")
    p = report.analysis_payload("t", one, rows).first()["payload"]
    assert '"prose:named"' in p and '"origin":"https://a.example"' in p and report.analysis_payload("v", one, rows).count() == 1
    assert report.facet_grid(tg).where("present").count() == 1 and report.top_classes(tg).count() == 2
