import pytest
from pyspark.sql import functions as F

from tessella.functions import entities as en
from tessella.functions import urls
from tessella.functions.registry import registry_names, registry_relations

GAZ = en.Gazetteer(tuple(sorted({"orvatel": "company", "orvatel metrics": "service", "quibbo": "service", "meta": "company", "branch": "service", "zpw": "service", "lindqua": "company", "apple": "company"}.items())))


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def val(one, c):
    return one.select(c.alias("v")).first()["v"]


def test_gazetteer(one, spark):
    g = lambda s: val(one, en.gazetteer_orgs(F.lit(s), GAZ))
    assert g("Figures of the hall go to Orvatel Metrics, then to Quibbo.") == ["orvatel metrics", "quibbo"]
    assert "meta" not in g("The catalogue holds meta tags and meta data.") and "meta" in g("Pictures of the fair are sent to Meta.")
    assert g("the branch by the river") == [] and g("Branch counts visits.") == ["branch"]
    assert g("") == [] and val(one, en.gazetteer_orgs(F.lit(None).cast("string"), GAZ)) == []
    dim = spark.createDataFrame(GAZ.types, "name string, org_type string")
    docs = spark.createDataFrame([(1, "Sent to Orvatel Metrics, Quibbo."), (2, None), (3, "")], "i int, t string")
    hits = en.gazetteer_hits(docs, "i", "t", dim)
    assert {r["name"] for r in hits.collect()} >= {"orvatel metrics", "quibbo"}
    assert {tuple(r) for r in en.listed_orgs(docs, "i", "t", dim).collect()} == {(1, "orvatel metrics"), (1, "quibbo")}
    big = dim.unionByName(spark.range(en.MAX_PATTERN_NAMES + 1).selectExpr("concat('filler', id) AS name", "'company' AS org_type"))
    assert {r["name"] for r in en.listed_orgs(docs, "i", "t", big).collect()} >= {"orvatel metrics", "quibbo"}


@pytest.mark.parametrize("raw,want", [
    ("- an Orvatel Ltd", "Orvatel Ltd"), ("CCPA", None), ("TLS", None), ("our Website", None), ("These Terms", None), ("lamp seller", None), ("Marketing Partners", None), ("Other Companies", None),
    ("Quibbo", "Quibbo"), ("Brass Lamp Corp.", "Brass Lamp Corp"), ("KLMN", None), ("ZPW", "ZPW"), ("Harbour Lighting Commission", None), ("Lamps Act", None), ("One Two Three Four", None), ("One Two Three Four GmbH", "One Two Three Four GmbH"), (None, None), ("", None),
])
def test_clean_org(one, raw, want):
    assert val(one, en.clean_org(F.lit(raw).cast("string"), GAZ)) == want


def test_classify_and_detect(one):
    assert [val(one, en.classify_org(F.lit(x), GAZ)) for x in ("Orvatel Metrics", "Orvatel", "Brass Lamp Insights", "Brass Lamp")] == ["service", "company", "service", "unknown"]
    d = lambda *a, **k: tuple(val(one, en.detect_orgs(*a, **k)))
    assert d(F.lit("The hall is counted by Orvatel Metrics."), GAZ) == (["orvatel metrics"], "service")
    assert d(F.lit("Orvatel Metrics counts, Orvatel pays."), GAZ)[1] == "mixed"
    assert d(F.lit("Orvatel passes routes to Quibbo."), GAZ, F.array(F.lit("orvatel")))[0] == ["quibbo"]
    found = F.array(*map(F.lit, ["Brass Lamp Corp", "Marketing Partners", "CCPA"]))
    assert d(F.lit("Routes are passed on."), GAZ, None, found) == (["Brass Lamp Corp"], "unknown")
    assert d(F.lit("t"), GAZ, None, F.array(F.lit("Brass Lamp")), precise=True)[0] == []
    assert d(F.lit("t"), GAZ, None, F.array(F.lit("Brass Lamp Inc.")), precise=True)[0] == ["Brass Lamp Inc"]
    assert d(F.lit("The hall is warm."), GAZ) == ([], "")


def test_first_party(one):
    t = val(one, en.first_party_tokens(F.array(F.lit("https://www.lampharbour.com/notice")), F.lit("Lamp Harbour GmbH")))
    assert {"lampharbour", "lamp", "harbour"} <= set(t) and "gmbh" not in t
    fp = F.array(F.lit("lampharbour"), F.lit("harbour"))
    assert val(one, en.is_first_party(F.lit("LampHarbour Shop"), fp)) and not val(one, en.is_first_party(F.lit("Orvatel"), fp))
    assert not val(one, en.is_first_party(F.lit("Orvatel"), F.lit(None).cast("array<string>")))


def test_terms(one):
    none = F.array().cast("array<string>")
    assert val(one, en.category_terms(F.lit("we partner with vendors, not with sponsors"), none)) == ["vendors"]
    assert val(one, en.category_terms(F.lit("calls go to Quibbo vendors and to agents"), F.array(F.lit("quibbo")))) == []
    assert val(one, en.bare_generic(F.lit("routes reach third parties"), none)) is True
    assert val(one, en.bare_generic(F.lit("routes reach third-party service providers"), none)) is False
    assert val(one, en.bare_generic(F.lit("Quibbo is a third-party lamp maker"), F.array(F.lit("quibbo")))) is False
    assert val(one, en.merge_orgs(F.array(F.lit("B"), F.lit("a")), F.array(F.lit("A"), F.lit("c")))) == ["a", "B", "c"]
    many = F.transform(F.sequence(F.lit(1), F.lit(900)), lambda i: F.concat(F.lit("n"), i.cast("string")))
    assert len(val(one, en.merge_orgs(many, none))) == 900 and len(val(one, en.merge_orgs(many, none, 200))) == 200
    assert val(one, en.party_orgs(F.lit("the Apple device id and Orvatel"), F.array(F.lit("apple"), F.lit("orvatel")))) == ["orvatel"]
    assert val(one, en.domain_orgs(F.lit("lists go to brass.example, see rugs.example or https://lamps.example"), none)) == ["brass.example"]


@pytest.mark.parametrize("u,base,want", [
    ("/p", "https://a.example/x/y?q#f", "https://a.example/p"), ("q", "https://a.example/x/y", "https://a.example/x/q"), ("//b.example/z", "https://a.example/", "https://b.example/z"),
    ("http://c.example/", "https://a.example/", "http://c.example/"), ("q", "https://a.example", "https://a.example/q"),
])
def test_absolute(one, u, base, want):
    assert val(one, urls.absolute(F.lit(u), F.lit(base))) == want


def test_urls(one):
    assert val(one, urls.registrable(F.lit("www.shop.co.uk"))) == "shop.co.uk" and val(one, urls.registrable(F.lit("a.b.example"))) == "b.example"
    assert val(one, urls.same_site(F.lit("https://x.b.example/1"), F.lit("https://b.example"))) and val(one, urls.same_site(F.lit("/rel"), F.lit("https://b.example")))
    assert val(one, urls.slug(F.lit("  Ácme & Co!! "))) == "cme-co" and len(val(one, urls.slug(F.lit("???")))) == 10
    assert val(one, urls.origin(F.lit("HTTPS://A.Example/x"))) == "https://a.example" and val(one, urls.origin(F.lit("ftp://a"))) is None
    pdf = lambda ct, u, h: val(one, urls.looks_like_pdf(F.lit(ct).cast("string"), F.lit(u).cast("string"), F.lit(h).cast("binary")))
    assert pdf(None, "https://a/x.PDF?y=1", None) and pdf("application/pdf", "u", None) and pdf("text/html", "u", bytearray(b"%PDF-1.4")) and not pdf("text/html", "https://a/x", None)


ADS = "lampmarket.example, 77, DIRECT, ab\nrugfair.example, 8, RESELLER\nLampMarket.example, 78, RESELLER\n"


def test_registries(spark):
    many = "\n".join(f"d{i}.example, {i}, DIRECT" for i in range(300))
    docs = [
        ("ads", ADS), ("many", many + "\n" + many), ("sell", '{"sellers": [{"seller_id": "1", "name": "Lamp House", "domain": "lamphouse.example"}, {"seller_id": "2", "name": "Veiled", "is_confidential": 1}]}'),
        ("gvl", '{"vendorListVersion": 3, "vendors": {"7": {"name": "Rug Row", "purposes": [1, 2, 8]}}}'), ("arr", '{"vendors": [{"name": "Jar", "purposes": [99]}]}'), ("bad", '{"sellers": [broken'),
        ("prose", "The hall opens at nine."), ("null", None), ("empty", ""),
    ]
    df = spark.createDataFrame(docs, "doc_id string, raw string")
    r = registry_relations(df.withColumn("entity", F.lit("clash"))).collect()
    by = {(x["doc_id"], x["entity"]): x for x in r}
    assert by["ads", "lampmarket.example"]["qualifier"] == "direct" and by["ads", "rugfair.example"]["qualifier"] == "reseller"
    assert by["ads", "lampmarket.example"]["text"].startswith("lampmarket.example, 77") and by["ads", "lampmarket.example"]["action"] == "be_sold"
    assert {k for k in by if k[0] == "sell"} == {("sell", "lamp house")} and by["sell", "lamp house"]["action"] == "be_shared"
    assert by["gvl", "rug row"]["purposes"] == ["advertising", "analytics", "services"] and by["arr", "jar"]["purposes"] == ["other"]
    assert not [k for k in by if k[0] in ("bad", "prose", "null", "empty")]
    kind = F.when(F.col("doc_id").isin("ads", "many"), "ads_txt").when(F.col("doc_id") == "sell", "sellers_json").when(F.col("doc_id").isin("gvl", "arr"), "tcf_gvl").otherwise("")
    n = {x["doc_id"]: x["n"] for x in df.where("raw IS NOT NULL").select("doc_id", registry_names(F.col("raw"), kind).alias("n")).collect()}
    assert n["ads"] == ["lampmarket.example", "rugfair.example"] and len(n["many"]) == 300 and n["gvl"] == ["Rug Row"] and n["arr"] == ["Jar"]
    assert n["sell"] == ["lamphouse.example", "Lamp House", "Veiled"]
    assert len(df.where("doc_id = 'many'").select(registry_names(F.col("raw"), kind, 50).alias("n")).first()["n"]) == 50
