import json

from pyspark.sql import functions as F

from tessella.operators import typology
from tessella.sources import corpus, fetch
from tessella.streaming import stream


def test_seeds(spark, tmp_path):
    (tmp_path / "b.csv").write_text("type,name,url,app_id,seed_policy_url\nwebsite, Ácme Shop ,https://a.example,,\n#skip,x,,,\n,y,,,\nplay_store_app,,,com.x.y,https://p.example\nwebsite,???,,,\n")
    (tmp_path / "a.csv").write_text("type,name,url,app_id,seed_policy_url\ndata_broker,Big \"Q\" Data,,,\n")
    got = {r["target_id"]: r for r in corpus.load_seeds(spark, str(tmp_path)).collect()}
    assert {"website__cme-shop", "play_store_app__com-x-y"} <= set(got) and len(got) == 4
    assert got["play_store_app__com-x-y"]["name"] is None and got["website__cme-shop"]["name"] == "Ácme Shop"


def test_manifests_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("w__a", "website", "A", "https://a", None, None), ("w__b", "website", "B", None, None, None)], "target_id string, target_type string, name string, url string, app_id string, seed_policy_url string")
    d = spark.createDataFrame([("w__a", "d2", "u2", "x", 200, "text/html", "p", 1.5, ""), ("w__a", "d1", "u1", "privacy_policy", 404, None, "", 1e12, "gone")], "target_id string, doc_id string, url string, role string, http_status int, content_type string, raw_path string, fetched_at double, error string")
    for r in corpus.manifests(t, d).collect():
        (tmp_path / f"{r['target_id']}.json").write_text(json.dumps({"target": r["target"].asDict(), "docs": [x.asDict() for x in r["docs"]]}, indent=1))
    t2, d2 = corpus.read_manifests(spark, str(tmp_path))
    assert sorted(map(str, t2.select(*t.columns).collect())) == sorted(map(str, t.collect())) and sorted(map(str, d2.select(*d.columns).collect())) == sorted(map(str, d.collect()))
    ok = {r["doc_id"]: r["ok"] for r in d.select("doc_id", corpus.is_ok(F.col("http_status"), F.col("raw_path"), F.col("error")).alias("ok")).collect()}
    assert ok == {"d1": False, "d2": True}
    at = {r["doc_id"]: r["t"] for r in d.select("doc_id", corpus.fetched_time(F.col("fetched_at")).cast("string").alias("t")).collect()}
    assert at["d1"] == "2001-09-09 01:46:40" and at["d2"].startswith("1970-01-01 00:00:01.5")
    corpus.write_manifests(t, d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_sheets_and_results(spark, tmp_path):
    s = spark.createDataFrame([("1", "t,\"x\""), ("2", None)], "label_order string, notes string")
    corpus.write_sheet(s, str(tmp_path / "s"))
    assert {(r["label_order"], r["notes"]) for r in corpus.read_sheet(spark, str(tmp_path / "s"), ("label_order", "notes")).collect()} == {("1", "t,\"x\""), ("2", None)}
    c = spark.createDataFrame([("t", "d", "r", "u", "website", "prose", "x", True, ["a", "b"], True, ["o"], [], "company", ["f"], "e")],
                              "target_id string, doc_id string, role string, url string, target_type string, medium string, reason string, relevant boolean, facets array<string>, decisive boolean, named_orgs array<string>, category_terms array<string>, org_typing string, structural_fired array<string>, evidence string")
    corpus.write_results(c, typology.assemble_targets(c), str(tmp_path / "res"))
    assert spark.read.csv(str(tmp_path / "res/documents"), header=True).first()["facets"] == "a;b"
    corpus.save_bodies(c.select("target_id", "doc_id", F.lit("x").alias("raw")), str(tmp_path / "bodies"))
    (tmp_path / "f.html").write_text("<p>ü</p>\n<p>2</p>")
    assert corpus.read_raw(spark, str(tmp_path / "f.html")).first()["raw"].startswith("<p>ü</p>\n")


def test_fetch_cache(spark, tmp_path):
    rows = [("https://a", 200, "text/html", "<p>", "", "https://a/"), ("https://b", 503, "text/html", "", "busy", "https://b"), ("https://c", 200, "image/png", "xx", "", "https://c")]
    for i, r in enumerate(rows):
        (tmp_path / f"{i}.json").write_text(json.dumps(dict(zip(("url", "status", "content_type", "text", "error", "final_url"), r))))
    (tmp_path / "bad.json").write_text("{")
    spark.dataSource.register(fetch.FetchCacheSource)
    cache = spark.read.format("fetch_cache").option("filesPerPartition", "2").load(str(tmp_path))
    assert cache.count() == 3
    req = spark.createDataFrame([(u,) for u in ("https://a", "https://b", "https://c", "https://d", "https://a")], "url string")
    got = {r["url"]: r for r in fetch.from_cache(req, cache).collect()}
    assert got["https://a"]["text"] == "<p>" and got["https://c"]["text"] == "" and got["https://d"]["error"] == "not cached" and len(got) == 4
    assert {r["url"] for r in fetch.missing(req, cache).collect()} == {"https://b", "https://d"}


def test_streams(spark, tmp_path):
    schema = "target_id string, doc_id string, role string, text string, raw string, loaded_at timestamp"
    rows = [("t", "1", "ads_txt", "same", "a.com, 1, DIRECT\n"), ("t", "2", "x", " same ", "y"), ("u", "3", "x", "same", None), ("t", "4", "x", "other", "")]
    spark.createDataFrame(rows, "target_id string, doc_id string, role string, text string, raw string").withColumn("loaded_at", F.timestamp_seconds(F.lit(1.7e9))).write.parquet(str(tmp_path / "in"))
    out: list = []
    s = stream.with_registry_kind(stream.first_deliveries(stream.stream_documents(spark, str(tmp_path / "in"), schema)))
    stream.run_to_end(s.select("doc_id", "target_id", "content_hash", "registry_kind"), lambda b, i: out.extend(b.collect()), str(tmp_path / "cp"))
    assert len({(r["target_id"], r["content_hash"]) for r in out}) == len(out) == 3
    counts: list = []
    stream.run_to_end(stream.windowed_counts(stream.stream_documents(spark, str(tmp_path / "in"), schema)), lambda b, i: counts.extend(b.collect()), str(tmp_path / "cp2"), "update")
    assert sum(r["n"] for r in counts) == 4
