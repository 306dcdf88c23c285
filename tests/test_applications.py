"""Graph applications over a term that lies above most others and stands in every graph, and without the sentences of edges."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import graph as g

GRAPHS = 40


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose edges have no column ``text``; "any" is above "mid", "mid" above all leaves, and "other" above the last one too."""
    d = str(tmp_path_factory.mktemp("tables"))
    onto = [("any", "any", None), ("mid", "mid", ["any"]), ("other", "other", [])] + [(f"l{i}", f"leaf {i}", ["mid", "other"] if i == 59 else ["mid"]) for i in range(60)]
    spark.createDataFrame(onto, "id string, label string, parents array<string>").write.parquet(f"{d}/ccpa_data_ontology.parquet")
    rows = []
    for i in range(GRAPHS):
        rows += [(f"d{i}", "we", "any", "COLLECT", ["services"]), (f"d{i}", "we", f"leaf {i}", "NOT_COLLECT", []), (f"d{i}", "unspecified third party", "Mid", "COLLECT", ["legal"]), (f"d{i}", "acme", "other", "NOT_COLLECT", ["legal"])]
    e = spark.createDataFrame([(n, "t", *x) for n, x in enumerate(rows)], "edge_id long, target_id string, doc_id string, entity string, data_type string, edge_type string, purposes array<string>")
    e.withColumns({"action": F.lit("collect"), "subject": F.lit("general user"), "loaded_at": F.lit(0)}).write.parquet(f"{d}/collect_edges.parquet")
    return d


def run(spark, folder, name):
    return {tuple(r) for r in entry.queries()[name](spark, folder).collect()}


def test_closure_by_source_is_the_closure(spark):
    rnd = random.Random(5)
    e = spark.createDataFrame([(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(40)] + [("x", None), ("y", "y")], "src string, dst string")
    got = sorted(map(tuple, g.closure(e).collect()))
    assert got == sorted(map(tuple, g.closure(e, small=0).collect())) and ("y", "y") in got


def test_terms_of_one_graph_are_joined_either_way(spark):
    up = spark.createDataFrame([("any", f"leaf {i}") for i in range(50)] + [("leaf 1", "leaf 9")], "ancestor string, descendant string")
    t = spark.createDataFrame([(f"g{i}", ["any", f"leaf {i}", "leaf 9"]) for i in range(9)], "graph_id string, names array<string>").withColumn("below", F.col("names"))
    want = {(f"g{i}", "any", x) for i in range(9) for x in (f"leaf {i}", "leaf 9")} | {("g1", "leaf 1", "leaf 9")}
    for few in (0, 1000):
        got = [tuple(r) for r in g.within_graphs(t, up, few).collect()]
        assert set(got) == want and len(got) == len(want)


def test_contradictions_below_a_broad_term(spark, folder):
    own = {(f"d{i}", "collect", "general user", "we", "any", "we", f"leaf {i}") for i in range(GRAPHS)}
    third = {(f"d{i}", "collect", "general user", "unspecified third party", "mid", "acme", "other") for i in range(GRAPHS)}
    assert run(spark, folder, "a1_contradictions") == own | third


def test_what_is_collected_below_a_broad_term(spark, folder):
    assert run(spark, folder, "q6_collects") == {(f"d{i}", *x) for i in range(GRAPHS) for x in [
        ("we", "any", "services"), ("we", f"leaf {i}", "services"), ("unspecified third party", "mid", "legal"), ("unspecified third party", f"leaf {i}", "legal"),
    ]}


def test_flows_below_a_broad_term(spark, folder):
    assert run(spark, folder, "a5_flow_consistency") == {(f"d{i}", *x) for i in range(GRAPHS) for x in [
        ("we", "any", "clear", True, "core", "services"), ("we", f"leaf {i}", "clear", True, "core", "services"),
        ("unspecified third party", "mid", "clear", True, "core", "legal"), ("acme", "other", "inconsistent", False, "unknown", ""),
    ]}


def test_flows_of_broader_entities_and_of_no_graph(spark):
    edges = spark.createDataFrame([("g", "partners", "any", "COLLECT", ["legal"]), ("g", "vendors", "mid", "COLLECT", ["services"])], "graph_id string, src string, dst string, etype string, purposes array<string>")
    nodes = spark.createDataFrame([("g", n) for n in ("partners", "vendors", "any", "mid")], "graph_id string, name string")
    reach = nodes.select("graph_id", F.col("name").alias("ancestor"), F.col("name").alias("descendant"))
    data = spark.createDataFrame([("any", "mid"), ("any", "leaf"), ("mid", "leaf")], "ancestor string, descendant string")
    who = spark.createDataFrame([("partners", "acme"), ("vendors", "acme")], "ancestor string, descendant string")
    flows = spark.createDataFrame([("g", "acme", "leaf"), ("g", "acme", "any"), ("g", None, "any"), (None, "vendors", "mid"), ("g", "vendors", "mid")], "graph_id string, entity string, data_type string")
    got = {(r["graph_id"], r["entity"], r["data_type"]): (r["disclosure"], r["purposes"]) for r in g.classify_flows(flows, nodes, edges, reach, data, who).collect()}
    assert got == {
        ("g", "acme", "leaf"): ("vague", ["legal"]), ("g", "acme", "any"): ("vague", ["legal"]), ("g", None, "any"): ("inconsistent", []),
        (None, "vendors", "mid"): ("inconsistent", []), ("g", "vendors", "mid"): ("clear", ["services"]),
    }


def test_terms_are_checked_without_sentences(spark, folder):
    assert run(spark, folder, "a7_check_terms") == {(f"d{i}", "", "") for i in range(GRAPHS)}


def test_reports_and_relations_below_a_broad_term(spark, folder):
    assert run(spark, folder, "a9_contradiction_report") == {(f"d{i}", f"unspecified third party collect mid <> not acme other\nwe collect any <> not we leaf {i}") for i in range(GRAPHS)}
    assert run(spark, folder, "r10_graph_relations") == {(f"d{i}", *x) for i in range(GRAPHS) for x in [
        ("we", "first", False, "any", "collect", False, "services", ""), ("we", "first", False, f"leaf {i}", "collect", True, "", ""),
        ("unspecified third party", "third", True, "mid", "collect", False, "legal", "acme"), ("acme", "third", False, "other", "collect", True, "legal", ""),
    ]}


def test_closure_of_chains_and_cycles_by_distance(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)]
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r0", "r3"), ("c37", "r2"), ("self", "self")]
    want = {(f"c{i}", f"c{j}") for i in range(38) for j in range(i + 1, 38)} | {(f"r{i}", f"r{j}") for i in range(7) for j in range(7)} | {(f"c{i}", f"r{j}") for i in range(38) for j in range(7)} | {("self", "self")}
    e = spark.createDataFrame(chain + ring, "src string, dst string")
    got = [tuple(r) for r in g.closure(e, small=0).collect()]
    assert set(got) == want and len(got) == len(want)
    keyed = g.closure(e.withColumn("g", F.lit(3)).unionByName(e.limit(5).withColumn("g", F.lit(4))), ["g"])
    assert keyed.where("g = 3").count() == len(want)
    with pytest.raises(RuntimeError):
        g.closure(e, small=0, max_rounds=3)


def _no_reach(*_):
    raise AssertionError("the reach of every graph was made")


def test_contradictions_make_no_reach_of_every_graph(spark, folder, monkeypatch):
    monkeypatch.setattr(g, "within_graphs", _no_reach)
    assert len(run(spark, folder, "a1_contradictions")) == 2 * GRAPHS
    assert len(run(spark, folder, "a9_contradiction_report")) == GRAPHS


def _shuffled(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_what_is_shuffled_for_a_closure_is_deleted_at_once(spark):
    import gc

    gc.collect()
    spark._jvm.System.gc()
    e = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(9)], "src string, dst string")
    before = _shuffled(spark)
    closed = g.closure(e, small=0)
    assert _shuffled(spark) <= before
    assert closed.count() == 45 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_contradictions_where_entities_are_terms_of_the_ontology(spark, tmp_path, monkeypatch):
    """Random graphs whose terms are entities and data types at once, "we" and the unspecified third party among them, against the SQL."""
    import duckdb

    rnd = random.Random(11)
    we, third = "we", g.UNSPECIFIED_PARTY
    terms = [f"t{i}" for i in range(12)]
    onto = [(x, x, sorted(rnd.sample(terms[:i], min(i, rnd.randrange(3))))) for i, x in enumerate(terms)] + [("we", we, ["t3"]), ("t11", "t11", [we]), ("u", third, ["t2"]), ("t10", "t10", ["u"])]
    names = [*terms, we, third, "acme", "other"]
    rows = []
    for i in range(300):
        for _ in range(rnd.randrange(2, 11)):
            # every other graph has entities only that the ontology doesn't have
            who = rnd.choice(names if i % 2 else ["acme", "other", "x", third, "x"])
            rows.append((len(rows), "t", f"d{i}", who, rnd.choice(names if i % 2 else [*terms, "lone"]), rnd.choice(["COLLECT", "NOT_COLLECT"]), rnd.choice([["legal"], [], ["legal", "services"], ["security"]]), rnd.choice(["use", "use", "collect", None]), rnd.choice(["child", "child", "child", None]), 0))
    rows += [(*rows[0][:-1], 1), (len(rows), "t", None, "acme", "t1", "COLLECT", [], "use", "child", 0), (len(rows) + 1, "t", None, "acme", "t1", "NOT_COLLECT", [], "use", "child", 0)]
    d = str(tmp_path)
    spark.createDataFrame(onto, "id string, label string, parents array<string>").coalesce(1).write.parquet(f"{d}/ccpa_data_ontology.parquet")
    e = spark.createDataFrame(rows, "edge_id long, target_id string, doc_id string, entity string, data_type string, edge_type string, purposes array<string>, action string, subject string, loaded_at int")
    e.withColumn("text", F.array(F.lit("s"))).coalesce(1).write.parquet(f"{d}/collect_edges.parquet")
    monkeypatch.setattr(g.closure, "__defaults__", (*g.closure.__defaults__[:-1], 0))
    db = duckdb.connect()
    for t in ("ccpa_data_ontology", "collect_edges"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["a9_contradiction_report"]).fetchall()
    got = [tuple(r) for r in entry.queries()["a9_contradiction_report"](spark, d).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_propagation_sheet_in_slices(spark, monkeypatch):
    from tessella.operators import labels

    r = spark.createDataFrame([(f"t{i % 3}", f"e{i}", "any" if i % 2 else "none", False, i) for i in range(30)], "target_id string, entity string, data_type string, negative boolean, ord int")
    up = spark.createDataFrame([("any", "b"), ("any", "a"), ("any", "any"), ("else", "c")], "ancestor string, descendant string")
    whole = sorted(map(tuple, labels.propagation_sheet(r, up).collect()))
    assert len(whole) == 30 and {(x[4], x[5]) for x in whole} == {("any", "a;b"), ("none", "")}
    monkeypatch.setattr(labels, "SLICE_BYTES", 6)
    assert sorted(map(tuple, labels.propagation_sheet(r, up).collect())) == whole
