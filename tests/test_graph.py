import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as g
from tessella.operators.components import connected_components
from tessella.operators.hierarchy import expand_hierarchy


def brute(rows):
    ids = {i for i, _ in rows if i is not None}
    par = {i: set() for i in ids}
    for i, ps in rows:
        if i is not None:
            par[i] |= {p for p in ps or [] if p in ids}
    kids = {i: sorted(c for c in ids if i in par[c]) for i in ids}
    paths, cyc = set(), set()

    def down(p):
        paths.add(p)
        for c in kids[p[-1]]:
            if c not in p:
                down((*p, c))

    for r in ids:
        if not par[r]:
            down((r,))
    for s in ids:
        seen, stack = set(), list(kids[s])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += kids[x]
        if s in seen:
            cyc.add(s)
    return paths, cyc


def hier(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, parents array<string>").withColumn("path", F.lit("clash")).withColumn("child", F.lit(1))
    h = expand_hierarchy(df, **kw)
    p = [tuple(r["path"]) for r in h.paths.collect()]
    assert len(p) == len(set(p))
    return set(p), {r["id"] for r in h.cyclic.collect()}


def test_hierarchy_cases(spark):
    rows = [("a", None), ("b", ["a", "a", "zz"]), ("c", ["b"]), ("c", ["a", None]), ("d", ["c"]), ("e", ["d", "f"]), ("f", ["e"]), ("g", ["h"]), ("h", ["g"]), ("i", ["h"]), ("j", ["j"]), ("k", ["k", "a"]), (None, ["a"]), ("m", [])]
    rows += [(f"n{i}", [f"n{i - 1}"] if i else ["d"]) for i in range(11)]
    assert hier(spark, rows) == brute(rows)
    assert hier(spark, rows, stride=1) == brute(rows)
    assert hier(spark, []) == (set(), set())


def test_hierarchy_random(spark):
    rnd = random.Random(3)
    for _ in range(2):
        n = 14
        rows = [(f"v{i}", [f"v{rnd.randrange(n)}" for _ in range(rnd.choice([0, 1, 1, 1, 2]))]) for i in range(n)]
        assert hier(spark, rows) == brute(rows)


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("q", "q"), (None, "a"), ("y", "x"), *[("hub", f"s{i:02}") for i in range(40)], ("s39", "b")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "u string, v string"), "u", "v", small=small).collect()}
    assert got["c"] == got["hub"] == got["s00"] == "a" and got["y"] == "x" and "q" not in got
    chain = [(i, i + 1) for i in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b", small=small).collect()}
    assert set(got.values()) == {0} and len(got) == 61
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", small=small).count() == 0


def test_closure_and_cycles(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("h", "c", "d"), ("g", "c", "a"), ("g", None, "x")], "graph_id string, src string, dst string")
    got = {tuple(r) for r in g.closure(e, ["graph_id"]).collect()}
    assert ("g", "a", "a") in got and ("g", "a", "c") in got and ("h", "c", "d") in got and len(got) == 10
    kept = {(r["src"], r["dst"]) for r in g.without_cycles(e.where("src IS NOT NULL"), ["graph_id"]).collect()}
    assert kept == {("a", "b"), ("b", "c"), ("c", "d")}
    ordered = spark.createDataFrame([("g", "a", "b", 1), ("g", "b", "c", 2), ("g", "c", "a", 3), ("g", "a", "a", 4), ("g", "a", "b", 5)], "graph_id string, src string, dst string, ord int")
    assert {(r["src"], r["dst"]) for r in g.acyclic_subsumptions(ordered).collect()} == {("a", "b"), ("b", "c")}


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([
        ("p", "advertiser", "email address", "COLLECT", "collect", "general user", ["advertising"], ["t1"]), ("p", "advertiser", "email address", "COLLECT", "collect", "general user", ["analytics"], ["t2"]),
        ("p", "we", "contact information", "NOT_COLLECT", "collect", "general user", [], ["t3"]), ("p", "we", "email address", "COLLECT", "collect", "general user", ["services"], ["t4"]),
        ("p", "", "x", "COLLECT", "collect", "general user", None, None), ("p", None, "x", "COLLECT", "collect", "general user", None, None),
    ], "graph_id string, entity string, data_type string, edge_type string, action string, subject string, purposes array<string>, text array<string>")
    edges = g.graph_edges(e)
    names = spark.createDataFrame([("p", n) for n in ("advertiser", "we", "email address", "contact information", "third party", "personal information")], "graph_id string, name string")
    sub = spark.createDataFrame([("p", "third party", "advertiser"), ("p", "contact information", "email address")], "graph_id string, src string, dst string")
    return edges, names, g.reflexive(g.closure(sub, ["graph_id"]), names, ["graph_id"])


def test_collects_and_contradictions(spark, small):
    edges, names, reach = small
    assert edges.count() == 3
    q = spark.createDataFrame([("p", "third party", "email address"), ("p", "advertiser", "contact information"), ("p", "we", "email address")], "graph_id string, entity string, data_type string")
    got = {(r["entity"], r["data_type"]): r["purposes"] for r in g.collects(q, edges, reach).collect()}
    assert got == {("third party", "email address"): ["advertising", "analytics"], ("we", "email address"): ["services"]}
    c = g.contradictions(edges, reach).collect()
    assert [(r["entity_pos"], r["data_pos"], r["data_neg"]) for r in c] == [("we", "email address", "contact information")]
    assert "not we contact information" in g.format_contradictions(g.contradictions(edges, reach)).first()["report"]


def test_flows_terms_json(spark, small):
    edges, names, reach = small
    nodes = names.withColumn("ntype", F.lit("DATA")).withColumn("subjects", F.array().cast("array<string>"))
    up = spark.createDataFrame([("contact information", "phone number"), ("email address", "work email")], "ancestor string, descendant string")
    flows = spark.createDataFrame([("p", "Advertiser", "email address"), ("p", "advertiser", "work email"), ("p", "advertiser", "phone number"), ("p", "nobody", "email address")], "graph_id string, entity string, data_type string")
    got = {(r["entity"], r["data_type"]): (r["disclosure"], r["purpose_class"]) for r in g.classify_flows(flows, nodes, edges, reach, up).collect()}
    assert got == {("advertiser", "email address"): ("clear", "non-core"), ("advertiser", "work email"): ("vague", "non-core"), ("advertiser", "phone number"): ("inconsistent", "unknown"), ("nobody", "email address"): ("inconsistent", "unknown")}
    sub = spark.createDataFrame([("p", "contact information", "email address")], "graph_id string, src string, dst string")
    t = g.check_terms(nodes, reach, names.select("name").where("name <> 'contact information'"), names.select("name"), sub).first()
    assert t["non_standard"] == ["contact information"] and t["misleading"] == []
    n2, e2 = g.graphs_from_json(g.graph_json(nodes, edges))
    assert n2.count() == nodes.count() and {tuple(map(str, r)) for r in e2.select("src", "dst", "purposes").collect()} == {tuple(map(str, r)) for r in edges.select("src", "dst", "purposes").collect()}


def test_scratch_is_released(spark, tmp_path):
    import os

    from tessella.operators import scratch

    saved = dict(scratch._ROOTS)
    scratch._ROOTS.clear()
    try:
        assert scratch.materialize(spark.range(5), "x").count() == 5
        root = scratch.scratch_root(spark).removeprefix("file://")
        assert os.listdir(root)
        scratch.release(spark)
        assert not os.path.exists(root)
    finally:
        scratch._ROOTS.clear()
        scratch._ROOTS.update(saved)
