"""Property graphs of disclosures as two tables, closures over them, and graph applications.

``nodes(graph_id, name, ntype, subjects)`` and ``edges(graph_id, src, dst,
etype, action, subject, purposes, text)``; edge types are COLLECT, NOT_COLLECT
and SUBSUME.  Many graphs live in one table, keyed by ``graph_id``.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella import lexicons as lx
from tessella.operators.scratch import materialize, work_partitions

WE, UNSPECIFIED_PARTY, UNSPECIFIED_DATA = "we", "unspecified third party", "unspecified data"
_NONE = "array<string>"
#: Rows that a pass over graphs hands on at once.
FOLDED_ROWS = 10_000
#: Edges up to which every task of a closure holds them all, in memory that is small and known beforehand.
SMALL = 500_000
#: Pairs of terms that are broadcast at most.
FEW_PAIRS = 500_000


def _united(col: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(col), F.array().cast(_NONE))))))


def graph_nodes(mentions: DataFrame) -> DataFrame:
    """Nodes from ``mentions(graph_id, name, ntype, subject, ord)``: names trimmed and in lower case, the first type stays, subjects add up.  Null and empty names are left out."""
    m = mentions.withColumn("name", F.lower(F.trim("name"))).where("name <> ''")
    return m.groupBy("graph_id", "name").agg(F.min_by("ntype", "ord").alias("ntype"), F.array_sort(F.collect_set("subject")).alias("subjects"))


def graph_edges(mentions: DataFrame) -> DataFrame:
    """COLLECT and NOT_COLLECT edges from ``mentions(graph_id, entity, data_type, edge_type, action, subject, purposes, text)``.

    One edge per graph, ends, type, action and subject; purposes and texts add
    up.  Null or empty ends are left out.  Without a column ``text`` edges have none.
    """
    e = mentions.withColumn("src", F.lower(F.trim("entity"))).withColumn("dst", F.lower(F.trim(F.regexp_replace("data_type", r"\s+", " "))))
    return (
        e.where("src <> '' AND dst <> ''").groupBy("graph_id", "src", "dst", F.col("edge_type").alias("etype"), "action", "subject")
        .agg(*[_united(c).alias(c) for c in ("purposes", "text") if c in mentions.columns])
    )


def _folded(rows: DataFrame, fold: Callable[[list[tuple]], Iterable[tuple]], schema: str, together: bool = False) -> DataFrame:
    """``fold`` over the rows of each graph, which has all columns but ``graph_id``; what it gives follows ``graph_id`` in ``schema``.

    Joins by graph and term would shuffle every table once for each term; here
    each row is moved once, and one pass goes through many small graphs.  One
    graph lies in memory at a time; a graph is one document's.  ``together``:
    the rows of a graph are in one partition already.
    """
    of = [c for c in rows.columns if c != "graph_id"]
    fields = StructType.fromDDL(f"graph_id {dict(rows.dtypes)['graph_id']}, {schema}")
    kinds = to_arrow_schema(fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

        graph_id, own = None, []
        for rb in it:
            ids = rb.column("graph_id").to_pylist()
            for g, *row in zip(ids, *(rb.column(c).to_pylist() for c in of)):
                if g != graph_id:
                    out += [(graph_id, *x) for x in fold(own)] if own else []
                    graph_id, own = g, []
                    if len(out) >= FOLDED_ROWS:
                        yield batch()
                own.append(row)
        out += [(graph_id, *x) for x in fold(own)] if own else []
        yield batch()

    rows = rows.where("graph_id IS NOT NULL")
    rows = rows if together else rows.repartition(work_partitions(rows.sparkSession), "graph_id")
    return rows.sortWithinPartitions("graph_id").mapInArrow(run, fields)


_SUB = "graph_id string, src string, dst string"


def acyclic_subsumptions(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """SUBSUME edges ``(graph_id, src, dst, ord)`` accepted in order.

    Loops, repeats, and edges that would close a cycle with those accepted
    before are dropped, as are edges whose ends are unknown or of different
    types if ``nodes`` is given.  The order decides, so each graph is folded
    by one task; a graph is one document's.
    """
    e = edges.select(F.col("graph_id").cast("string").alias("graph_id"), F.lower(F.trim("src")).alias("src"), F.lower(F.trim("dst")).alias("dst"), "ord")
    e = e.where("src <> dst").groupBy("graph_id", "src", "dst").agg(F.min("ord").alias("ord"))
    if nodes is not None:
        n = nodes.select(F.col("graph_id").cast("string").alias("graph_id"), "name", "ntype")
        e = (
            e.join(n.withColumnsRenamed({"name": "src", "ntype": "ts"}), ["graph_id", "src"])
            .join(n.withColumnsRenamed({"name": "dst", "ntype": "td"}), ["graph_id", "dst"]).where("ts = td").select("graph_id", "src", "dst", "ord")
        )

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph_id, below = None, {}

        def reaches(a: str, b: str) -> bool:
            stack, seen = [a], {a}
            while stack:
                x = stack.pop()
                if x == b:
                    return True
                for y in below.get(x, ()):
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            return False

        for rb in it:
            keep = []
            for g, src, dst in zip(*(rb.column(c).to_pylist() for c in ("graph_id", "src", "dst"))):
                if g != graph_id:
                    graph_id, below = g, {}
                ok = not reaches(dst, src)
                keep.append(ok)
                if ok:
                    below.setdefault(src, set()).add(dst)
            yield rb.select(["graph_id", "src", "dst"]).filter(pa.array(keep, pa.bool_()))

    # the rows of a graph lie together and in order, so one pass folds many small graphs without a call for each
    n = work_partitions(edges.sparkSession)
    return e.repartition(n, "graph_id").sortWithinPartitions("graph_id", "ord", "src", "dst").select("graph_id", "src", "dst").mapInArrow(fold, _SUB)


def _closure_by_source(base: DataFrame) -> DataFrame:
    """Closure of a small table ``(ancestor, descendant)``: each task gets all edges and walks down from its share of the ancestors."""
    n = work_partitions(base.sparkSession)

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, below = set(), defaultdict(set)
        for rb in it:
            shares.update(rb.column("share").to_pylist())
            for a, d in zip(rb.column("ancestor").to_pylist(), rb.column("descendant").to_pylist()):
                below[a].add(d)
        up, down = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(up, pa.string()), pa.array(down, pa.string())], names=["ancestor", "descendant"])

        for a in [a for a in below if zlib.crc32(a.encode()) % n in shares]:
            seen, stack = set(), [a]
            while stack:
                fresh = below.get(stack.pop(), set()) - seen
                seen |= fresh
                stack += fresh
            up += [a] * len(seen)
            down += seen
            if len(up) >= FOLDED_ROWS:
                yield batch()
                up, down = [], []
        if up:
            yield batch()

    copies = base.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, "share")
    return copies.mapInArrow(walk, "ancestor string, descendant string")


def closure(edges: DataFrame, keys: list[str] | None = None, src: str = "src", dst: str = "dst", max_rounds: int = 64, small: int = SMALL) -> DataFrame:
    """Transitive closure ``(keys.., ancestor, descendant)`` without the reflexive pairs, by a frontier of new pairs until there is none.

    Cycles are allowed; a node on one is its own ancestor.  Nulls are left
    out.  A closure that ``max_rounds`` doublings don't complete is an error.
    Up to ``small`` edges without keys are walked by tasks that hold them all, with the same result.
    """
    keys = keys or []
    ends = [*keys, "ancestor", "descendant"]
    base = materialize(edges.select(*keys, F.col(src).alias("ancestor"), F.col(dst).alias("descendant")).where("ancestor IS NOT NULL AND descendant IS NOT NULL").distinct(), "closure", free=True)
    if not keys and dict(base.dtypes)["ancestor"] == "string" and base.count() <= small:
        return materialize(_closure_by_source(base), "closure", free=True)
    done = last = base.withColumn("n", F.lit(1).cast("bigint"))
    # n is the distance; all pairs are extended by those whose distance is the doubled one only, so a pair is made once for each of its middles there, not for each middle on its way
    for k in range(max_rounds):
        head, tail = done.withColumnRenamed("descendant", "mid"), last.select(*keys, F.col("ancestor").alias("mid"), "descendant")
        step = head.join(tail, [*keys, "mid"]).groupBy(*ends).agg((F.min("n") + 2**k).alias("n"))
        fresh = materialize(step.join(done.select(*ends), ends, "left_anti"), "closure", free=True)
        if fresh.isEmpty():
            return done.select(*ends)
        done = done.unionByName(fresh)
        last = fresh.where(F.col("n") == 2 ** (k + 1))
    raise RuntimeError(f"closure isn't complete after {max_rounds} rounds")


def reflexive(closed: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Closure with every ``(keys.., name)`` as its own ancestor and descendant."""
    keys = keys or []
    own = names.select(*keys, F.col("name").alias("ancestor"), F.col("name").alias("descendant"))
    return closed.unionByName(own).distinct()


def within_graphs(terms: DataFrame, up: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """``(graph_id, ancestor, descendant)``: pairs of ``up(ancestor, descendant)`` with the ancestor among ``names`` and the descendant among ``below`` of one row of ``terms(graph_id, names, below)``.

    A broad term lies above most others and in most graphs, so graphs are
    never joined with all that lies below their terms.  Pairs that no graph
    uses go first; few of them are held beside each graph, more are joined from below.
    """
    used = lambda c: terms.select(F.explode(c).alias("name")).distinct()
    pairs = up.select("ancestor", "descendant").join(used("names").withColumnRenamed("name", "ancestor"), "ancestor", "left_semi")
    pairs = materialize(pairs.join(used("below").withColumnRenamed("name", "descendant"), "descendant", "left_semi").distinct(), "pairs")
    low = terms.select("graph_id", "names", F.explode("below").alias("descendant"))
    if pairs.count() <= few:
        above = pairs.groupBy("descendant").agg(F.collect_list("ancestor").alias("above"))
        return low.join(F.broadcast(above), "descendant").select("graph_id", F.explode(F.array_intersect("above", "names")).alias("ancestor"), "descendant")
    at = terms.select("graph_id", F.explode("names").alias("ancestor"))
    return pairs.join(low.drop("names"), "descendant").join(at, ["graph_id", "ancestor"]).select("graph_id", "ancestor", "descendant")


def without_cycles(edges: DataFrame, keys: list[str] | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges without those that lie on a cycle and come last in order of their ends: both ends reach each other and src >= dst."""
    keys = keys or []
    c = closure(edges, keys, src, dst)
    back = c.select(*keys, F.col("descendant").alias(src), F.col("ancestor").alias(dst))
    on = edges.join(back, [*keys, src, dst], "left_semi").where(F.col(src) >= F.col(dst))
    return edges.join(on.select(*keys, src, dst).distinct(), [*keys, src, dst], "left_anti")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, src, dst, etype, problem)`` of every edge that a graph may not have.

    unknown end: no such node; loop: a term that subsumes itself; ends of two
    types: a subsumption between data and entity; not from entity to data: any
    other edge that is; cycle: a subsumption both of whose ends reach each other.
    """
    n = nodes.select("graph_id", "name", "ntype").distinct()
    t = edges.select("graph_id", "src", "dst", "etype").distinct()
    at = t.join(n.withColumnsRenamed({"name": "src", "ntype": "_s"}), ["graph_id", "src"], "left").join(n.withColumnsRenamed({"name": "dst", "ntype": "_d"}), ["graph_id", "dst"], "left")
    sub = F.col("etype") == "SUBSUME"
    problem = (
        F.when(F.col("_s").isNull() | F.col("_d").isNull(), "unknown end")
        .when(sub & (F.col("src") == F.col("dst")), "loop")
        .when(sub & (F.col("_s") != F.col("_d")), "ends of two types")
        .when(~sub & ((F.col("_s") != "ENTITY") | (F.col("_d") != "DATA")), "not from entity to data")
    )
    found = at.select("graph_id", "src", "dst", "etype", problem.alias("problem")).where("problem IS NOT NULL")
    s = t.where(sub & (F.col("src") != F.col("dst")))
    c = closure(s, ["graph_id"])
    back = c.select("graph_id", F.col("descendant").alias("src"), F.col("ancestor").alias("dst"))
    return found.unionByName(s.join(back, ["graph_id", "src", "dst"], "left_semi").select("graph_id", "src", "dst", "etype", F.lit("cycle").alias("problem")))


def _row(df: DataFrame, kind: str, a: str | Column, b: str | Column, p: str | None = None) -> DataFrame:
    one = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select("graph_id", F.lit(kind).alias("kind"), one(a).alias("a"), one(b).alias("b"), (F.col(p) if p else F.lit(None).cast(_NONE)).alias("p"))


def _said(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows ``(graph_id, kind, a, b, p)`` of COLLECT edges and of the reach between different terms."""
    return _row(edges.where("etype = 'COLLECT'"), "said", "src", "dst", "purposes").unionByName(_row(reach.where("ancestor <> descendant"), "reach", "ancestor", "descendant"))


def _answers(own: list[tuple]) -> dict[tuple, set]:
    """Purposes of every pair (N, D) that the edges of one graph answer, from its rows of ``_said``."""
    above, below, found = defaultdict(set), defaultdict(set), {}
    for kind, a, b, _ in own:
        if kind == "reach":
            above[b].add(a)
            below[a].add(b)
    for kind, a, b, p in own:
        if kind == "said":
            for n in {a, *above.get(a, ())}:
                for d in {b, *below.get(b, ())}:
                    found.setdefault((n, d), set()).update(p or ())
    return found


def _in_order(p: set) -> list:
    return sorted(p, key=lambda x: (x is None, x))


def collects(queries: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows of ``queries(graph_id, entity, data_type)`` with the purposes of the COLLECT edges that answer them.

    An edge (n, d) answers (N, D) if N subsumes n and d subsumes D, both
    reflexively; ``reach(graph_id, ancestor, descendant)`` is that relation,
    with or without the pairs of equal terms.  Unanswered rows are left out.
    """
    rows = _said(edges, reach).unionByName(_row(queries, "asked", "entity", "data_type"))

    def fold(own: list[tuple]) -> Iterator[tuple]:
        asked = {(a, b) for kind, a, b, _ in own if kind == "asked"}
        for (n, d), p in _answers(own).items():
            if (n, d) in asked:
                yield n, d, _in_order(p)

    return _folded(rows, fold, "entity string, data_type string, purposes array<string>")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, json)``: one document per graph, nodes and edges in order, sets sorted."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("name", "ntype", "subjects"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "etype", "action", "subject", "purposes", "text"))).alias("edges"))
    return n.join(e, "graph_id", "full").select("graph_id", F.to_json(F.struct("nodes", "edges")).alias("json"))


GRAPH_JSON = (
    "struct<nodes:array<struct<name:string,ntype:string,subjects:array<string>>>,"
    "edges:array<struct<src:string,dst:string,etype:string,action:string,subject:string,purposes:array<string>,text:array<string>>>>"
)


def graphs_from_json(df: DataFrame, col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Inverse of ``graph_json``: nodes and edges."""
    d = df.select("graph_id", F.from_json(col, GRAPH_JSON).alias("g"))
    return d.select("graph_id", F.inline("g.nodes")), d.select("graph_id", F.inline("g.edges"))


# -- ontologies -------------------------------------------------------------


def ontology_edges(concepts: DataFrame) -> DataFrame:
    """``(hypernym, hyponym)`` by label from ``concepts(id, label, parents)``; parents that no row has are left out."""
    label = concepts.where("id IS NOT NULL").groupBy("id").agg(F.min(F.coalesce("label", "id")).alias("label"))
    e = concepts.select(F.col("id"), F.explode("parents").alias("pid")).distinct()
    return (
        e.join(label.withColumnRenamed("label", "hyponym"), "id")
        .join(label.select(F.col("id").alias("pid"), F.col("label").alias("hypernym")), "pid")
        .select("hypernym", "hyponym").distinct()
    )


def roots_and_leaves(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, is_root, is_leaf)`` of every concept."""
    up = edges.select(F.col("hyponym").alias("name"), F.lit(True).alias("_h")).distinct()
    down = edges.select(F.col("hypernym").alias("name"), F.lit(True).alias("_l")).distinct()
    return names.select("name").distinct().join(up, "name", "left").join(down, "name", "left").select("name", F.col("_h").isNull().alias("is_root"), F.col("_l").isNull().alias("is_leaf"))


def entity_ontology(categories: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(hypernym, hyponym)`` from ``categories(category, members)``; fails if a member isn't in the gazetteer."""
    e = categories.select(F.col("category").alias("hypernym"), F.explode("members").alias("hyponym")).distinct()
    known = gazetteer.select(F.lower("name").alias("_n"), F.lit(True).alias("_k")).distinct()
    ok = e.join(known, F.lower("hyponym") == F.col("_n"), "left")
    return ok.select("hypernym", F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("not in the gazetteer: "), "hyponym"))).otherwise(F.col("hyponym")).alias("hyponym"))


def local_ontology(nodes: DataFrame, edges: DataFrame, ntype: str) -> DataFrame:
    """SUBSUME edges between nodes of one type, per graph."""
    n = nodes.where(F.col("ntype") == ntype).select("graph_id", "name")
    e = edges.where("etype = 'SUBSUME'").select("graph_id", F.col("src").alias("hypernym"), F.col("dst").alias("hyponym"))
    return e.join(n.withColumnRenamed("name", "hypernym"), ["graph_id", "hypernym"], "left_semi").join(n.withColumnRenamed("name", "hyponym"), ["graph_id", "hyponym"], "left_semi")


# -- applications -----------------------------------------------------------


def _opposed(own: list[tuple]) -> Iterator[tuple]:
    """Of the edges ``(etype, action, subject, src, dst, purposes)`` of one graph: action and subject, and ends and purposes of a COLLECT and of a NOT_COLLECT edge, the negative one without purposes or with a common one."""
    pos = defaultdict(list)
    for etype, action, subject, src, dst, p in own:
        if etype == "COLLECT":
            pos[action, subject].append((src, dst, p))
    for etype, action, subject, src, dst, p in own:
        if etype == "NOT_COLLECT" and p is not None:
            for s, d, q in pos.get((action, subject), ()):
                if not p or not {x for x in p if x is not None}.isdisjoint(q or ()):
                    yield action, subject, s, d, q, src, dst, p


_PAIR = ["action", "subject", "entity_pos", "data_pos", "entity_neg", "data_neg"]


def opposed(edges: DataFrame) -> DataFrame:
    """``(graph_id, action, subject, entity_pos, data_pos, entity_neg, data_neg)``: pairs of edges that contradict each other if their entities and their data types meet.  The edges of a graph are in one partition."""
    rows = edges.where("etype IN ('COLLECT', 'NOT_COLLECT') AND action IS NOT NULL AND subject IS NOT NULL").select("graph_id", "etype", "action", "subject", "src", "dst", "purposes")
    fold = lambda own: ((*x[:4], *x[5:7]) for x in _opposed(own))
    return _folded(rows, fold, ", ".join(f"{c} string" for c in _PAIR), together=True)


def contradictions_without_reach(pairs: DataFrame, terms: DataFrame, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``pairs`` of ``opposed``, those that are contradictions, and the ``graph_id`` of graphs that can't be told without their reach; none of their pairs are among the first.

    Terms subsume those below them by ``up(ancestor, descendant)``, which has
    the terms ``terms(name)``; the unspecified third party subsumes all
    entities but the first.  What two data types of a graph have in common
    there they have in common by ``up``, and entities that ``up`` doesn't have
    meet only themselves and the unspecified third party.  So the reach counts
    only where ``up`` has the entities, or where data has that party's name.
    """
    special = lambda c: F.col(c) == UNSPECIFIED_PARTY
    met = (F.col("entity_pos") == F.col("entity_neg")) | (special("entity_pos") & (F.col("entity_neg") != WE)) | (special("entity_neg") & (F.col("entity_pos") != WE))
    pairs = materialize(pairs.withColumn("met", met), "opposed", free=True)
    known = terms.select("name").unionByName(terms.sparkSession.createDataFrame([(UNSPECIFIED_PARTY,)], "name string")).distinct()
    asked = pairs.where("NOT met").select("graph_id", "entity_pos", "entity_neg")
    for c in ("entity_pos", "entity_neg"):
        asked = asked.join(known.withColumnRenamed("name", c), c, "left_semi")
    named = pairs.where("met AND data_pos <> data_neg").where(special("data_pos") | special("data_neg"))
    odd = materialize(asked.select("graph_id").unionByName(named.select("graph_id")).distinct(), "odd", free=True)
    pairs = pairs.where("met").select("graph_id", *_PAIR)
    if not odd.isEmpty():
        pairs = materialize(pairs.join(odd, "graph_id", "left_anti"), "plain", free=True)
    rest = pairs.where("data_pos <> data_neg")
    same = _meeting(rest.select(F.col("data_pos").alias("x"), F.col("data_neg").alias("y")).distinct(), up).withColumnsRenamed({"x": "data_pos", "y": "data_neg"})
    return pairs.where("data_pos = data_neg").unionByName(rest.join(same, ["data_pos", "data_neg"], "left_semi").select(*pairs.columns)), odd


def contradictions(edges: DataFrame, reach: DataFrame, global_reach: DataFrame | None = None) -> DataFrame:
    """Pairs of a COLLECT and a NOT_COLLECT edge of one graph that can't both hold.

    Same action and subject; entities equal or with a common descendant; data
    types the same, locally or in ``global_reach(ancestor, descendant)``; the
    negative edge without purposes or with a common one.  A term is its own
    descendant, whether or not the relations hold that pair.
    """
    none = F.lit(None).cast(_NONE)
    cols = ["graph_id", "etype", "action", "subject", "src", "dst", "purposes"]
    rows = edges.where("etype IN ('COLLECT', 'NOT_COLLECT') AND action IS NOT NULL AND subject IS NOT NULL").select(*cols).unionByName(
        reach.where("ancestor <> descendant").select("graph_id", F.lit("reach").alias("etype"), F.lit("").alias("action"), F.lit("").alias("subject"), F.col("ancestor").alias("src"), F.col("descendant").alias("dst"), none.alias("purposes"))
    )

    def fold(own: list[tuple]) -> Iterator[tuple]:
        below = defaultdict(set)
        for etype, _, _, src, dst, _ in own:
            if etype == "reach":
                below[src].add(dst)

        def meet(a: str, b: str) -> bool:
            return a == b or b in below.get(a, ()) or a in below.get(b, ()) or not below.get(a, set()).isdisjoint(below.get(b, ()))

        for x in _opposed(own):
            if meet(x[2], x[5]):
                yield *x, meet(x[3], x[6])

    found = _folded(rows, fold, "action string, subject string, entity_pos string, data_pos string, purposes_pos array<string>, entity_neg string, data_neg string, purposes_neg array<string>, local boolean")
    if global_reach is None:
        return found.where("local").drop("local")
    found = materialize(found, "pairs")
    x, y = F.col("data_pos").alias("x"), F.col("data_neg").alias("y")
    same = _meeting(found.where("NOT local").select(x, y).distinct(), global_reach).withColumnsRenamed({"x": "data_pos", "y": "data_neg"})
    return found.where("local").unionByName(found.where("NOT local").join(same, ["data_pos", "data_neg"], "left_semi")).drop("local")


def _meeting(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows of ``pairs(x, y)``, two different terms each, of which one lies below the other or another term lies below both by ``reach(ancestor, descendant)``."""
    pairs = materialize(pairs, "asked", free=True)
    of = pairs.select(F.explode(F.array("x", "y")).alias("ancestor")).distinct()
    r = materialize(reach.where("ancestor <> descendant").select("ancestor", "descendant").join(of, "ancestor", "left_semi"), "strict", free=True)
    down = pairs.join(r.select(F.col("ancestor").alias("x"), F.col("descendant").alias("y")), ["x", "y"], "left_semi")
    up = pairs.join(r.select(F.col("ancestor").alias("y"), F.col("descendant").alias("x")), ["y", "x"], "left_semi").select("x", "y")
    near = materialize(down.unionByName(up).distinct(), "near", free=True)
    # of the others, the term with less below it is followed down, never the broad one
    size = r.groupBy("ancestor").agg(F.count("*").alias("n"))
    rest = pairs.join(near, ["x", "y"], "left_anti").join(size.select(F.col("ancestor").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("ancestor").alias("y"), F.col("n").alias("ny")), "y")
    rest = rest.select("x", "y", F.expr("IF(nx <= ny, x, y)").alias("few"), F.expr("IF(nx <= ny, y, x)").alias("many"))
    both = rest.join(r.withColumnRenamed("ancestor", "few"), "few").join(r.withColumnRenamed("ancestor", "many"), ["many", "descendant"], "left_semi")
    return near.unionByName(materialize(both.select("x", "y").distinct(), "both", free=True))


def classify_flows(flows: DataFrame, nodes: DataFrame, edges: DataFrame, reach: DataFrame, data_up: DataFrame, entity_up: DataFrame | None = None) -> DataFrame:
    """Verdict on each observed ``flows(graph_id, entity, data_type)``: clear, vague or inconsistent, with purposes.

    Clear: the graph has both terms and says so.  Vague: it says so of
    broader terms, by ``data_up`` and ``entity_up(ancestor, descendant)``; of
    several, the least pair counts.  Else inconsistent.
    """
    f = flows.select("graph_id", F.lower(F.trim("entity")).alias("entity"), F.lower(F.trim("data_type")).alias("data_type")).distinct()
    # a broader term that the graph doesn't have answers nothing
    has = edges.where("etype = 'COLLECT'").select("graph_id", F.array("src", "dst").alias("n")).unionByName(reach.where("ancestor <> descendant").select("graph_id", F.array("ancestor", "descendant").alias("n")))
    has = has.groupBy("graph_id").agg(F.array_distinct(F.flatten(F.collect_set("n"))).alias("names"))
    terms = materialize(has.join(f.groupBy("graph_id").agg(F.collect_set("data_type").alias("below"), F.collect_set("entity").alias("entities")), "graph_id"), "terms")
    rows = _said(edges, reach).unionByName(_row(f, "flow", "entity", "data_type"))
    rows = rows.unionByName(_row(nodes.groupBy("graph_id").agg(F.collect_set("name").alias("n")), "nodes", F.lit(""), F.lit(""), "n"))
    rows = rows.unionByName(_row(within_graphs(terms, data_up), "data", "descendant", "ancestor"))
    if entity_up is not None:
        rows = rows.unionByName(_row(within_graphs(terms.select("graph_id", "names", F.col("entities").alias("below")), entity_up), "entity", "descendant", "ancestor"))

    def fold(own: list[tuple]) -> Iterator[tuple]:
        said, known = _answers(own), set()
        wide = {"data": defaultdict(set), "entity": defaultdict(set)}
        for kind, a, b, p in own:
            if kind in wide:
                wide[kind][a].add(b)
            elif kind == "nodes":
                known.update(p)
        for kind, n, d, _ in own:
            if kind == "flow":
                if n in known and d in known and (n, d) in said:
                    yield n, d, "clear", _in_order(said[n, d])
                    continue
                broad = [(y, x) for y in {d, *wide["data"].get(d, ())} for x in {n, *wide["entity"].get(n, ())} if (x, y) != (n, d) and (x, y) in said]
                y, x = min(broad, default=(None, None))
                yield n, d, "vague" if broad else "inconsistent", _in_order(said[x, y]) if broad else []

    out = _folded(rows, fold, "entity string, data_type string, disclosure string, purposes array<string>")
    out = out.unionByName(f.where("graph_id IS NULL").withColumns({"disclosure": F.lit("inconsistent"), "purposes": F.array().cast(_NONE)}))
    return out.select("graph_id", "entity", "data_type", "disclosure", "purposes", (F.col("disclosure") != "inconsistent").alias("consistent"), purpose_class(F.col("purposes")).alias("purpose_class"))


def purpose_class(purposes: Column) -> Column:
    """both, non-core, core or unknown."""
    core = F.arrays_overlap(purposes, F.array(*map(F.lit, lx.CORE_PURPOSES)))
    other = F.arrays_overlap(purposes, F.array(*map(F.lit, lx.NON_CORE_PURPOSES)))
    return F.when(core & other, "both").when(other, "non-core").when(core, "core").otherwise("unknown")


#: Hypernyms that promise not to be personal.
NON_PERSONAL = ("non-personal information", "aggregate / deidentified / pseudonymized information", "aggregated information", "anonymous information")


def check_terms(nodes: DataFrame, reach: DataFrame, ontology: DataFrame, personal: DataFrame, subsumes: DataFrame) -> DataFrame:
    """``(graph_id, misleading, non_standard)`` per graph.

    Misleading: non-personal terms that subsume personal ones, as term and
    example.  Non-standard: terms that subsume others but that the ontology
    ``(name)`` doesn't have.  Unspecified terms don't count.
    """
    special = [UNSPECIFIED_DATA, UNSPECIFIED_PARTY]
    bad = reach.where(F.col("ancestor").isin(*NON_PERSONAL) & (F.col("ancestor") != F.col("descendant")) & ~F.col("descendant").isin(special)).join(personal.select(F.col("name").alias("descendant")).distinct(), "descendant", "left_semi")
    bad = bad.groupBy("graph_id").agg(F.array_sort(F.collect_set(F.concat_ws(" > ", "ancestor", "descendant"))).alias("misleading"))
    odd = subsumes.select("graph_id", F.col("src").alias("name")).distinct().where(~F.col("name").isin(special))
    odd = odd.join(nodes.where("ntype = 'DATA'").select("graph_id", "name"), ["graph_id", "name"], "left_semi").join(ontology.select("name").distinct(), "name", "left_anti")
    odd = odd.groupBy("graph_id").agg(F.array_sort(F.collect_set("name")).alias("non_standard"))
    g = nodes.select("graph_id").distinct().join(bad, "graph_id", "left").join(odd, "graph_id", "left")
    none = F.array().cast(_NONE)
    return g.select("graph_id", F.coalesce("misleading", none).alias("misleading"), F.coalesce("non_standard", none).alias("non_standard"))


def format_contradictions(c: DataFrame) -> DataFrame:
    """``(graph_id, report)``: one line per contradiction."""
    line = F.format_string("%s %s %s <> not %s %s", F.col("entity_pos"), F.col("action"), F.col("data_pos"), F.col("entity_neg"), F.col("data_neg"))
    return c.select("graph_id", line.alias("line")).groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("report"))


def parse_flows(specs: Column) -> Column:
    """``(entity, data_type)`` of an ``ENTITY:DATA`` argument; underscores are blanks."""
    s = F.regexp_replace(specs, "_", " ")
    return F.struct(F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("entity"), F.trim(F.split_part(s, F.lit(":"), F.lit(2))).alias("data_type"))
