"""Parent-child rows of unknown depth expanded to full hierarchies (problem 3).

Level-wise frontier joins: level 0 holds the roots, each round joins the
frontier with the ways down of up to ``stride`` levels.  A step that
would repeat an id of its own path closes a cycle: the ids from the repeated
one on are on it.  Nodes that no root reaches are searched from themselves.
Each round is written once, so lineage never grows with depth.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scratch import materialize


@dataclass
class Hierarchy:
    """``nodes(id)``, ``edges(parent, child)``, ``paths(id, path, depth, root)``, ``cyclic(id)``."""

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    cyclic: DataFrame

    def descendants(self) -> DataFrame:
        """Distinct ``(ancestor, descendant)``, reflexive pairs left out, over all paths."""
        a = self.paths.select(F.col("id").alias("descendant"), F.explode("path").alias("ancestor"))
        return a.where("ancestor <> descendant").select("ancestor", "descendant").distinct()

    def summary(self) -> DataFrame:
        """Per node: least and greatest depth, number of paths, roots, number of descendants, cycle flag."""
        p = self.paths.groupBy("id").agg(
            F.min("depth").alias("min_depth"),
            F.max("depth").alias("max_depth"),
            F.count("*").alias("n_paths"),
            F.array_sort(F.collect_set("root")).alias("roots"),
        )
        d = self.descendants().groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_descendants"))
        c = self.cyclic.select("id", F.lit(True).alias("on_cycle"))
        return (
            self.nodes.join(p, "id", "left").join(d, "id", "left").join(c, "id", "left")
            .select(
                "id", "min_depth", "max_depth",
                F.coalesce("n_paths", F.lit(0)).alias("n_paths"),
                "roots",
                F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
                F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
            )
        )


def parent_edges(df: DataFrame, id_col: str = "id", parents_col: str = "parents") -> tuple[DataFrame, DataFrame]:
    """Distinct ids, and distinct ``(parent, child)`` whose parent is an id of the table.

    Parents of all rows of one id are united.  Null ids, null parent lists,
    null elements and parents that no row has are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(parents_col).alias("ps")).where("id IS NOT NULL")
    nodes = rows.select("id").distinct()
    pairs = rows.select(F.col("id").alias("child"), F.explode("ps").alias("parent")).where("parent IS NOT NULL").distinct()
    return nodes, pairs.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("parent", "child")


def _suffixes(edges: DataFrame, stride: int) -> DataFrame:
    """``(id, suffix)``: every way down from ``id`` of 1 to ``stride`` steps.

    No suffix repeats an id or holds the start, but its last id may do so;
    such a suffix has ``loop`` set and isn't extended.
    """
    children = edges.select(F.col("parent").alias("at"), "child")
    cur = materialize(
        edges.select(F.col("parent").alias("id"), F.array("child").alias("suffix"), F.expr("child = parent").alias("loop")), "sfx"
    )
    out = [cur]
    for _ in range(stride - 1):
        cur = materialize(
            cur.where("NOT loop")
            .withColumn("at", F.element_at("suffix", -1))
            .join(children, "at")
            .select(
                "id",
                F.concat("suffix", F.array("child")).alias("suffix"),
                (F.array_contains("suffix", F.col("child")) | F.expr("child = id")).alias("loop"),
            ),
            "sfx",
        )
        out.append(cur)
    return materialize(reduce(DataFrame.unionByName, out), "sfx")


def expand_hierarchy(
    df: DataFrame, id_col: str = "id", parents_col: str = "parents", stride: int = 4, max_rounds: int = 1_000_000
) -> Hierarchy:
    """Expand ``df(id, parents)`` to all simple paths from roots, and find the nodes on cycles.

    A root is a node without parents left.  Nodes reached only through cycles
    have no path.  A node that is its own parent counts as cyclic but keeps
    its paths through other parents.  An empty table gives empty results.
    ``stride`` levels are joined per round, which divides the number of jobs.
    """
    nodes, edges = parent_edges(df, id_col, parents_col)
    nodes, edges = materialize(nodes, "nodes"), materialize(edges, "edges")
    ext = _suffixes(edges, stride)
    frontier = materialize(
        nodes.join(edges.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select("id", F.array("id").alias("path")),
        "level",
    )
    levels, closed = [frontier], []
    for _ in range(max_rounds):
        step = materialize(
            frontier.join(ext, "id")
            .where("NOT arrays_overlap(path, slice(suffix, 1, size(suffix) - 1))")
            .select(
                F.element_at("suffix", -1).alias("id"),
                F.concat("path", "suffix").alias("path"),
                (F.size("suffix") == stride).alias("far"),
                (F.col("loop") | F.expr("array_contains(path, element_at(suffix, -1))")).alias("shut"),
            ),
            "level",
        )
        ring = F.expr("slice(path, array_position(path, element_at(path, -1)), size(path))")
        closed.append(step.where("shut").select(F.explode(ring).alias("id")))
        levels.append(step.where("NOT shut").select("id", "path"))
        frontier = step.where("NOT shut AND far").select("id", "path")
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"paths aren't complete after {max_rounds} rounds")
    paths = reduce(DataFrame.unionByName, levels).select(
        "id", "path", F.size("path").cast("int").alias("depth"), F.element_at("path", 1).alias("root")
    )
    cyclic = reduce(DataFrame.unionByName, closed).unionByName(_unreached_cycles(nodes, edges, paths)).distinct()
    return Hierarchy(nodes, edges, paths, cyclic)


def _unreached_cycles(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes that no root reaches and that are their own ancestors.

    Nodes without unreached children can't be on a cycle and are peeled off
    round by round; from the rest, ``(start, node)`` pairs are followed until
    no new pair appears.
    """
    lost = nodes.join(paths.select("id").distinct(), "id", "left_anti")
    sub = materialize(
        edges.join(lost.select(F.col("id").alias("parent")), "parent", "left_semi").join(
            lost.select(F.col("id").alias("child")), "child", "left_semi"
        ),
        "lost",
    )
    n = sub.count()
    while n:
        kept = materialize(sub.join(sub.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "lost")
        m = kept.count()
        sub = kept
        if m == n:
            break
        n = m
    if not n:
        return sub.select(F.col("child").alias("id")).limit(0)
    reach = sub.select(F.col("parent").alias("start"), F.col("child").alias("at"))
    seen = new = materialize(reach.distinct(), "pairs")
    out = [new.where("start = at").select(F.col("start").alias("id"))]
    while True:
        nxt = new.join(sub.select(F.col("parent").alias("at"), "child"), "at").select("start", F.col("child").alias("at")).distinct()
        new = materialize(nxt.join(seen, ["start", "at"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        out.append(new.where("start = at").select(F.col("start").alias("id")))
        seen = seen.unionByName(new)
    return reduce(DataFrame.unionByName, out)
