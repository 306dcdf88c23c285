"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014).  Every round is two
aggregations and two joins over the edge table; nothing is gathered on the
driver but a row count and a checksum that decide when to stop.  A table that
is counted to be small is solved by one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scratch import materialize


def _stamp(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"] or 0


#: Edges up to which one task finds all components by union and find, in memory that is small and known beforehand.
SMALL = 200_000


def _by_one_task(edges: DataFrame) -> DataFrame:
    """Components of a small edge table ``(u, v)``, the least node of each as its name."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kind = None
        for b in batches:
            kind = b.schema.field("u").type
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, c = top(u), top(v)
                if a != c:
                    up[max(a, c)] = min(a, c)
        if up:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "component"])

    t = dict(edges.dtypes)["u"]
    return edges.select("u", "v").coalesce(1).mapInArrow(fn, f"node {t}, component {t}")


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100, small: int = SMALL) -> DataFrame:
    """``(node, component)`` for every node that occurs in an edge.

    ``component`` is the least node of the component.  Nulls in either column
    and loops are ignored, repeated and reversed edges count once, an empty
    edge table gives an empty result, and other columns are not read.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    cur = materialize(e, "cc")
    before = _stamp(cur)
    if before[0] <= small:
        return _by_one_task(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u are tied to the least one
        large = (
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u and its neighbours below are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        cur = materialize(small, "cc")
        after = _stamp(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components aren't complete after {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
