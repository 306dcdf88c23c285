"""Shared helpers of the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one group that a pair join hands to one task on its smaller side.
GROUP_BLOCK = 1024
#: Tables up to this many rows of a few bytes each may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 50_000


def digest(b: bytes) -> bytes:
    """128 bits that stand for ``b``; two different texts of a corpus don't share them in practice."""
    return hashlib.blake2b(b, digest_size=16).digest()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond them."""
    return df.limit(rows + 1).count() <= rows


def work_partitions(df: DataFrame) -> int:
    """Partitions for stages whose work isn't in proportion to their bytes: enough for every core, at least the shuffle's."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if a count shows that it is small; otherwise the join shuffles it."""
    return F.broadcast(df) if small_enough(df, rows) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles it, whatever size the planner expects.

    The planner's guess comes from compressed files and doesn't count what
    ``explode`` adds, so a side of many times the threshold would be gathered on the driver.
    """
    return df.hint("merge")


def group_pairs(df: DataFrame, key: str, order: str, carry: list[str], block: int = GROUP_BLOCK) -> DataFrame:
    """Pairs of rows with equal ``key`` and ``left.order < right.order``.

    Columns are ``key`` and those of ``carry`` with suffixes ``_a`` and
    ``_b``.  A group of n rows is cut into n / ``block`` slices: each left row
    lies in one of them and right rows are copied to all, so that no task
    gets more than ``block`` left rows of one key, however large the group.
    Null keys never pair.
    """
    rows = df.where(F.col(key).isNotNull())
    size = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.expr(f"cast(ceil(_n / {block}) as int)").alias("_k"))
    rows = rows.join(size, key)
    left = rows.select(key, F.expr(f"cast(pmod(xxhash64(`{order}`), _k) as int)").alias("_s"), *[F.col(c).alias(f"{c}_a") for c in carry])
    right = rows.select(key, F.explode(F.expr("sequence(0, _k - 1)")).alias("_s"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return left.join(right, [key, "_s"]).where(F.col(f"{order}_a") < F.col(f"{order}_b")).drop("_s")


def sliced_join(left: DataFrame, right: DataFrame, key: str, order: str, block: int = GROUP_BLOCK) -> DataFrame:
    """Inner join on ``key`` in which a key of n rows on the right is cut into n / ``block`` slices.

    Rows of the right side lie in one slice each, by the hash of ``order``, and
    rows of the left side are copied to all slices of their key, so no task
    gets more than ``block`` right rows of one key.  Null keys never join.
    """
    hot = right.groupBy(key).agg(F.count("*").alias("_n")).where(f"_n > {block}").select(key, F.expr(f"cast(ceil(_n / {block}) as int)").alias("_k"))
    if small_enough(hot, 0):
        return left.join(right, key)
    hot = maybe_broadcast(hot)
    a = left.join(hot, key, "left").withColumn("_s", F.explode(F.expr("sequence(0, coalesce(_k, 1) - 1)"))).drop("_k")
    b = right.join(hot, key, "left").withColumn("_s", F.expr(f"cast(pmod(xxhash64(`{order}`), coalesce(_k, 1)) as int)")).drop("_k")
    return a.join(b, [key, "_s"]).drop("_s")
