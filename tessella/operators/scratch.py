"""Lineage cuts: intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is
unset and the session runs on one machine a local folder is made.  Tables are
Parquet, so a cut costs little disk, survives lost executors and is read back
with column pruning.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def _delete(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone already
        pass


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        _ROOTS[app] = f"{base.rstrip('/')}/tessella-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, _ROOTS[app])
    return _ROOTS[app]


#: Setting by which Spark deletes the shuffle files of a job when it ends, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "t", free: bool = False) -> DataFrame:
    """Write ``df`` once and return a reader of the written table.  ``free``: what was shuffled for it is deleted at once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if free:
        before = spark.conf.get(_FREE, "false")
        spark.conf.set(_FREE, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            spark.conf.set(_FREE, before)
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_partitions(spark: SparkSession) -> int:
    """Partitions of shuffles before stages whose work is far more than their bytes: the session's, but two per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a partition per core if its scan has fewer, for stages whose work is far more than their bytes.

    Only inputs of a few files are moved by this; larger ones keep the splits
    of their scan and no shuffle is added.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row from 1 in the order of ``order``, which must tell rows apart.

    Rows are split by ranges, numbered within their range and moved by the
    number of rows in the ranges before; no task gets more than a range.
    """
    split = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    size = split.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per range
    before = size.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return split.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must have been written before.

    Without a call they go when the application ends.
    """
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        _delete(spark, root)
