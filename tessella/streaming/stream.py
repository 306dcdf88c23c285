"""The same operators over streams: an extension, not a feature to match.

Classification of a document depends on that document only, so it runs
unchanged on a stream; deduplication and rollups carry state bounded by a
watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import machine_readable_kind, sha1_of_trimmed


def stream_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents from a growing folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def first_deliveries(docs: DataFrame, event_time: str = "loaded_at", text: str = "text", late: str = "90 days") -> DataFrame:
    """Documents whose content hash wasn't seen for the target within the watermark."""
    d = docs.withColumn("content_hash", sha1_of_trimmed(F.coalesce(F.col(text), F.lit(""))))
    return d.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["target_id", "content_hash"])


def with_registry_kind(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Stateless step: kind of registry of every document."""
    return docs.withColumn("registry_kind", machine_readable_kind(F.coalesce(F.col(raw), F.lit(""))))


def windowed_counts(docs: DataFrame, event_time: str = "loaded_at", window: str = "1 day", late: str = "90 days") -> DataFrame:
    """Deliveries per window and role."""
    return docs.withWatermark(event_time, late).groupBy(F.window(event_time, window).alias("w"), "role").agg(F.count("*").alias("n"))


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; ``sink(batch, id)`` must be idempotent per id."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
