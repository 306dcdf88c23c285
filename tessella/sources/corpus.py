"""Reading and writing corpora: seed lists, manifests, raw documents, sheets and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.urls import slug

_S = T.StringType()
SEED_SCHEMA = T.StructType([T.StructField(c, _S) for c in ("type", "name", "url", "app_id", "seed_policy_url")])
DOC_TYPE = T.StructType([
    T.StructField("doc_id", _S), T.StructField("url", _S), T.StructField("role", _S), T.StructField("http_status", T.IntegerType()),
    T.StructField("content_type", _S), T.StructField("raw_path", _S), T.StructField("fetched_at", T.DoubleType()), T.StructField("error", _S),
])
TARGET_TYPE = T.StructType([T.StructField(c, _S) for c in ("id", "type", "name", "url", "app_id", "seed_policy_url")])
MANIFEST_SCHEMA = T.StructType([T.StructField("target", TARGET_TYPE), T.StructField("docs", T.ArrayType(DOC_TYPE))])


#: Comma-separated values as other programs write them: quotes doubled, blanks at the ends kept.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def is_ok(http_status: Column, raw_path: Column, error: Column) -> Column:
    """The fetch succeeded: status 200, a stored body and no error; null counts as empty."""
    return (F.coalesce(http_status, F.lit(0)) == 200) & (F.coalesce(raw_path, F.lit("")) != "") & (F.coalesce(error, F.lit("")) == "")


def fetched_time(seconds: Column) -> Column:
    """Time of epoch seconds; values beyond the year 5138 are milliseconds."""
    return F.timestamp_seconds(F.when(seconds >= 1e11, seconds / 1000).otherwise(seconds))


def seed_targets(rows: DataFrame) -> DataFrame:
    """Targets of seed rows ``(type, name, url, app_id, seed_policy_url)``.

    Values are trimmed, empty ones null; rows without a type or with a type
    that begins with ``#`` are left out.  The id is type and slug of the first
    of name, address and app id.
    """
    cols = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in SEED_SCHEMA.fieldNames()]
    t = rows.select(*cols).where("type IS NOT NULL AND NOT startswith(type, '#')")
    return t.select(
        F.concat_ws("__", "type", slug(F.coalesce("name", "url", "app_id", F.lit("")))).alias("target_id"), F.col("type").alias("target_type"), "name", "url", "app_id",
        "seed_policy_url",
    )


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed targets of one CSV file or of all CSV files of a folder."""
    return seed_targets(spark.read.csv(path, schema=SEED_SCHEMA, enforceSchema=False, multiLine=True, **CSV))


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``targets`` and ``docs`` from JSON manifests of one target each."""
    m = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True)
    targets = m.select(F.col("target.id").alias("target_id"), F.col("target.type").alias("target_type"), "target.name", "target.url", "target.app_id", "target.seed_policy_url")
    docs = m.select(F.col("target.id").alias("target_id"), F.inline("docs"))
    return targets, docs


def read_manifest_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``targets`` and ``docs`` of manifests as ``write_manifests`` leaves them, one per line."""
    m = spark.read.schema(MANIFEST_SCHEMA).json(path)
    targets = m.select(F.col("target.id").alias("target_id"), F.col("target.type").alias("target_type"), "target.name", "target.url", "target.app_id", "target.seed_policy_url")
    return targets, m.select(F.col("target.id").alias("target_id"), F.inline("docs"))


def manifests(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per target with its documents in order of id, as written to manifests."""
    d = docs.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in DOC_TYPE.fieldNames()]))).alias("docs"))
    t = targets.select("target_id", F.struct(F.col("target_id").alias("id"), F.col("target_type").alias("type"), "name", "url", "app_id", "seed_policy_url").alias("target"))
    return t.join(d, "target_id", "left").select("target_id", "target", F.coalesce("docs", F.array().cast(T.ArrayType(DOC_TYPE))).alias("docs"))


def write_manifests(targets: DataFrame, docs: DataFrame, path: str) -> None:
    """Sink of ``manifests``: JSON lines, split by target."""
    manifests(targets, docs).select("target", "docs").write.mode("overwrite").json(path)


def list_targets(docs: DataFrame) -> DataFrame:
    """Ids of targets that have a manifest row, in order, without the cache's."""
    return docs.select("target_id").where("target_id <> '_cache'").distinct().orderBy("target_id")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """``(raw_path, raw)`` of stored bodies, one row per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("raw_path"), F.col("value").alias("raw"))


def with_raw(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Documents with their bodies ``(raw_path, raw)``; '' where none is stored."""
    return docs.join(bodies.select("raw_path", "raw"), "raw_path", "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def save_bodies(docs: DataFrame, path: str) -> None:
    """Sink of bodies: Parquet, split by target type of the id so that one target's documents lie together."""
    docs.select("target_id", "doc_id", "raw").write.mode("overwrite").parquet(path)


def read_sheet(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A label sheet: all columns text, with the row's place as ``_row``."""
    schema = T.StructType([T.StructField(c, _S) for c in columns])
    return spark.read.csv(path, schema=schema, enforceSchema=False, multiLine=True, **CSV).withColumn("_row", F.monotonically_increasing_id())


def write_sheet(sheet: DataFrame, path: str) -> None:
    """A label sheet as CSV with a header; readers see the old or the new one."""
    sheet.drop("_row").write.mode("overwrite").csv(path, **CSV)


def write_results(classified: DataFrame, targets: DataFrame, path: str) -> None:
    """documents, targets and summary of a classification as CSV and JSON."""
    join = lambda c: F.array_join(c, ";").alias(c)
    classified.select(
        "target_id", "doc_id", "role", "url", "target_type", "medium", "reason", "relevant", join("facets"), "decisive", join("named_orgs"), join("category_terms"), "org_typing",
        join("structural_fired"), "evidence",
    ).write.mode("overwrite").csv(f"{path}/documents", **CSV)
    targets.select("target_id", "docs", "relevant_docs", "classified", join("facets")).write.mode("overwrite").csv(f"{path}/targets", **CSV)
    targets.agg(F.count("*").alias("targets"), F.count_if("classified").alias("classified"), F.sum("docs").alias("docs")).write.mode("overwrite").json(f"{path}/summary")
