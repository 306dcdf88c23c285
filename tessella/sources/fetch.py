"""Fetching behind a cache: an offline table of responses, as a data source and as joins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Statuses of failures that may pass; they aren't cached.
TRANSIENT = (0, 429, 500, 502, 503, 504)
SCHEMA = "url string, status int, content_type string, text string, error string, final_url string"


def cache_key(url: Column) -> Column:
    """Key of an address in the cache."""
    return F.sha1(url)


def kept_body(content_type: Column, text: Column) -> Column:
    """Body of a response: only of pages, text, JSON and responses without a type."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when((ct == "") | ct.rlike("html|text|json"), text).otherwise("")


def from_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Responses to ``requests(url)`` from ``cache(url, status, ...)``; an address that it lacks has status 0 and an error."""
    c = cache.dropDuplicates(["url"])
    r = requests.select("url").distinct().join(c, "url", "left")
    return r.select(
        "url", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("content_type", F.lit("")).alias("content_type"),
        kept_body(F.col("content_type"), F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("error", F.when(F.col("status").isNull(), "not cached").otherwise("")).alias("error"),
        F.coalesce("final_url", "url").alias("final_url"),
    )


def missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that have to be made: not in the cache, or there with a passing failure."""
    done = cache.where(~F.col("status").isin(*TRANSIENT)).select("url")
    return requests.select("url").distinct().join(done, "url", "left_anti")


class _Part(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_part: int):
        self.path, self.per_part = path, per_part

    def partitions(self) -> list[InputPartition]:
        files = sorted(map(str, Path(self.path).glob("*.json")))
        return [_Part(files[i : i + self.per_part]) for i in range(0, len(files), self.per_part)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for f in partition.files:
            try:
                d = json.loads(Path(f).read_text(encoding="utf-8"))
            except ValueError:
                continue
            yield tuple(d.get(k) for k in ("url", "status", "content_type", "text", "error", "final_url"))


class FetchCacheSource(DataSource):
    """Folder of cached responses, one JSON file each, as a table: ``spark.read.format("fetch_cache").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "fetch_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("filesPerPartition", "500")))
