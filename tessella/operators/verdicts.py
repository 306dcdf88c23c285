"""Verdicts of an outside segment classifier: interface, table of verdicts, incremental scoring."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions.text import sha1_of_trimmed

#: Labels of the taxonomy that the classifier scores; the first is the one used here.
THRESHOLD = 0.5


def stub_scorer(texts: list[str]) -> list[float]:
    """Deterministic stand-in: high for texts that name a recipient group, else a hash below the threshold."""
    import re

    hit = re.compile(lx.CATEGORY)
    return [0.9 if hit.search(t or "") else (zlib.crc32((t or "").encode()) % 500) / 1000 for t in texts]


def score_segments(segments: DataFrame, scorer: Callable[[list[str]], list[float]] = stub_scorer, text: str = "text") -> DataFrame:
    """``(text, score, main_third)`` of every distinct non-empty text of ``segments``; the scorer sees whole batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = scorer(pdf["text"].tolist())
            yield pd.DataFrame({"text": pdf["text"], "score": s, "main_third": [int(x > THRESHOLD) for x in s]})

    return segments.select(F.col(text).alias("text")).where("text <> ''").distinct().mapInPandas(run, "text string, score double, main_third int")


def document_verdicts(docs: DataFrame, known: DataFrame | None = None, scorer: Callable[[list[str]], list[float]] = stub_scorer, first: int | None = None) -> DataFrame:
    """``(text_hash, main_third)`` of documents ``(text, segments)`` whose hash isn't in ``known``: any segment, or of the ``first`` ones, is flagged."""
    taken = F.col("segments") if first is None else F.slice("segments", 1, first)
    d = docs.select(sha1_of_trimmed(F.coalesce("text", F.lit(""))).alias("text_hash"), taken.alias("segments")).dropDuplicates(["text_hash"])
    if known is not None:
        d = d.join(known.select("text_hash"), "text_hash", "left_anti")
    s = d.select("text_hash", F.explode("segments").alias("text"))
    return s.join(score_segments(s, scorer), "text").groupBy("text_hash").agg(F.max("main_third").alias("main_third"))
