"""Names that an outside recogniser finds in texts: interface, and a stand-in without a model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the stand-in takes for a company: capitalised words before a legal form.
COMPANY = r"(?:[A-Z][A-Za-z0-9&-]+ ){1,5}(?:Inc|LLC|Ltd|GmbH|Corp|AG|PLC|Limited)\b"


def by_legal_form(texts: list[str]) -> list[list[str]]:
    """Stand-in for a model: the companies of each text, by their legal form."""
    find = re.compile(COMPANY).findall
    return [find(t) for t in texts]


def recognised_names(df: DataFrame, text: str = "text", recogniser: Callable[[list[str]], list[list[str]]] = by_legal_form) -> DataFrame:
    """``(text, names)`` for every distinct non-empty text: what ``recogniser`` finds in it, sorted and each name once.

    The recogniser gets whole batches, so a model is loaded once per worker and
    sees many texts at a time.  Texts are joined back by the caller, by their
    own value or its hash.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"text": pdf["text"], "names": [sorted(set(n)) for n in recogniser(pdf["text"].tolist())]})

    return df.select(F.col(text).alias("text")).where("text <> ''").distinct().mapInPandas(run, "text string, names array<string>")
