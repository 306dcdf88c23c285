"""HTML documents to typed columns.

A parser is one of the few things that built-in expressions can't do; it runs
over Arrow batches, reads only the markup column and returns one struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import join_lead_in, reflowed

BLOCK_SHARE = 0.5

TABLE_TYPE = T.StructType([
    T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("n_rows", T.IntegerType()), T.StructField("n_cols", T.IntegerType()),
    T.StructField("cell_text", T.StringType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
])
LINK_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])
NODE_TYPE = T.StructType([
    T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("boilerplate", T.BooleanType()),
])
DOCUMENT_TYPE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("segments", T.ArrayType(T.StringType())),
    T.StructField("tables", T.ArrayType(TABLE_TYPE)), T.StructField("links", T.ArrayType(LINK_TYPE)), T.StructField("nodes", T.ArrayType(NODE_TYPE)),
])

# Kinds of elements.
_DROPPED = frozenset(("script", "style", "noscript", "template", "svg"))
_FURNITURE = frozenset(("nav", "footer", "aside", "header", "form", "button", "iframe"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul caption".split()
)
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_ENDS = {
    "p": _BLOCKS - {"body", "td", "th", "tr", "li", "dd", "dt"} | {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
}
_WS = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BULLET = re.compile(r"^\s*(?:[-*•▪‣·–]|\d{1,2}[.)])\s+")


def _tidy(s: str) -> str:
    return _WS.sub(" ", s).strip()


class _Reader(HTMLParser):
    """Collects title, links, tables, blocks of text and section nodes in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = ""
        self.links: list[dict] = []
        self.tables: list[dict] = []
        self.lines: list[str] = []
        self.blocks: list[str] = []
        self.nodes: list[dict] = [{"node_id": 0, "parent_id": -1, "type": "ROOT", "text": "", "level": 0, "boilerplate": False}]
        self._open: list[str] = []
        self._text: list[str] = []
        self._anchor: list | None = None
        self._skip = 0
        self._in_title = False
        self._grid: list[dict] = []
        self._heads: list[tuple[int, int]] = []
        self._lists: list[int] = []
        self._last = 0

    # -- text ------------------------------------------------------------
    def _flush(self) -> None:
        t = _tidy("".join(self._text))
        self._text.clear()
        if not t or self._skip:
            return
        self.lines.append(t)
        tag = next((x for x in reversed(self._open) if x in _BLOCKS), "body")
        boiler = any(x in _FURNITURE for x in self._open)
        if self._grid:
            return
        if len(t) >= 3:
            self.blocks.append(t)
        if tag in _HEADINGS:
            level = _HEADINGS[tag]
            while self._heads and self._heads[-1][0] >= level:
                self._heads.pop()
            self._last = self._node("HEADING", t, self._heads[-1][1] if self._heads else 0, level, boiler)
            self._heads.append((level, self._last))
            return
        under = self._heads[-1][1] if self._heads else 0
        if tag == "li":
            self._node("LISTITEM", t, self._lists[-1] if self._lists else under, 0, boiler)
        else:
            for s in _SENTENCE.split(t):
                if s.strip():
                    self._last = self._node("TEXT", s.strip(), under, 0, boiler)

    def _node(self, kind: str, text: str, parent: int, level: int, boiler: bool) -> int:
        n = len(self.nodes)
        self.nodes.append({"node_id": n, "parent_id": parent, "type": kind, "text": text, "level": level, "boilerplate": boiler})
        return n

    # -- parser events ---------------------------------------------------
    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title" and not self.title:
            self._in_title = True
            return
        if tag in _DROPPED:
            self._flush()
            self._skip += 1
            return
        if self._skip:
            return
        if tag == "a":
            self._anchor = [dict(attrs).get("href") or "", []]
            return
        if tag == "br":
            self._text.append(" ")
        if tag not in _BLOCKS:
            if tag not in _VOID:
                self._open.append(tag)
            return
        self._flush()
        while self._open and self._open[-1] in _ENDS and tag in _ENDS[self._open[-1]]:
            self._close(self._open.pop())
        if tag == "table":
            self._grid.append({"rows": [], "cells": None})
        elif tag == "tr" and self._grid:
            self._grid[-1]["rows"].append([])
        elif tag in ("td", "th") and self._grid:
            if not self._grid[-1]["rows"]:
                self._grid[-1]["rows"].append([])
            self._grid[-1]["cells"] = []
        elif tag in ("ul", "ol", "dl"):
            self._lists.append(self._last or (self._heads[-1][1] if self._heads else 0))
        if tag not in _VOID:
            self._open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in_title = False
            return
        if tag in _DROPPED:
            self._skip = max(0, self._skip - 1)
            self._text.clear()
            return
        if self._skip:
            return
        if tag == "a":
            if self._anchor:
                if self._anchor[0]:
                    self.links.append({"text": _tidy("".join(self._anchor[1])), "href": self._anchor[0]})
                self._anchor = None
            return
        if tag in _BLOCKS:
            self._flush()
        if tag in self._open:
            while self._open:
                t = self._open.pop()
                self._close(t)
                if t == tag:
                    break

    def _close(self, tag: str) -> None:
        if tag in ("td", "th") and self._grid and self._grid[-1]["cells"] is not None:
            self._grid[-1]["rows"][-1].append(_tidy("".join(self._grid[-1]["cells"])))
            self._grid[-1]["cells"] = None
        elif tag in ("ul", "ol", "dl") and self._lists:
            self._lists.pop()
        elif tag == "table" and self._grid:
            rows = [r for r in self._grid.pop()["rows"] if r]
            if rows:
                cells = [c for r in rows for c in r if c]
                text = " • ".join(cells)
                self.tables.append({
                    "headers": [c.lower() for c in rows[0]], "n_rows": len(rows), "n_cols": max(map(len, rows)), "cell_text": text, "rows": rows[1:],
                })
                if not self._grid:
                    self._node("TABLE", text, self._heads[-1][1] if self._heads else 0, 0, any(x in _FURNITURE for x in self._open))

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
            return
        if self._skip:
            return
        self._text.append(data)
        if self._anchor is not None:
            self._anchor[1].append(data)
        if self._grid and self._grid[-1]["cells"] is not None:
            self._grid[-1]["cells"].append(data)

    def finish(self) -> None:
        self._flush()
        while self._open:
            self._close(self._open.pop())


def read_html(raw: str | None, max_chars: int | None = None) -> dict:
    """Document of one page; empty fields for null or empty markup.  ``max_chars`` cuts the markup; by default all of it is read."""
    r = _Reader()
    if raw:
        r.feed(raw[:max_chars])
        r.close()
        r.finish()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(r.lines))
    blocks = [b for i, b in enumerate(r.blocks) if i == 0 or b != r.blocks[i - 1]]
    if sum(map(len, blocks)) < BLOCK_SHARE * len(text):
        other = reflowed(text)
        blocks = other if len(other) > len(blocks) else blocks
    return {"title": _tidy(r.title), "text": text, "segments": blocks, "tables": r.tables, "links": r.links, "nodes": r.nodes}


def read_plain(text: str | None) -> list[dict]:
    """Section nodes of plain text: bullets are list items, other lines are sentences."""
    nodes = [{"node_id": 0, "parent_id": -1, "type": "ROOT", "text": "", "level": 0, "boilerplate": False}]
    last = 0
    for block in re.split(r"\n\s*\n", text or ""):
        for line in block.split("\n"):
            if not line.strip():
                continue
            if _BULLET.match(line):
                nodes.append({"node_id": len(nodes), "parent_id": last, "type": "LISTITEM", "text": _tidy(_BULLET.sub("", line)), "level": 0, "boilerplate": False})
            else:
                for s in _SENTENCE.split(_tidy(line)):
                    nodes.append({"node_id": len(nodes), "parent_id": 0, "type": "TEXT", "text": s, "level": 0, "boilerplate": False})
                    last = len(nodes) - 1
    return nodes


def parse_documents(df: DataFrame, id_col: str, raw_col: str, keep: tuple[str, ...] = ("title", "text", "segments", "tables", "links", "nodes"), max_chars: int | None = None) -> DataFrame:
    """``(id, doc)`` with the wanted fields of ``DOCUMENT_TYPE`` for every row; null markup gives empty fields.

    ``n_rows`` of a table counts its row of headers too.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw"))
    kind = src.schema["id"].dataType
    doc = T.StructType([f for f in DOCUMENT_TYPE.fields if f.name in keep])
    schema = T.StructType([T.StructField("id", kind), T.StructField("doc", doc)])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            docs = [read_html(r, max_chars) for r in pdf["raw"]]
            yield pd.DataFrame({"id": pdf["id"], "doc": [{k: d[k] for k in keep} for d in docs]})

    return src.mapInPandas(run, schema)


def with_tables(df: DataFrame, raw_col: str) -> DataFrame:
    """``df`` with ``tables``, those of the markup in ``raw_col``; null markup and markup without a table element give none."""

    @F.pandas_udf(T.ArrayType(TABLE_TYPE))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda r: read_html(r)["tables"])

    none = F.array().cast(T.ArrayType(TABLE_TYPE))
    some = F.col(raw_col).rlike("(?i)<table")
    return df.withColumn("tables", F.when(some, run(F.when(some, F.col(raw_col)))).otherwise(none))


def nodes_of_plain(text: Column) -> Column:
    """Column function for ``read_plain``."""

    @F.pandas_udf(T.ArrayType(NODE_TYPE))
    def run(s: pd.Series) -> pd.Series:
        return s.map(read_plain)

    return run(text)


def sentences(nodes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, node_id, variant, text)`` from exploded section nodes.

    Headings and texts stand for themselves; list items also follow their
    parent, and their parent and grandparent; of tables, sentences of cells of
    three words or more.  Furniture is left out.
    """
    n = nodes.select(doc_id, "node_id", "parent_id", "type", "text", "boilerplate")
    up = n.select(doc_id, F.col("node_id").alias("parent_id"), F.col("text").alias("p_text"), F.col("parent_id").alias("g_id"))
    top = n.select(doc_id, F.col("node_id").alias("g_id"), F.col("text").alias("g_text"))
    rows = n.where("NOT boilerplate AND type <> 'ROOT'").join(up, [doc_id, "parent_id"], "left").join(top, [doc_id, "g_id"], "left")
    own = F.struct(F.lit(0).alias("variant"), F.col("text").alias("text"))
    one = join_lead_in(F.col("p_text"), F.col("text"))
    two = join_lead_in(F.col("g_text"), one)
    cells = F.transform(
        F.filter(F.split("text", " • "), lambda c: F.size(F.split(c, r"\s+")) >= 3), lambda c: F.struct(F.lit(0).alias("variant"), c.alias("text"))
    )
    made = (
        F.when(F.col("type") == "LISTITEM", F.array(own, F.struct(F.lit(1).alias("variant"), one.alias("text")), F.struct(F.lit(2).alias("variant"), two.alias("text"))))
        .when(F.col("type") == "TABLE", cells)
        .otherwise(F.array(own))
    )
    return rows.select(doc_id, "node_id", F.explode(made).alias("s")).select(doc_id, "node_id", "s.variant", "s.text").where("text <> ''")


def with_base(html: Column, url: Column) -> Column:
    """Page with a ``<base>`` element after its head, so that its relative links work elsewhere."""
    tag = F.concat(F.lit('<base href="'), F.regexp_replace(url, '"', "%22"), F.lit('">'))
    return F.when(html.rlike("(?i)<head[^>]*>"), F.regexp_replace(html, F.lit(r"(?i)^((?s:.*?)<head[^>]*>)"), F.concat(F.lit("$1"), tag))).otherwise(F.concat(tag, html))

