"""Relations in the tables of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions.entities import is_first_party
from tessella.functions.registry import relation
from tessella.functions.text import purposes_of

CELL_CHARS = 60


def header_tokens(headers: Column) -> Column:
    """Distinct lower-case words of a table's headers."""
    return F.array_distinct(F.flatten(F.transform(headers, lambda h: F.regexp_extract_all(h, F.lit(r"[a-z][a-z\-]+"), F.lit(0)))))


def first_match(headers: Column, pattern: str, but: Column | None = None) -> Column:
    """Place of the first header that matches, counted from 0; -1 if none does."""
    flags = F.transform(headers, lambda h, i: h.rlike(pattern) & (F.lit(True) if but is None else i != but))
    return F.array_position(flags, True).cast("int") - 1


def name_column(headers: Column) -> Column:
    """Place of the column of names: a vendor header, else a plain name header unless it is a cookie table; -1 if there is none."""
    strong = first_match(headers, lx.VENDOR_HEADER)
    weak = first_match(headers, lx.NAME_HEADER)
    cookie = F.exists(headers, lambda h: h.rlike(lx.COOKIE_HEADER))
    return F.when(strong >= 0, strong).when(~cookie, weak).otherwise(-1)


def name_cells(table: Column) -> Column:
    """Cells of the column of names that aren't empty or technical identifiers."""
    at = name_column(table["headers"])
    cells = F.transform(table["rows"], lambda r: F.get(r, at))
    return F.when(at < 0, F.array().cast("array<string>")).otherwise(
        F.filter(cells, lambda v: F.coalesce((v != "") & ~v.rlike(r"^[_.\w-]*[_\d][_.\w-]*$"), F.lit(False)))
    )


def clean_cell(v: Column) -> Column:
    """Entity of a cell in lower case; null for empty, long, letterless and own-site cells."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(v)), r"^[\s.,;:•*()\[\]-]+", ""), r"[\s.,;:•*()\[\]-]+$", "")
    return F.when((s == "") | (F.length(s) > CELL_CHARS) | ~s.rlike(r"\p{L}") | s.isin(*lx.OWN_CELLS), None).otherwise(s)


def table_relations(docs: DataFrame, first_party: str | None = None) -> DataFrame:
    """Relations of ``docs(doc_id, role, tables)``: one per document and entity, purposes united, first row's text.

    A cookie table, by role or header, says who collects identifiers; a vendor
    table, by header or role, with whom personal data is shared.  Other tables
    say nothing.  ``first_party`` names a column of first-party words.
    """
    fp = F.col(first_party) if first_party else F.array().cast("array<string>")
    t = docs.select("doc_id", "role", fp.alias("fp"), F.posexplode("tables").alias("t_no", "t"))
    t = t.select("doc_id", "role", "fp", "t_no", F.col("t.headers").alias("h"), F.col("t.rows").alias("rows"))
    vendor = first_match(F.col("h"), lx.VENDOR_HEADER)
    weak = first_match(F.col("h"), lx.NAME_HEADER)
    cookie = (F.col("role") == "cookie_policy") | F.exists("h", lambda x: x.rlike(lx.COOKIE_HEADER))
    cookie = F.coalesce(cookie, F.lit(False))
    listed = F.coalesce(F.col("role").isin(*lx.LIST_ROLES), F.lit(False))
    t = t.withColumn("at", F.when(vendor >= 0, vendor).when(~cookie & listed, weak).otherwise(-1)).withColumn("cookie", cookie)
    t = t.where("at >= 0").withColumn("why", first_match(F.col("h"), lx.PURPOSE_HEADER, F.col("at")))
    r = t.select("doc_id", "role", "fp", "t_no", "cookie", "at", "why", F.posexplode("rows").alias("r_no", "cells"))
    r = r.select(
        "doc_id", "role", "fp", "cookie", F.struct("t_no", "r_no").alias("ord"), clean_cell(F.get("cells", F.col("at"))).alias("entity"),
        purposes_of(F.when(F.col("why") >= 0, F.get("cells", F.col("why")))).alias("purposes"), F.array_join("cells", " • ").alias("line"),
    ).where(F.col("entity").isNotNull() & ~is_first_party(F.col("entity"), F.col("fp")))
    default = F.when(F.col("role").isin("subprocessor_list", "dpa"), F.array(F.lit("services"))).otherwise(F.array().cast("array<string>"))
    r = r.withColumn("purposes", F.when((F.size("purposes") == 0) & ~F.col("cookie"), default).otherwise(F.col("purposes")))
    by = r.groupBy("doc_id", "entity").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("purposes")))).alias("purposes"), F.min_by("line", "ord").alias("line"),
        F.min_by("cookie", "ord").alias("cookie"),
    )
    cookies = by.where("cookie").select(
        *relation(F.col("doc_id"), F.col("entity"), "cookie / device identifiers", "collect", "cookie_table", F.col("purposes"), F.lit(""), F.col("line"))
    )
    vendors = by.where("NOT cookie").select(
        *relation(F.col("doc_id"), F.col("entity"), "personal data", "be_shared", "vendor_table", F.col("purposes"), F.lit(""), F.col("line"))
    )
    return cookies.unionByName(vendors)
