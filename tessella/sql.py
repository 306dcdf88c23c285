"""SQL surface: tables of a folder as views, and the scalar operators as functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella import lexicons as lx
from tessella.plans.queries import QUERIES, Tables

TABLES = ("targets", "docs", "parsed_docs", "doc_classification", "collect_edges", "ccpa_data_ontology", "gazetteer", "documents", "eval_items")


def register(spark: SparkSession, folder: str) -> list[str]:
    """Create views: the tables and their cleaned forms.  Returns the names."""
    t = Tables(spark, folder)
    made = []
    for name in TABLES:
        try:
            getattr(t, name).createOrReplaceTempView(name)
            made.append(name)
        except Exception:  # not in this folder
            continue
    for name, df in (("clean_targets", t.clean_targets), ("clean_docs", t.clean_docs), ("classified", t.classified), ("relations", t.relations)):
        df().createOrReplaceTempView(name)
        made.append(name)
    register_functions(spark)
    return made


def register_functions(spark: SparkSession) -> None:
    """SQL functions without Python in them: slug, has_category, has_generic, registry_kind."""
    q = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    f = {
        "slug(s STRING) RETURNS STRING": "coalesce(nullif(substring(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 60), ''), substring(sha1(s), 1, 10))",
        "has_category(s STRING) RETURNS BOOLEAN": f"s RLIKE '{q(lx.CATEGORY)}'",
        "has_generic(s STRING) RETURNS BOOLEAN": f"s RLIKE '{q(lx.GENERIC)}'",
        "registry_kind(s STRING) RETURNS STRING": f"CASE WHEN s RLIKE '{q(lx.SELLERS_JSON)}' THEN 'sellers_json' WHEN s RLIKE '{q(lx.TCF_GVL)}' THEN 'tcf_gvl' WHEN s RLIKE '{q(lx.VENDORS_JSON)}' THEN 'vendors_json' WHEN s RLIKE '{q(lx.ADS_TXT)}' THEN 'ads_txt' ELSE '' END",
    }
    for head, body in f.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def view_of_query(spark: SparkSession, folder: str, query: str, name: str | None = None) -> None:
    """A registered query as a view."""
    QUERIES[query](spark, folder).createOrReplaceTempView(name or query)
