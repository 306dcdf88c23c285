"""Relations: who receives which data for what, merged over documents and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions.entities import is_first_party
from tessella.functions.registry import registry_relations
from tessella.functions.text import sha1_of_trimmed
from tessella.operators.graph import UNSPECIFIED_PARTY, WE
from tessella.operators.tables import table_relations

EXAMPLES = 5
_NONE = "array<string>"


def not_an_actor(entity: Column) -> Column:
    """The name ends with a word for laws and documents."""
    return F.element_at(F.split(F.lower(F.trim(entity)), r"\s+"), -1).isin(*lx.NOT_ACTORS)


def relations_from_graph(nodes: DataFrame, edges: DataFrame, reach: DataFrame, first_party: DataFrame | None = None) -> DataFrame:
    """One relation per COLLECT or NOT_COLLECT edge, ``graph_id`` being the document.

    The party is first for "we" and the first party's words
    ``(graph_id, tokens)``; third parties get up to five named descendants as
    examples.
    """
    e = edges.where("etype IN ('COLLECT', 'NOT_COLLECT')").where(~not_an_actor(F.col("src")))
    ent = nodes.where("ntype = 'ENTITY'").select("graph_id", F.col("name").alias("descendant"))
    ex = (
        reach.where("ancestor <> descendant").join(ent, ["graph_id", "descendant"], "left_semi")
        .groupBy("graph_id", F.col("ancestor").alias("src")).agg(F.slice(F.array_sort(F.collect_set("descendant")), 1, EXAMPLES).alias("ex"))
    )
    none = F.array().cast(_NONE)
    e = e.join(ex, ["graph_id", "src"], "left")
    e = e.join(first_party.select("graph_id", "tokens"), "graph_id", "left") if first_party is not None else e.withColumn("tokens", none)
    own = (F.col("src") == WE) | is_first_party(F.col("src"), F.coalesce("tokens", none))
    text = F.coalesce(F.get("text", F.lit(0)), F.lit("")) if "text" in edges.columns else F.lit("")
    return e.select(
        F.col("graph_id").cast("string").alias("doc_id"), F.col("src").alias("entity"), F.when(own, "first").otherwise("third").alias("party"),
        (F.col("src") == UNSPECIFIED_PARTY).alias("unspecified"), F.col("dst").alias("data_type"), "action", (F.col("etype") == "NOT_COLLECT").alias("negative"),
        F.coalesce("purposes", none).alias("purposes"), F.when(own, none).otherwise(F.coalesce("ex", none)).alias("examples"), F.lit("").alias("qualifier"),
        F.array(F.lit("policy")).alias("sources"), F.substring(text, 1, 300).alias("text"),
    )


def merge_relations(relations: DataFrame, by: list[str] | None = None, order: str = "ord") -> DataFrame:
    """Relations united per ``by`` (such as the target), entity, data type, action and negation.

    Purposes, sources and documents are united, examples united and cut to
    five; "direct" wins as qualifier, else the first non-empty one; the text
    is the first non-empty one; party and unspecified come from the first row
    by ``order``.  All of it is one aggregation with map-side combining but
    for the lists.
    """
    keys = [*(by or []), "entity", "data_type", "action", "negative"]
    o = F.col(order)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast(_NONE))))))
    return relations.groupBy(*keys).agg(
        F.min_by("party", o).alias("party"), F.min_by("unspecified", o).alias("unspecified"), flat("purposes").alias("purposes"),
        F.slice(flat("examples"), 1, EXAMPLES).alias("examples"),
        F.coalesce(
            F.when(F.bool_or(F.col("qualifier") == "direct"), "direct"), F.min_by("qualifier", F.when(F.col("qualifier") != "", o)), F.lit("")
        ).alias("qualifier"),
        flat("sources").alias("sources"), F.coalesce(F.min_by("text", F.when(F.col("text") != "", o)), F.lit("")).alias("text"),
        F.array_sort(F.collect_set("doc_id")).alias("doc_ids"),
    )


def sorted_relations(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """In the order of reports: third parties first, affirmed first, then by name."""
    return merged.orderBy(*(by or []), F.col("party") != "third", "negative", "entity", "data_type")


def structured_relations(docs: DataFrame, first_party: str | None = None) -> DataFrame:
    """Relations of the registry files and of the tables of documents ``(doc_id, role, raw, tables)``."""
    reg = registry_relations(docs.where(F.col("role").isin(*lx.REGISTRY_ROLES)))
    if first_party:
        reg = reg.join(docs.select("doc_id", F.col(first_party).alias("_fp")).dropDuplicates(["doc_id"]), "doc_id").where(~is_first_party(F.col("entity"), F.coalesce("_fp", F.array().cast(_NONE)))).drop("_fp")
    tab = table_relations(docs.where(F.col("role").isin(*lx.TABLE_ROLES)), first_party)
    return reg.unionByName(tab)


def target_relations(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations merged per target of their documents ``(target_id, doc_id)``; targets without any are left out."""
    of = docs.select("target_id", "doc_id").distinct()
    return merge_relations(relations.join(of, "doc_id").withColumn("ord", F.struct("doc_id", "text")), ["target_id"])


def changed_documents(docs: DataFrame, cache: DataFrame, raw: str = "raw") -> DataFrame:
    """Documents of narrative roles whose content isn't in ``cache(doc_id, content_hash)`` yet."""
    d = docs.where(F.col("role").isin(*lx.GRAPH_ROLES)).withColumn("content_hash", sha1_of_trimmed(F.coalesce(F.col(raw), F.lit(""))))
    return d.join(cache.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
