"""Read models of results: distributions, rights, grids and bounded graphs for display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions import urls
from tessella.operators.typology import typology_class

TOP = 8
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"


def facet_distribution(targets: DataFrame) -> DataFrame:
    """``(kind, value, n)``: media, counted once per facet, and facets over targets, in one pass of grouping sets."""
    x = targets.select("target_id", F.explode("facets").alias("facet")).select(F.split_part("facet", F.lit(":"), F.lit(1)).alias("medium"), "facet")
    g = x.groupingSets([["medium"], ["facet"]], "medium", "facet").agg(F.count("*").alias("n"), F.grouping("medium").alias("by_facet"))
    return g.select(F.when(F.col("by_facet") == 1, "facet").otherwise("medium").alias("kind"), F.coalesce("facet", "medium").alias("value"), "n")


def top_classes(targets: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` most frequent target classes; "(none)" for targets without facets, ties by name."""
    c = F.when(F.size("facets") == 0, "(none)").otherwise(typology_class(F.col("facets")))
    return targets.groupBy(c.alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(k)


def facet_grid(targets: DataFrame) -> DataFrame:
    """``(target_id, medium, specificity, present)``: every cell of the grid for every target."""
    cells = F.array(*[F.struct(F.lit(m).alias("medium"), F.lit(s).alias("specificity")) for m in lx.MEDIA for s in lx.SPECIFICITIES])
    return targets.select("target_id", "facets", F.inline(cells)).select("target_id", "medium", "specificity", F.array_contains("facets", F.concat_ws(":", "medium", "specificity")).alias("present"))


def documents_with_medium(classified: DataFrame) -> DataFrame:
    """Documents that are of any medium."""
    return classified.where("medium IS NOT NULL").select("target_id", "doc_id", "role", "url", "medium", F.array_join("facets", ";").alias("facets"))


def relations_view(relations: DataFrame) -> DataFrame:
    """Per target and third-party entity: relations, sources and how many come from prose; first-party ones are only counted."""
    prose = F.array_contains("sources", "policy")
    first = F.get(F.filter("sources", lambda s: s != "policy"), F.lit(0))
    g = relations.where("party = 'third'").groupBy("target_id", "entity").agg(
        F.count("*").alias("relations"), F.count_if(prose).alias("prose"), F.min(first).alias("primary_source"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("purposes")))).alias("purposes"),
    )
    own = relations.where("party = 'first'").groupBy("target_id").agg(F.count("*").alias("first_party"))
    return g.join(own, "target_id", "left").withColumn("first_party", F.coalesce("first_party", F.lit(0)))


def _top_or_more(df: DataFrame, by: str, col: str, k: int) -> DataFrame:
    """Adds ``col_b``: the value if it is one of the ``k`` most frequent of its target, else "+n more"."""
    c = df.groupBy(by, col).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by).orderBy(F.desc("_c"), col)
    r = c.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    r = r.withColumn(f"{col}_b", F.when(F.col("_r") <= k, F.col(col)).otherwise(F.concat(F.lit("+"), (F.col("_n") - k).cast("string"), F.lit(" more"))))
    return df.join(r.select(by, col, f"{col}_b"), [by, col])


def graph_model(relations: DataFrame, k: int = TOP) -> DataFrame:
    """Distinct edges ``(target_id, data_type, entity, action, negative)`` between the ``k`` most frequent ends of each target; the others fall into one node each."""
    r = relations.select("target_id", "entity", "data_type", "action", "negative")
    b = _top_or_more(_top_or_more(r, "target_id", "entity", k), "target_id", "data_type", k)
    return b.select("target_id", F.col("data_type_b").alias("data_type"), F.col("entity_b").alias("entity"), "action", "negative").distinct()


def rights_info(docs: DataFrame) -> DataFrame:
    """``(target_id, links, emails)``: first good document per rights role, and up to three contact addresses.

    Addresses come from mail links, then from the text; those that begin with
    privacy, dpo and the like come first, then the shorter ones.
    """
    d = docs.where(F.col("ok") & F.col("role").isin(*lx.RIGHTS_ROLES))
    links = d.groupBy("target_id", "role").agg(F.min_by("url", "doc_id").alias("url"))
    links = links.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("role", "url"))).alias("links"))
    mail = F.transform(F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:")), lambda x: F.regexp_replace(x["href"], r"(?i)^mailto:|\?.*$", ""))
    found = F.concat(F.coalesce(mail, F.array().cast("array<string>")), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(EMAIL), F.lit(0)))
    e = d.select("target_id", F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(x)))).alias("e")).where(F.col("e").rlike("^" + EMAIL + "$")).distinct()
    w = Window.partitionBy("target_id").orderBy((~F.col("e").rlike(r"^(?:privacy|dpo|gdpr|data-?protection|ccpa)")).cast("int"), F.length("e"), "e")
    e = e.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "e"))), lambda x: x["e"]).alias("emails"))
    return links.join(e, "target_id", "left").select("target_id", "links", F.coalesce("emails", F.array().cast("array<string>")).alias("emails"))


def analysis_rows(assembled: DataFrame, classified: DataFrame, relations: DataFrame, rights: DataFrame) -> DataFrame:
    """``(target_id, section, key, value)``: everything known of all targets, a row per facet, document, relation, link and address.

    One target may hold a large part of all relations, so nothing is gathered per target.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    row = lambda df, section, key, value: df.select("target_id", F.lit(section).alias("section"), text(key).alias("key"), text(value).alias("value"))
    parts = [
        row(assembled.select("target_id", F.explode("facets").alias("f")), "facet", F.col("f"), F.split_part("f", F.lit(":"), F.lit(1))),
        row(classified, "document", F.col("doc_id"), F.col("medium")),
        row(relations, "relation", F.concat_ws("|", "entity", "data_type", "action", F.col("negative").cast("string")), F.array_join("purposes", ";")),
        row(rights.select("target_id", F.inline("links")), "link", F.col("role"), F.col("url")),
        row(rights.select("target_id", F.posexplode("emails").alias("k", "e")), "address", F.col("e"), F.col("k").cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts)


def analysis_payload(target_id: str, targets: DataFrame, rows: DataFrame) -> DataFrame:
    """``(target_id, payload)`` of one requested target: its ``analysis_rows`` by section as one JSON document."""
    one = rows.where(F.col("target_id") == target_id).groupBy("target_id", "section").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("items"))
    parts = one.groupBy("target_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "items")))).alias("sections"))
    t = targets.where(F.col("target_id") == target_id).dropDuplicates(["target_id"])
    return t.join(parts, "target_id", "left").select(
        "target_id", F.to_json(F.struct("target_id", urls.origin(F.col("url")).alias("origin"), "name", "target_type", "sections")).alias("payload")
    )
