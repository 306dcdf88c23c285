"""Machine-readable registries: names in order, and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions.text import machine_readable_kind

RELATION_COLUMNS = (
    "doc_id", "entity", "party", "unspecified", "data_type", "action", "negative", "purposes", "examples", "qualifier", "sources", "text",
)


def _distinct_in_order(names: Column, cap: int | None) -> Column:
    """First spelling of each name without regard to case, stop words left out; ``cap`` keeps the first ones only."""
    kept = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(*lx.REGISTRY_NOT_NAMES))
    # array_distinct works by hash, so a registry of many thousand rows takes time in proportion
    low = F.array_distinct(F.transform(kept, lambda x: F.lower(x)))
    # only a registry that writes one name in two ways needs the slow way
    plain = F.array_distinct(kept)
    slow = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    names = F.when(F.size(low) == F.size(plain), plain).otherwise(slow)
    return names if cap is None else F.slice(names, 1, cap)


def registry_names(text: Column, kind: Column, cap: int | None = None) -> Column:
    """Names listed in a registry file, in order of first occurrence; all of them unless ``cap`` is given.

    ads.txt: domains of the rows.  sellers.json: domains, then names.  Vendor
    lists: names of the vendors, or any name if the JSON can't be read.
    """
    value = lambda key: F.regexp_extract_all(text, F.lit(rf'(?i)"{key}"\s*:\s*"([^"]+)"'), F.lit(1))
    v = F.try_parse_json(text)
    vendors = F.try_variant_get(v, "$.vendors", "map<string,struct<name:string>>")
    listed = F.try_variant_get(v, "$.vendors", "array<struct<name:string>>")
    by_json = F.coalesce(
        F.transform(F.map_values(vendors), lambda x: x["name"]), F.transform(listed, lambda x: x["name"]), value("name")
    )
    names = (
        F.when(kind == "ads_txt", F.transform(F.regexp_extract_all(text, F.lit(lx.ADS_TXT_ROW), F.lit(1)), lambda d: F.lower(d)))
        .when(kind == "sellers_json", F.concat(F.transform(value("domain"), lambda d: F.lower(d)), value("name")))
        .when(kind.isin("tcf_gvl", "vendors_json"), F.array_compact(by_json))
        .otherwise(F.array().cast("array<string>"))
    )
    return _distinct_in_order(names, cap)


def relation(doc_id: Column, entity: Column, data_type: str, action: str, source: Column | str, purposes: Column, qualifier: Column, text: Column) -> list[Column]:
    """Columns of one relation: entity trimmed and in lower case, text of at most 300 characters."""
    none = F.array().cast("array<string>")
    return [
        doc_id.alias("doc_id"), F.lower(F.trim(entity)).alias("entity"), F.lit("third").alias("party"), F.lit(False).alias("unspecified"),
        F.lit(data_type).alias("data_type"), F.lit(action).alias("action"), F.lit(False).alias("negative"),
        F.array_sort(F.array_distinct(F.coalesce(purposes, none))).alias("purposes"), none.alias("examples"), qualifier.alias("qualifier"),
        F.array(F.lit(source) if isinstance(source, str) else source).alias("sources"), F.substring(text, 1, 300).alias("text"),
    ]


def ads_txt_relations(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """One relation per document and domain; a direct row beats resellers, the text is the first row's."""
    rows = docs.where(F.col(raw).rlike(lx.ADS_TXT)).select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(F.regexp_extract_all(F.col(raw), F.lit(lx.ADS_TXT_ROW.replace("(DIRECT|RESELLER)", "(?:DIRECT|RESELLER)")), F.lit(0))).alias("pos", "line"),
    )
    one = rows.select(
        "doc_id", "pos", F.trim("line").alias("line"),
        F.lower(F.regexp_extract("line", lx.ADS_TXT_ROW, 1)).alias("domain"), F.lower(F.regexp_extract("line", lx.ADS_TXT_ROW, 2)).alias("kind"),
    )
    by = one.groupBy("doc_id", "domain").agg(
        F.when(F.bool_or(F.col("kind") == "direct"), "direct").otherwise("reseller").alias("qualifier"), F.min_by("line", "pos").alias("line")
    )
    return by.select(*relation(F.col("doc_id"), F.col("domain"), "advertising bid data", "be_sold", "ads_txt", F.array(F.lit("advertising")), F.col("qualifier"), F.col("line")))


def sellers_json_relations(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """One relation per seller that isn't confidential and has a name or a domain."""
    schema = "struct<sellers:array<struct<seller_id:string,name:string,domain:string,seller_type:string,is_confidential:int>>>"
    rows = docs.where(F.col(raw).rlike(lx.SELLERS_JSON)).select(F.col(doc_id).alias("doc_id"), F.explode(F.from_json(raw, schema)["sellers"]).alias("s"))
    rows = rows.select("doc_id", "s", F.coalesce(F.nullif(F.trim("s.name"), F.lit("")), F.nullif(F.trim("s.domain"), F.lit(""))).alias("who"))
    return rows.where("coalesce(s.is_confidential, 0) <> 1 AND who IS NOT NULL").select(
        *relation(
            F.col("doc_id"), F.col("who"), "advertising bid data", "be_shared", "sellers_json", F.array(F.lit("advertising")),
            F.lower(F.coalesce("s.seller_type", F.lit(""))), F.concat_ws(" ", "s.name", "s.domain"),
        )
    )


def vendor_list_relations(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """One relation per named vendor, given as an object by number or as an array; purposes by the framework's numbers."""
    v = F.try_parse_json(raw)
    vendor = "struct<name:string,purposes:array<int>>"
    rows = docs.where(~F.col(raw).rlike(lx.SELLERS_JSON) & (F.col(raw).rlike(lx.TCF_GVL) | F.col(raw).rlike(lx.VENDORS_JSON))).select(
        F.col(doc_id).alias("doc_id"),
        F.when(F.col(raw).rlike(lx.TCF_GVL), "tcf_gvl").otherwise("vendors_json").alias("kind"),
        F.explode(
            F.coalesce(F.map_values(F.try_variant_get(v, "$.vendors", f"map<string,{vendor}>")), F.try_variant_get(v, "$.vendors", f"array<{vendor}>"))
        ).alias("x"),
    )
    known = F.create_map(*[F.lit(y) for kv in lx.TCF_PURPOSES.items() for y in kv])
    tags = F.transform(F.coalesce(F.col("x.purposes"), F.array().cast("array<int>")), lambda n: F.coalesce(known[n], F.lit("other")))
    return rows.where("trim(x.name) <> ''").select(
        *relation(F.col("doc_id"), F.col("x.name"), "cookie / device identifiers", "collect", F.col("kind"), tags, F.lit(""), F.col("x.name"))
    )


def registry_relations(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """Relations of all registry files of a table of documents; prose and unreadable files give none."""
    kind = docs.withColumn("_kind", machine_readable_kind(F.col(raw)))
    return (
        ads_txt_relations(kind.where("_kind = 'ads_txt'"), doc_id, raw)
        .unionByName(sellers_json_relations(kind.where("_kind = 'sellers_json'"), doc_id, raw))
        .unionByName(vendor_list_relations(kind.where("_kind IN ('tcf_gvl', 'vendors_json')"), doc_id, raw))
    )
