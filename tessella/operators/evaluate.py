"""Scores of results against hand labels.

Each report is one aggregation over joins; a report over nothing is one row of
zeros, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions.text import jaccard

# Thresholds of the reports.
GOALS = {
    "relevance_recall": 0.90, "coverage": 0.90, "exact_agreement": 0.85, "latency_s": 1.0, "policy_web": 0.80, "policy_app": 0.70, "list_web": 0.75,
    "list_app": 0.65, "naming_web": 0.50, "naming_app": 0.40, "accommodation": 0.95, "propagation_min": 30,
}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a / b)


def percent(x: Column) -> Column:
    """A share as text."""
    return F.format_string("%.1f%%", x * 100)


def group_of(target_type: Column) -> Column:
    """app or website."""
    return F.when(target_type.isin(*lx.APP_TYPES), "app").otherwise("website")


def relevance(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: counts, recall, precision and share of targets all of whose relevant documents were found.

    ``gold(target_id, doc_id, gold)`` with 0 or 1; a document without a
    prediction counts as not relevant.
    """
    p = predicted.groupBy("target_id", "doc_id").agg(F.bool_or("relevant").alias("p"))
    j = gold.select("target_id", "doc_id", (F.col("gold") == 1).alias("g")).join(p, ["target_id", "doc_id"], "left").withColumn("p", F.coalesce("p", F.lit(False)))
    docs = j.agg(F.count("*").alias("n"), F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"), F.count_if(~F.col("g") & F.col("p")).alias("fp"))
    t = j.where("g").groupBy("target_id").agg(F.bool_and("p").alias("all_found")).agg(F.count("*").alias("targets"), F.count_if("all_found").alias("complete"))
    return docs.crossJoin(F.broadcast(t)).select(
        "n", "tp", "fn", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        "targets", "complete", ratio(F.col("complete"), F.col("targets")).alias("target_recall"),
    )


def coverage(targets: DataFrame) -> DataFrame:
    """One row: targets, classified ones, share."""
    return targets.agg(F.count("*").alias("n"), F.count_if("classified").alias("classified")).select("n", "classified", ratio(F.col("classified"), F.col("n")).alias("coverage"))


def agreement(predicted: DataFrame, gold: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row: targets with gold, share of equal facet sets, mean Jaccard.

    ``predicted(target_id, doc_id, facets)`` per document, restricted to
    ``labelled(target_id, doc_id)`` if given; ``gold(target_id, facets)``.
    """
    p = predicted if labelled is None else predicted.join(labelled.select("target_id", "doc_id").distinct(), ["target_id", "doc_id"], "left_semi")
    p = p.groupBy("target_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("facets", F.array().cast("array<string>")))))).alias("p"))
    j = gold.select("target_id", F.array_sort(F.array_distinct(F.coalesce("facets", F.array().cast("array<string>")))).alias("g")).join(p, "target_id")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("g")).alias("exact"), F.avg(jaccard(F.col("p"), F.col("g"))).alias("j")).select(
        "n", "exact", ratio(F.col("exact"), F.col("n")).alias("exact_share"), F.coalesce("j", F.lit(0.0)).alias("mean_jaccard")
    )


def latency(timings: DataFrame, value: str = "seconds", by: list[str] | None = None) -> DataFrame:
    """Count, greatest, mean, 95th percentile and share below one second, per ``by``.

    The percentile is the value at rank floor(0.95 n), counted from 0, at most
    the last; ranks come from counts per value, so no group is gathered.
    """
    by = by or []
    from pyspark.sql import Window

    c = timings.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = c.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n")))
    out = run.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min(F.when(F.col("upto") > rank, F.col("v"))).alias("p95"), (F.sum(F.when(F.col("v") < GOALS["latency_s"], F.col("c")).otherwise(0)) / F.sum("c")).alias("under"),
    )
    if by:
        return out
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(x, F.lit(d)).alias(x) for x, d in (("max", 0.0), ("mean", 0.0), ("p95", 0.0), ("under", 1.0))])


def naming_rate(classified: DataFrame) -> DataFrame:
    """Per group: documents, those naming somebody, share."""
    g = classified.groupBy(group_of(F.col("target_type")).alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("named_orgs"), F.lit(0)) > 0).alias("naming"))
    return g.select("grp", "n", "naming", ratio(F.col("naming"), F.col("n")).alias("rate"))


def identification(targets: DataFrame, docs: DataFrame, gold: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Per group: targets where the document exists by hand label, those for which one of ``roles`` was fetched well, share.

    ``gold(target_id, present)``; ``docs`` has ``ok``.
    """
    want = targets.select("target_id", group_of(F.col("target_type")).alias("grp")).dropDuplicates(["target_id"]).join(gold.where("present").select("target_id").distinct(), "target_id", "left_semi")
    have = docs.where(F.col("ok") & F.col("role").isin(*roles)).select("target_id").distinct().withColumn("_h", F.lit(True))
    g = want.join(have, "target_id", "left").groupBy("grp").agg(F.count("*").alias("present"), F.count_if(F.coalesce("_h", F.lit(False))).alias("identified"))
    return g.select("grp", "present", "identified", ratio(F.col("identified"), F.col("present")).alias("rate"))


def policy_identification(targets: DataFrame, docs: DataFrame, gold: DataFrame) -> DataFrame:
    """``identification`` of privacy policies."""
    return identification(targets, docs, gold, ("privacy_policy",))


def list_identification(targets: DataFrame, docs: DataFrame, gold: DataFrame) -> DataFrame:
    """``identification`` of structured lists."""
    return identification(targets, docs, gold, lx.LISTED_ROLES)


def _data_types(relations: DataFrame, ontology: DataFrame) -> DataFrame:
    d = relations.select(F.lower(F.trim("data_type")).alias("name")).where("name <> ''").distinct()
    known = ontology.select(F.lower("name").alias("name")).distinct().withColumn("_k", F.lit(True))
    return d.join(known, "name", "left")


def ontology_accommodation(relations: DataFrame, ontology: DataFrame) -> DataFrame:
    """One row: distinct data types, those the ontology ``(name)`` has, share, and how many it lacks."""
    j = _data_types(relations, ontology).agg(F.count("*").alias("n"), F.count("_k").alias("known"))
    return j.select("n", "known", ratio(F.col("known"), F.col("n")).alias("share"), (F.col("n") - F.col("known")).alias("missing"))


def unknown_data_types(relations: DataFrame, ontology: DataFrame) -> DataFrame:
    """``(name)`` of the data types that the ontology lacks, a row each."""
    return _data_types(relations, ontology).where("_k IS NULL").select("name")


def propagation(gold: DataFrame) -> DataFrame:
    """One row: clauses judged, wrong ones, and whether there are enough and none is wrong."""
    g = gold.agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    return g.select("n", "wrong", ((F.col("n") >= GOALS["propagation_min"]) & (F.col("wrong") == 0)).alias("passed"))


def grouped(classified: DataFrame) -> DataFrame:
    """Documents and those with facets by group, by group and type, and in all, in one pass: ``(grp, target_type, docs, with_facets)``; "all" where a level is summed up."""
    x = classified.select(group_of(F.col("target_type")).alias("grp"), "target_type", (F.size("facets") > 0).alias("c"))
    g = x.groupingSets([["grp", "target_type"], ["grp"], []], "grp", "target_type").agg(F.count("*").alias("docs"), F.count_if("c").alias("with_facets"))
    return g.select(F.coalesce("grp", F.lit("all")).alias("grp"), F.coalesce("target_type", F.lit("all")).alias("target_type"), "docs", "with_facets")


def summary(report: DataFrame, share: str, goal: float, title: str) -> DataFrame:
    """``(summary, passed)``: a line of text for one share of a report."""
    ok = F.col(share) >= goal
    return report.select(F.format_string(f"{title}: %.1f%% (goal %.0f%%) %s", F.col(share) * 100, F.lit(goal * 100), F.when(ok, "PASS").otherwise("FAIL")).alias("summary"), ok.alias("passed"))
