"""Label sheets: made from results, read back as gold, completed and reported on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.scratch import materialize, numbered, work_partitions

SEED = 1234
EVIDENCE = 200
#: Bytes of repeated lists that one slice of a data type's clauses takes at most in the propagation sheet, if no list is longer.
SLICE_BYTES = 256_000_000
# Columns of the sheets, all text.
RELEVANCE = ("label_order", "target_id", "target_type", "doc_id", "role", "url", "predicted_medium", "predicted_relevant", "predicted_evidence", "gold_relevant", "notes")
TYPOLOGY = ("label_order", "target_id", "target_type", "doc_id", "role", "url", "predicted_medium", "predicted_doc_facets", "predicted_target_class", "gold_facets", "notes")
PROPAGATION = ("label_order", "clause_id", "target_id", "entity", "data_type", "predicted_propagated", "gold_correct", "notes")
PRESENCE = ("label_order", "target_id", "target_type", "url", "gold_pp_present", "gold_list_present", "gold_pp_doc_ids", "gold_list_doc_ids", "notes")
LABEL_GOALS = {"relevance": 100, "pp_presence": 100, "list_presence": 100, "typology": 50, "propagation": 30}


def filled(c: Column) -> Column:
    """The cell isn't blank."""
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def uniform(key: Column, seed: int = SEED) -> Column:
    """Number in [0, 1) that depends on key and seed only."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), key)), 1, 12), 16, 10).cast("double") / float(1 << 48)



def shuffled_targets(targets: DataFrame, prior: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """``(target_id, label_order)`` from 1: a seeded order, or the prior order with fresh targets at seeded places between.

    ``prior(target_id, label_order)``; the order of the known stays as it is.
    """
    t = targets.select("target_id").where("target_id IS NOT NULL").distinct()
    if prior is None:
        place = t.select("target_id", uniform(F.col("target_id"), seed).alias("place"))
    else:
        old = prior.groupBy("target_id").agg(F.min(F.col("label_order").try_cast("int")).alias("o"))
        known = materialize(numbered(t.join(old, "target_id"), ["o", "target_id"], "r"), "known")
        n = known.agg(F.count("*").alias("n"))
        place = known.select("target_id", F.col("r").cast("double").alias("place")).unionByName(
            t.join(old, "target_id", "left_anti").crossJoin(F.broadcast(n)).select("target_id", (uniform(F.col("target_id"), seed) * (F.col("n") + 1)).alias("place"))
        )
    return numbered(place, ["place", "target_id"], "label_order").select("target_id", "label_order")


def prior_gold(sheet: DataFrame, field: str, order: str = "label_order") -> tuple[DataFrame, DataFrame]:
    """First order per target, and last filled ``field`` and notes per target and document, by the sheet's row order ``_row``."""
    rows = sheet if "_row" in sheet.columns else sheet.withColumn("_row", F.monotonically_increasing_id())
    first = rows.groupBy("target_id").agg(F.min_by(order, "_row").alias("label_order"))
    last = rows.groupBy("target_id", "doc_id").agg(F.max_by(field, F.when(filled(F.col(field)), F.col("_row"))).alias(field), F.max_by("notes", F.when(filled(F.col("notes")), F.col("_row"))).alias("notes"))
    return first, last


def _sheet(docs: DataFrame, order: DataFrame, gold: DataFrame | None, field: str, extra: dict[str, Column], columns: tuple[str, ...]) -> DataFrame:
    d = docs.join(order, "target_id")
    d = d.join(gold, ["target_id", "doc_id"], "left") if gold is not None else d.withColumn(field, F.lit("")).withColumn("notes", F.lit(""))
    for k, c in extra.items():
        d = d.withColumn(k, c)
    return d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def relevance_sheet(classified: DataFrame, prior: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Rows of the relevance sheet; gold of a prior sheet is kept."""
    first, last = prior_gold(prior, "gold_relevant") if prior is not None else (None, None)
    extra = {
        "predicted_medium": F.col("medium"), "predicted_relevant": F.col("relevant").cast("int"), "predicted_evidence": F.substring(F.coalesce("evidence", F.lit("")), 1, EVIDENCE),
    }
    return _sheet(classified, shuffled_targets(classified, first, seed), last, "gold_relevant", extra, RELEVANCE)


def typology_sheet(classified: DataFrame, targets: DataFrame, prior: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Rows of the typology sheet with the facets of documents and of their target."""
    first, last = prior_gold(prior, "gold_facets") if prior is not None else (None, None)
    d = classified.join(targets.select("target_id", F.array_join("facets", ";").alias("_class")), "target_id", "left")
    extra = {"predicted_medium": F.col("medium"), "predicted_doc_facets": F.array_join("facets", ";"), "predicted_target_class": F.col("_class")}
    return _sheet(d, shuffled_targets(classified, first, seed), last, "gold_facets", extra, TYPOLOGY)


def data_type_clauses(relations: DataFrame, order: str = "ord") -> DataFrame:
    """First affirmed relation with a data type of each target and entity."""
    r = relations.where(~F.col("negative") & (F.trim("data_type") != ""))
    return r.groupBy("target_id", "entity").agg(F.min_by("data_type", order).alias("data_type"))


def propagation_sheet(relations: DataFrame, reach: DataFrame, prior: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Rows of the propagation sheet: for each clause the terms that its data type subsumes."""
    c = data_type_clauses(relations).withColumn("clause_id", F.concat_ws("::", "target_id", "entity", "data_type"))
    c = c.join(shuffled_targets(c, None, seed), "target_id")
    if prior is not None:
        rows = prior if "_row" in prior.columns else prior.withColumn("_row", F.monotonically_increasing_id())
        old = rows.groupBy("clause_id").agg(F.max_by("gold_correct", F.when(filled(F.col("gold_correct")), F.col("_row"))).alias("gold_correct"), F.max_by("notes", "_row").alias("notes"))
        c = c.join(old, "clause_id", "left")
    else:
        c = c.withColumn("gold_correct", F.lit("")).withColumn("notes", F.lit(""))
    # long lists come last and pass straight into the result: no shuffle or sort holds a copy for each clause
    c = materialize(c, "clauses")
    down = reach.where("ancestor <> descendant").join(c.select(F.col("data_type").alias("ancestor")).distinct(), "ancestor", "left_semi").groupBy(F.col("ancestor").alias("data_type"))
    down = materialize(down.agg(F.array_join(F.array_sort(F.collect_set("descendant")), ";").alias("predicted_propagated")), "below")
    # a data type whose clauses take up much room is cut into slices, each with a copy of the list
    room = c.groupBy("data_type").agg(F.count("*").alias("_n")).join(down.select("data_type", F.octet_length("predicted_propagated").alias("_l")), "data_type")
    slices = room.select("data_type", F.expr(f"cast(ceil(_n * _l / {SLICE_BYTES}) as int)").alias("_k")).where("_k > 1")
    slices = F.broadcast(slices)  # few: each stands for a slice of room at least
    c = c.join(slices, "data_type", "left").withColumn("_s", F.expr("cast(pmod(xxhash64(clause_id), coalesce(_k, 1)) as int)")).drop("_k")
    down = down.join(slices, "data_type", "left").withColumn("_s", F.explode(F.expr("sequence(0, coalesce(_k, 1) - 1)"))).drop("_k")
    # hashed, not sorted: clauses with long lists stay spread among the others, so no page of the result is made of them alone
    n = work_partitions(relations.sparkSession)
    c = c.repartition(n, "data_type", "_s").join(down.repartition(n, "data_type", "_s").hint("shuffle_hash"), ["data_type", "_s"], "left")
    return c.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in PROPAGATION])


def relevance_gold(sheet: DataFrame) -> DataFrame:
    """``(target_id, doc_id, gold)`` of the rows marked 0 or 1."""
    return sheet.where(F.trim("gold_relevant").isin("0", "1")).select("target_id", "doc_id", F.trim("gold_relevant").cast("int").alias("gold"))


def typology_gold(sheet: DataFrame) -> DataFrame:
    """``(target_id, facets)`` of the targets touched: codes united; "none" touches without a code, blank doesn't touch."""
    t = sheet.where(filled(F.col("gold_facets"))).select("target_id", F.explode(F.split("gold_facets", ";")).alias("f")).withColumn("f", F.trim("f"))
    return t.groupBy("target_id").agg(F.array_sort(F.collect_set(F.when((F.col("f") != "") & (F.lower("f") != "none"), F.col("f")))).alias("facets"))


def typology_gold_docs(sheet: DataFrame) -> DataFrame:
    """``(target_id, doc_ids)`` of the documents touched."""
    return sheet.where(filled(F.col("gold_facets"))).groupBy("target_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def _truth(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes")


def presence_gold(sheet: DataFrame, column: str) -> DataFrame:
    """``(target_id, present)`` of the filled rows, the last one of each target."""
    rows = sheet if "_row" in sheet.columns else sheet.withColumn("_row", F.monotonically_increasing_id())
    return rows.where(filled(F.col(column))).groupBy("target_id").agg(F.max_by(_truth(F.col(column)), "_row").alias("present"))


def propagation_gold(sheet: DataFrame) -> DataFrame:
    """``(clause_id, correct)`` of the filled rows, the last one of each clause."""
    rows = sheet if "_row" in sheet.columns else sheet.withColumn("_row", F.monotonically_increasing_id())
    return rows.where(filled(F.col("gold_correct"))).groupBy("clause_id").agg(F.max_by(_truth(F.col("gold_correct")), "_row").alias("correct"))


def ensure_presence_rows(presence: DataFrame, relevance_: DataFrame) -> DataFrame:
    """Presence sheet with a row for every target of the relevance sheet, in its order."""
    t = relevance_.groupBy("target_id").agg(F.min(F.col("label_order").try_cast("int")).alias("o"), F.min("target_type").alias("target_type"), F.min("url").alias("url"))
    new = t.join(presence.select("target_id").distinct(), "target_id", "left_anti")
    blank = [F.lit("").alias(c) for c in PRESENCE if c.startswith("gold") or c == "notes"]
    fresh = new.select(F.col("o").cast("string").alias("label_order"), "target_id", "target_type", "url", *blank)
    old = presence.join(t.select("target_id", "o"), "target_id", "left").withColumn("label_order", F.coalesce(F.col("o").cast("string"), "label_order"))
    return old.select(*PRESENCE).unionByName(fresh.select(*PRESENCE))


def reconcile_manual_docs(sheet: DataFrame, manual: DataFrame) -> DataFrame:
    """Sheet with a row for every manually added document ``(target_id, doc_id, url, role)`` that it lacks, with its target's order and type."""
    t = sheet.groupBy("target_id").agg(F.min("label_order").alias("label_order"), F.min("target_type").alias("target_type"))
    miss = manual.select("target_id", "doc_id", "url", "role").dropDuplicates(["target_id", "doc_id"]).join(sheet.select("target_id", "doc_id"), ["target_id", "doc_id"], "left_anti").join(t, "target_id")
    cols = [c for c in sheet.columns if c != "_row"]
    have = set(miss.columns)
    return sheet.select(*cols).unionByName(miss.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in cols]))


def target_steps(relevance_: DataFrame, typology_: DataFrame, presence: DataFrame, propagation_: DataFrame) -> DataFrame:
    """Per target: documents and clauses done and in all, and whether each of the three steps is complete."""
    r = relevance_.groupBy("target_id").agg(F.count_if(filled(F.col("gold_relevant"))).alias("docs_done"), F.count("*").alias("docs_total"))
    need = relevance_.where("trim(gold_relevant) = '1'").select("target_id", "doc_id").join(typology_.select("target_id", "doc_id", filled(F.col("gold_facets")).alias("ok")), ["target_id", "doc_id"], "left")
    s2 = need.groupBy("target_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("s2"))
    s3 = presence.groupBy("target_id").agg(F.bool_or(filled(F.col("gold_pp_present")) & filled(F.col("gold_list_present"))).alias("s3"))
    c = propagation_.groupBy("target_id").agg(F.count("*").alias("clauses_total"), F.count_if(filled(F.col("gold_correct"))).alias("clauses_done"))
    j = r.join(s2, "target_id", "left").join(s3, "target_id", "left").join(c, "target_id", "left")
    return j.select(
        "target_id", "docs_done", "docs_total", (F.col("docs_done") == F.col("docs_total")).alias("s1"),
        ((F.col("docs_done") == F.col("docs_total")) & F.coalesce("s2", F.lit(True))).alias("s2"), F.coalesce("s3", F.lit(False)).alias("s3"),
        F.coalesce("clauses_total", F.lit(0)).alias("clauses_total"), F.coalesce("clauses_done", F.lit(0)).alias("clauses_done"),
    )


def progress(steps: DataFrame) -> DataFrame:
    """``(goal, done, total)`` per kind of label."""
    a = steps.agg(
        F.count_if("s1").alias("relevance"), F.count_if("s3").alias("pp_presence"), F.count_if("s3").alias("list_presence"), F.count_if("s2").alias("typology"),
        F.coalesce(F.sum("clauses_done"), F.lit(0)).alias("propagation"),
    )
    rows = F.array(*[F.struct(F.lit(k).alias("goal"), F.least(F.col(k), F.lit(v)).cast("bigint").alias("done"), F.lit(v).alias("total")) for k, v in LABEL_GOALS.items()])
    return a.select(F.inline(rows))


def target_detail(sheet: DataFrame) -> DataFrame:
    """Read model: per target its rows in order, as one array of structs."""
    cols = [c for c in sheet.columns if c not in ("target_id", "_row")]
    return sheet.groupBy("target_id").agg(F.min(F.col("label_order").try_cast("int")).alias("label_no"), F.array_sort(F.collect_list(F.struct("doc_id", *[c for c in cols if c != "doc_id"]))).alias("rows"))


def save_cells(sheet: DataFrame, updates: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Sheet with the cells of ``updates(keys.., fields..)`` set; a null update leaves a cell, the last of several rows (``_ord``) counts."""
    u = updates if "_ord" in updates.columns else updates.withColumn("_ord", F.monotonically_increasing_id())
    u = u.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_ord"))).alias(f"_u_{f}") for f in fields])
    j = sheet.join(u, keys, "left")
    return j.select(*[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in sheet.columns])


def add_manual_doc(manual: DataFrame, entry: DataFrame) -> DataFrame:
    """Sidecar with one more document ``(target_id, doc_id, url, role)``; an address that the target has already fails."""
    dup = entry.join(manual.select("target_id", "url", F.lit(True).alias("_d")).distinct(), ["target_id", "url"], "left")
    ok = dup.select("target_id", "doc_id", F.when(F.col("_d"), F.raise_error(F.concat(F.lit("duplicate address: "), "url"))).otherwise(F.col("url")).alias("url"), "role")
    return manual.select("target_id", "doc_id", "url", "role").unionByName(ok)


def remove_manual_doc(sheet: DataFrame, target_id: str, doc_id: str) -> DataFrame:
    """Sheet or sidecar without one manually added document."""
    return sheet.where(~((F.col("target_id") == target_id) & (F.col("doc_id") == doc_id) & (F.col("role") == "manual")))
