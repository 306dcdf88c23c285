"""Registered queries of label sheets and reports, and their SQL.

The driver's tables hold no label sheets, so each query makes one from the
classified documents by a rule that its SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import evaluate, graph, labels
from tessella.operators.scratch import materialize
from tessella.plans.queries import _CLASSIFIED, _ONTO, _RELATIONS, _TARGETS, Tables, query

_PLACE = "CAST(('0x' || substr(sha1('1234|' || target_id), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE)"
_RECURSIVE = "WITH RECURSIVE "


def _relevance(t: Tables) -> DataFrame:
    c = t.classified()
    gold = F.when(F.col("medium").isNull(), "").when(F.col("relevant"), " 1 ").otherwise("0")
    return c.select("target_id", "doc_id", F.lit("7").alias("label_order"), F.substring("role", 1, 3).alias("target_type"), "url", gold.alias("gold_relevant"))


_REL = _CLASSIFIED + ", rs AS (SELECT target_id, doc_id, '7' AS label_order, substr(role, 1, 3) AS target_type, url, CASE WHEN medium IS NULL THEN '' WHEN relevant THEN ' 1 ' ELSE '0' END AS gold_relevant FROM cl)"


def _typology(t: Tables) -> DataFrame:
    c = t.classified()
    gold = F.when(F.col("medium").isNull(), "").when(F.size("facets") == 0, "None").otherwise(F.array_join("facets", " ; "))
    return c.select("target_id", "doc_id", gold.alias("gold_facets"))


_TYP = "ts AS (SELECT target_id, doc_id, CASE WHEN medium IS NULL THEN '' WHEN len(facets) = 0 THEN 'None' ELSE array_to_string(facets, ' ; ') END AS gold_facets FROM cl)"


def _presence(t: Tables) -> DataFrame:
    """One row per target, two for data brokers, whose second row counts."""
    x = t.clean_targets()
    mark = F.when(F.col("target_type") == "website", "").when(F.col("seed_policy_url").isNotNull(), " Yes").otherwise("0")
    rows = F.when(F.col("target_type") == "data_broker", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    x = x.select("target_id", "target_type", "url", mark.alias("m"), F.explode(rows).alias("_row"))
    return x.select("_row", F.lit("").alias("label_order"), "target_id", "target_type", "url", F.when(F.col("_row") == 2, "true").otherwise(F.col("m")).alias("gold_pp_present"), F.lit("1").alias("gold_list_present"))


_PRES = _TARGETS + """, ps AS (SELECT row AS _row, target_id, target_type, url, CASE WHEN row = 2 THEN 'true' WHEN target_type = 'website' THEN '' WHEN seed_policy_url IS NOT NULL THEN ' Yes' ELSE '0' END AS gold_pp_present, '1' AS gold_list_present
    FROM (SELECT *, unnest(CASE WHEN target_type = 'data_broker' THEN [1, 2] ELSE [1] END) AS row FROM tg))"""


@query("WITH " + _CLASSIFIED + f""", t AS (SELECT DISTINCT target_id FROM cl WHERE target_id IS NOT NULL), k AS (SELECT target_id, row_number() OVER (ORDER BY length(target_id), target_id) AS r FROM t WHERE length(target_id) % 3 <> 0),
    pl AS (SELECT target_id, CAST(r AS DOUBLE) AS place FROM k UNION ALL SELECT target_id, {_PLACE} * ((SELECT count(*) FROM k) + 1) FROM t WHERE length(target_id) % 3 = 0)
    SELECT target_id, CAST(row_number() OVER (ORDER BY place, target_id) AS INT) AS label_order FROM pl""")
def b2_interleave_fresh(spark, d):
    t = Tables(spark, d).classified().select("target_id").distinct()
    prior = t.where("length(target_id) % 3 <> 0").select("target_id", F.length("target_id").cast("string").alias("label_order"))
    return labels.shuffled_targets(t, prior)


@query("""SELECT target_id, doc_id, arg_max(role, loaded_at) FILTER (WHERE trim(role) <> '') AS gold_relevant, arg_max(error, loaded_at) FILTER (WHERE trim(error) <> '') AS notes FROM docs GROUP BY 1, 2""")
def b3_prior_gold(spark, d):
    s = Tables(spark, d).docs.select("target_id", "doc_id", F.col("role").alias("gold_relevant"), F.col("error").alias("notes"), F.col("loaded_at").alias("_row"), F.lit("1").alias("label_order"))
    return labels.prior_gold(s, "gold_relevant")[1]


@query("WITH " + _CLASSIFIED + """, a AS (SELECT target_id, array_to_string(list_sort(list_distinct(flatten(list(facets)))), ';') AS class FROM cl GROUP BY 1), o AS (SELECT target_id, row_number() OVER (ORDER BY substr(sha1('1234|' || target_id), 1, 12), target_id) AS k FROM (SELECT DISTINCT target_id FROM cl))
    SELECT CAST(k AS VARCHAR) AS label_order, target_id, '' AS target_type, doc_id, coalesce(role, '') AS role, coalesce(url, '') AS url, coalesce(medium, '') AS predicted_medium, array_to_string(facets, ';') AS predicted_doc_facets, class AS predicted_target_class,
    '' AS gold_facets, '' AS notes FROM cl JOIN o USING (target_id) JOIN a USING (target_id)""")
def b5_typology_sheet(spark, d):
    c = Tables(spark, d).classified().withColumn("target_type", F.lit(""))
    of = c.groupBy("target_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("facets")))).alias("facets"))
    return labels.typology_sheet(c, of)


def _low_ontology(t: Tables) -> DataFrame:
    return graph.ontology_edges(t.ccpa_data_ontology).select(F.lower("hypernym").alias("hypernym"), F.lower("hyponym").alias("hyponym"))


_UP = _ONTO.removeprefix("WITH ") + ", up(a, b) AS (SELECT lower(hypernym), lower(hyponym) FROM oe UNION SELECT u.a, lower(oe.hyponym) FROM up u JOIN oe ON lower(oe.hypernym) = u.b)"


@query(_RECURSIVE + _RELATIONS + ", " + _UP + """, c AS (SELECT target_id, entity, arg_min(data_type, ord) AS data_type FROM rl WHERE NOT negative AND data_type <> '' GROUP BY 1, 2),
    dn AS (SELECT a, array_to_string(list_sort(list(DISTINCT b)), ';') AS p FROM up WHERE a <> b GROUP BY 1), o AS (SELECT target_id, row_number() OVER (ORDER BY substr(sha1('1234|' || target_id), 1, 12), target_id) AS k FROM (SELECT DISTINCT target_id FROM c))
    SELECT CAST(k AS VARCHAR) AS label_order, target_id || '::' || entity || '::' || data_type AS clause_id, target_id, entity, data_type, coalesce(p, '') AS predicted_propagated, '' AS gold_correct, '' AS notes
    FROM c JOIN o USING (target_id) LEFT JOIN dn ON dn.a = c.data_type""")
def b7_propagation_sheet(spark, d):
    t = Tables(spark, d)
    return labels.propagation_sheet(t.relations(), graph.closure(_low_ontology(t), src="hypernym", dst="hyponym"))


@query("WITH " + _REL + " SELECT target_id, doc_id, CAST(trim(gold_relevant) AS INT) AS gold FROM rs WHERE trim(gold_relevant) IN ('0', '1')")
def b8_relevance_gold(spark, d):
    return labels.relevance_gold(_relevance(Tables(spark, d)))


@query("WITH " + _PRES + " SELECT target_id, lower(trim(arg_max(gold_pp_present, _row))) IN ('1', 'true', 'yes') AS present FROM ps WHERE trim(gold_pp_present) <> '' GROUP BY 1")
def b10_presence_gold(spark, d):
    return labels.presence_gold(_presence(Tables(spark, d)), "gold_pp_present")


@query("WITH " + _RELATIONS + """, s AS (SELECT target_id || '::' || entity AS clause_id, ord, CASE WHEN negative THEN 'no' WHEN party = 'first' THEN '' ELSE 'TRUE' END AS gold_correct FROM rl)
    SELECT clause_id, arg_max(gold_correct, ord) = 'TRUE' AS correct FROM s WHERE gold_correct <> '' GROUP BY 1""")
def b11_propagation_gold(spark, d):
    r = Tables(spark, d).relations()
    mark = F.when(F.col("negative"), "no").when(F.col("party") == "first", "").otherwise("TRUE")
    return labels.propagation_gold(r.select(F.concat_ws("::", "target_id", "entity").alias("clause_id"), F.col("ord").alias("_row"), mark.alias("gold_correct")))


@query("WITH " + _CLASSIFIED + ", " + _TYP + " SELECT target_id, array_to_string(list_sort(list(DISTINCT doc_id)), ';') AS doc_ids FROM ts WHERE trim(gold_facets) <> '' GROUP BY 1")
def b12_typology_gold_docs(spark, d):
    return labels.typology_gold_docs(_typology(Tables(spark, d))).select("target_id", F.array_join("doc_ids", ";").alias("doc_ids"))


@query("WITH " + _REL + ", " + _TARGETS + """, pr AS (SELECT target_id, target_type, url FROM tg WHERE target_type <> 'website'), t AS (SELECT target_id, min(target_type) AS target_type, min(url) AS url FROM rs GROUP BY 1)
    SELECT CASE WHEN t.target_id IS NULL THEN '' ELSE '7' END AS label_order, pr.target_id, pr.target_type, pr.url, '1' AS gold_pp_present FROM pr LEFT JOIN t USING (target_id)
    UNION ALL SELECT '7', target_id, target_type, url, '' FROM t WHERE target_id NOT IN (SELECT target_id FROM pr)""")
def b14_ensure_presence_rows(spark, d):
    t = Tables(spark, d)
    old = t.clean_targets().where("target_type <> 'website'").select("target_id", "target_type", "url")
    old = old.select(*[F.lit("1" if c == "gold_pp_present" else "").alias(c) if c not in ("target_id", "target_type", "url") else F.col(c) for c in labels.PRESENCE])
    return labels.ensure_presence_rows(old, _relevance(t)).select("label_order", "target_id", "target_type", "url", "gold_pp_present")


@query("WITH " + _REL + """, m AS (SELECT DISTINCT target_id, doc_id || '-m' AS doc_id, url || '?m' AS url FROM rs WHERE gold_relevant = '0'), t AS (SELECT target_id, min(target_type) AS target_type FROM rs GROUP BY 1)
    SELECT target_id, doc_id, label_order, target_type, url, gold_relevant FROM rs UNION ALL SELECT m.target_id, m.doc_id, '7', t.target_type, m.url, '' FROM m JOIN t USING (target_id)""")
def b15_reconcile_manual(spark, d):
    s = _relevance(Tables(spark, d))
    manual = s.where("gold_relevant = '0'").select("target_id", F.concat("doc_id", F.lit("-m")).alias("doc_id"), F.concat("url", F.lit("?m")).alias("url"), F.lit("manual").alias("role"))
    known = s.select("target_id", "doc_id", "url", F.lit("").alias("role"))
    return labels.reconcile_manual_docs(s, manual.unionByName(manual).unionByName(known))


_STEPS = _REL + ", " + _TYP + ", " + _PRES + ", " + _RELATIONS + """, pg AS (SELECT target_id, CASE WHEN negative THEN '' ELSE '1' END AS gold_correct FROM rl),
    r AS (SELECT target_id, count(*) FILTER (WHERE trim(gold_relevant) <> '') AS docs_done, count(*) AS docs_total FROM rs GROUP BY 1),
    n2 AS (SELECT target_id, bool_and(coalesce(trim(gold_facets) <> '', false)) AS s2 FROM rs LEFT JOIN ts USING (target_id, doc_id) WHERE trim(gold_relevant) = '1' GROUP BY 1),
    n3 AS (SELECT target_id, bool_or(trim(gold_pp_present) <> '' AND trim(gold_list_present) <> '') AS s3 FROM ps GROUP BY 1), n4 AS (SELECT target_id, count(*) AS clauses_total, count(*) FILTER (WHERE gold_correct <> '') AS clauses_done FROM pg GROUP BY 1),
    st AS (SELECT target_id, docs_done, docs_total, docs_done = docs_total AS s1, docs_done = docs_total AND coalesce(s2, true) AS s2, coalesce(s3, false) AS s3, coalesce(clauses_total, 0) AS clauses_total, coalesce(clauses_done, 0) AS clauses_done
      FROM r LEFT JOIN n2 USING (target_id) LEFT JOIN n3 USING (target_id) LEFT JOIN n4 USING (target_id))"""


def _steps(t: Tables) -> DataFrame:
    prop = t.relations().select("target_id", F.when(F.col("negative"), "").otherwise("1").alias("gold_correct"))
    return labels.target_steps(_relevance(t), _typology(t), _presence(t), prop)


@query("WITH " + _STEPS + " SELECT * FROM st")
def b16_target_steps(spark, d):
    return _steps(Tables(spark, d))


@query("WITH " + _STEPS + """ SELECT 'relevance' AS goal, least(count(*) FILTER (WHERE s1), 100) AS done, CAST(100 AS INT) AS total FROM st UNION ALL SELECT 'pp_presence', least(count(*) FILTER (WHERE s3), 100), 100 FROM st
    UNION ALL SELECT 'list_presence', least(count(*) FILTER (WHERE s3), 100), 100 FROM st UNION ALL SELECT 'typology', least(count(*) FILTER (WHERE s2), 50), 50 FROM st UNION ALL SELECT 'propagation', CAST(least(sum(clauses_done), 30) AS BIGINT), 30 FROM st""")
def b17_progress(spark, d):
    return labels.progress(_steps(Tables(spark, d)))


@query("WITH " + _REL + " SELECT target_id, 7 AS label_no, count(*) AS docs, string_agg(doc_id || '=' || gold_relevant, ';' ORDER BY doc_id) AS rows FROM rs GROUP BY 1")
def b18_target_detail(spark, d):
    x = labels.target_detail(_relevance(Tables(spark, d)))
    return x.select("target_id", "label_no", F.size("rows").cast("bigint").alias("docs"), F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["doc_id"], r["gold_relevant"])), ";").alias("rows"))


@query("WITH " + _REL + """ SELECT target_id, doc_id, label_order, CASE WHEN gold_relevant = '' THEN 'seen' WHEN gold_relevant = '0' THEN '1' ELSE gold_relevant END AS gold_relevant FROM rs""")
def b19_save_cells(spark, d):
    s = _relevance(Tables(spark, d)).select("target_id", "doc_id", "label_order", "gold_relevant")
    first = s.where("gold_relevant <> ' 1 '").select("target_id", "doc_id", F.lit("seen").alias("gold_relevant"), F.lit(1).alias("_ord"))
    then = s.where("gold_relevant = '0'").select("target_id", "doc_id", F.lit("1").alias("gold_relevant"), F.lit(2).alias("_ord"))
    none = s.where("gold_relevant = ''").select("target_id", "doc_id", F.lit(None).cast("string").alias("gold_relevant"), F.lit(3).alias("_ord"))
    return labels.save_cells(s, first.unionByName(then).unionByName(none), ["target_id", "doc_id"], ["gold_relevant"])


@query("WITH " + _CLASSIFIED + """, t AS (SELECT target_id, bool_or(len(facets) > 0) AS c FROM cl GROUP BY 1), x AS (SELECT count(*) FILTER (WHERE c) / count(*) AS s FROM t)
    SELECT printf('Coverage: %.1f%% (goal 90%%) ', s * 100) || CASE WHEN s >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS summary, s >= 0.9 AS passed FROM x""")
def e12_summary(spark, d):
    c = Tables(spark, d).classified().groupBy("target_id").agg(F.bool_or(F.size("facets") > 0).alias("classified"))
    return evaluate.summary(evaluate.coverage(c), "coverage", evaluate.GOALS["coverage"], "Coverage")


@query("WITH " + _CLASSIFIED + ", " + _TARGETS + """, g AS (SELECT CASE WHEN target_type IN ('play_store_app', 'app_store_app') THEN 'app' ELSE 'website' END AS grp, target_type, doc_id, len(facets) > 0 AS c FROM cl JOIN tg USING (target_id))
    SELECT coalesce(grp, 'all') AS grp, coalesce(target_type, 'all') AS target_type, count(*) AS docs, count(*) FILTER (WHERE c) AS with_facets FROM g GROUP BY GROUPING SETS ((grp, target_type), (grp), ())""")
def e13_grouped_report(spark, d):
    t = Tables(spark, d)
    x = t.classified().join(t.clean_targets().select("target_id", "target_type"), "target_id")
    return evaluate.grouped(x)
