"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import leakage, mainbody, names, neardup, packing, residue, visual
from tessella.operators.scratch import materialize
from tessella.plans.ship import ship

#: Values of the name columns that aren't names.
NOT_NAMES = ["", "we", "unspecified third party"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _names(spark: SparkSession, d: str) -> DataFrame:
    edges = _t(spark, d, "collect_edges").select(F.col("entity").alias("name"))
    docs = _t(spark, d, "doc_classification").select(F.explode("named_orgs").alias("name"))
    return edges.unionByName(docs).where(F.col("name").isNotNull() & ~F.col("name").isin(NOT_NAMES))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_names(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_names(_names(spark, d))


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(_t(spark, d, "parsed_docs"), shingle=3, threshold=0.6, min_words=120)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs().select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """At the library's defaults: five-word sequences, similarity of 0.8 or more."""
    return neardup.near_duplicates(_t(spark, d, "parsed_docs")).classes().withColumnRenamed("id", "doc_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_t(spark, d, "parsed_docs"), _t(spark, d, "docs")).select("doc_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_t(spark, d, "parsed_docs"), _t(spark, d, "docs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.boilerplate_segments(_t(spark, d, "parsed_docs"), _t(spark, d, "docs"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_bodies(_t(spark, d, "parsed_docs"), _t(spark, d, "docs"))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.decisions(_t(spark, d, "parsed_docs"), _t(spark, d, "docs"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts, those lost or short of tokens, containers beyond the capacity, texts split though they fit, and whether all but a fortieth of the room is used."""
    docs = _t(spark, d, "documents")
    packed = materialize(packing.pack(docs), "packed")
    size = packing.token_counts(docs).groupBy("id").agg(F.sum("n_tokens").alias("n"))
    of = packed.groupBy("id").agg(F.sum("tokens").alias("got"), F.count("*").alias("pieces"))
    items = size.join(of, "id", "left").agg(
        F.count("*").alias("texts"), F.count_if(F.expr("NOT coalesce(got = n, false)")).alias("lost"), F.count_if(F.expr(f"n <= {packing.CAPACITY} AND pieces > 1")).alias("split")
    )
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(
        F.count_if(F.col("used") > packing.CAPACITY).alias("beyond"), (F.sum("used") >= 0.975 * packing.CAPACITY * F.count("*")).alias("well_filled")
    )
    return items.crossJoin(F.broadcast(bins))  # one row each


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p7_overlap(spark: SparkSession, d: str) -> DataFrame:
    """What of question and answer stands in the affected documents."""
    x = leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))
    return x.groupBy("doc_id", "item_id").agg(F.round(F.max("question_overlap"), 6).alias("question_overlap"), F.bool_or("answer_found").alias("answer_found"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = visual.same_look_pairs(_t(spark, d, "documents"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual.same_look_classes(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_visible(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form alone, which SQL can make over the characters of the tables."""
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", visual.visible_form("text").alias("visible"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", visual.visible_form("text").alias("visible"), visual.folded_form("text").alias("folded"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p2_found, p2_classes, p4_found, p4_reasons, p5_found, p5_bodies, p5_rules, p6_containers, p6_invariants, p7_found, p7_overlap, p8_found,
        p8_classes, p8_visible, p8_forms,
    )
}


def _sql_visible(col: str) -> str:
    """SQL for the visible form of ``col`` over the characters that the tables hold."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    alike = [(a, b) for a, b in visual.LOOK_ALIKES.items() if a != b]
    spaces = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9)))
    q = lambda s: s.replace("'", "''")
    x = f"regexp_replace({col}, '[\\x{{AD}}\\x{{34F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
    x = f"translate({x}, '{q(wide + ''.join(a for a, _ in alike) + spaces)}', '{q(plain + ''.join(b for _, b in alike) + ' ' * len(spaces))}')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize({x})"


_P7 = rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower({_sql_visible("text")}), '[\p{{L}}\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower({_sql_visible("text")}), '[\p{{L}}\p{{N}}]+') AS ws, regexp_extract_all(lower({_sql_visible("answer")}), '[\p{{L}}\p{{N}}]+') AS rs FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM d WHERE len(ws) >= 12)),
        ig AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM i WHERE len(ws) >= 12))
        """

ORACLE = {
    "p6_invariants": "SELECT count(*) AS texts, 0 AS lost, 0 AS split, 0 AS beyond, true AS well_filled FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)",
    "p8_visible": f"SELECT doc_id, {_sql_visible('text')} AS visible FROM documents WHERE text IS NOT NULL",
    "p2_found": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM parsed_docs WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, g FROM (
                SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
                FROM w WHERE len(ws) >= 120)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
        SELECT a AS doc_id_a, b AS doc_id_b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k >= 0.6 * (p.n + q.n - k)""",
    "p2_classes": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM parsed_docs WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5)),
        k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS key, count(*) AS n FROM s GROUP BY 1), m AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS rep FROM k),
        r AS (SELECT s.doc_id, g, n FROM s JOIN m USING (doc_id) WHERE m.rep = m.doc_id),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM b WHERE k >= 0.8 * (na + nb - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
        c AS (SELECT a AS rep, least(a, min(b)) AS class_id FROM reach GROUP BY 1), g AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY 1)
        SELECT doc_id, coalesce(class_id, rep) AS class_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN c USING (rep) LEFT JOIN g USING (rep)""",
    "p7_found": _P7 + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p7_overlap": _P7 + """,
        h AS (SELECT doc_id, item_id, count(*) AS k FROM dg JOIN ig USING (g) GROUP BY 1, 2), n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1)
        SELECT doc_id, item_id, round(k / n, 6) AS question_overlap,
               CASE WHEN len(i.rs) > 0 THEN contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(i.rs, ' ') || ' ') END AS answer_found
        FROM h JOIN n USING (item_id) JOIN d USING (doc_id) JOIN i USING (item_id)""",
    "p8_found": f"""
        WITH v AS (SELECT doc_id, text, {_sql_visible("text")} AS look FROM documents WHERE text IS NOT NULL)
        SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b
        FROM v x JOIN v y ON x.look = y.look AND x.doc_id < y.doc_id AND x.text <> y.text""",
    "p8_classes": f"""
        WITH v AS (SELECT doc_id, text, {_sql_visible("text")} AS look FROM documents WHERE text IS NOT NULL),
        c AS (SELECT look, min(doc_id) AS class_id, count(*) AS n_members, count(DISTINCT text) AS n_spellings FROM v GROUP BY 1)
        SELECT doc_id, class_id, n_members, n_spellings FROM v JOIN c USING (look)""",
}
