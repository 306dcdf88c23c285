"""Registered queries of the core, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions import entities as en
from tessella.functions import html as hx
from tessella.functions import text as tx
from tessella.functions import urls
from tessella.functions.registry import ads_txt_relations
from tessella.operators import annotate, collect, evaluate, graph, labels, relations, report, tables, typology, verdicts
from tessella.operators.hierarchy import expand_hierarchy
from tessella.operators.scratch import materialize, spread
from tessella.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


class Tables:
    """Tables of one folder, and the views on them that several queries share."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.d}/{name}.parquet")

    def clean_targets(self) -> DataFrame:
        t = self.targets
        return t.select("target_id", "target_type", tx.clean(F.col("name")).alias("name"), F.regexp_replace("url", "/$", "").alias("url"), "app_id", F.nullif("seed_policy_url", F.lit("")).alias("seed_policy_url")).groupBy("target_id").agg(
            *[F.max(c).alias(c) for c in ("target_type", "name", "url", "app_id", "seed_policy_url")]
        )

    def clean_docs(self) -> DataFrame:
        d = collect.latest_deliveries(self.docs)
        role = F.regexp_replace(F.lower(F.trim("role")), "[ -]+", "_")
        return d.withColumn("role", role).withColumn("ok", corpus.is_ok(F.col("http_status"), F.col("raw_path"), F.col("error")))

    def gazetteer_(self) -> en.Gazetteer:
        return en.Gazetteer.from_table(self.gazetteer)

    def classified(self) -> DataFrame:
        """doc_classification, once per document."""
        return self.doc_classification.groupBy("target_id", "doc_id").agg(
            F.max(F.coalesce("relevant", F.lit(False))).alias("relevant"), F.max("medium").alias("medium"), F.max("role").alias("role"), F.max("url").alias("url"), F.max("evidence").alias("evidence"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("facets")))).alias("facets"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("named_orgs", F.array().cast("array<string>")))))).alias("named_orgs"),
        )

    def edges(self) -> DataFrame:
        """collect_edges, once per edge."""
        return self.collect_edges.drop("loaded_at").dropDuplicates(["edge_id"])

    def relations(self) -> DataFrame:
        e = self.edges().where("entity <> ''")
        return e.select(
            "target_id", "doc_id", F.lower(F.trim("entity")).alias("entity"), F.lower(tx.clean(F.col("data_type"))).alias("data_type"), "action", (F.col("edge_type") == "NOT_COLLECT").alias("negative"),
            F.when(F.col("entity") == "we", "first").otherwise("third").alias("party"), (F.col("entity") == "unspecified third party").alias("unspecified"), "purposes",
            F.array().cast("array<string>").alias("examples"), F.lit("").alias("qualifier"), F.array(F.lit("policy")).alias("sources"), F.coalesce(F.get("text", F.lit(0)), F.lit("")).alias("text"), F.col("edge_id").alias("ord"),
        )


def j(c: str, name: str | None = None):
    """Sorted array as text, so that any engine prints it alike."""
    return F.array_join(F.array_sort(c), ";").alias(name or c)


# Views that the SQL of several queries shares.
_TARGETS = """tg AS (SELECT target_id, max(target_type) AS target_type, max(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS name, max(regexp_replace(url, '/$', '')) AS url, max(app_id) AS app_id,
    max(nullif(seed_policy_url, '')) AS seed_policy_url FROM targets GROUP BY 1)"""
_DOCS = """dc AS (SELECT * EXCLUDE (role, _r), regexp_replace(lower(trim(role)), '[ -]+', '_', 'g') AS role,
    coalesce(http_status, 0) = 200 AND coalesce(raw_path, '') <> '' AND coalesce(error, '') = '' AS ok
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST, url) AS _r FROM docs WHERE doc_id IS NOT NULL) WHERE _r = 1)"""
_CLASSIFIED = """cl AS (SELECT target_id, doc_id, max(coalesce(relevant, false)) AS relevant, max(medium) AS medium, max(role) AS role, max(url) AS url, max(evidence) AS evidence,
    list_sort(list_distinct(flatten(list(coalesce(facets, []))))) AS facets, list_sort(list_distinct(flatten(list(coalesce(named_orgs, []))))) AS named_orgs FROM doc_classification GROUP BY 1, 2)"""
_EDGES = "ce AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id) AS _r FROM collect_edges) WHERE _r = 1)"
_RELATIONS = _EDGES + """, rl AS (SELECT target_id, doc_id, lower(trim(entity)) AS entity, lower(trim(regexp_replace(data_type, '\\s+', ' ', 'g'))) AS data_type, action, edge_type = 'NOT_COLLECT' AS negative,
    CASE WHEN entity = 'we' THEN 'first' ELSE 'third' END AS party, purposes, coalesce(text[1], '') AS text, edge_id AS ord FROM ce WHERE entity <> '')"""


# -- hierarchies (problem 3) and ontologies -----------------------------------

_P3 = """
    WITH RECURSIVE ids AS (SELECT DISTINCT id FROM ccpa_data_ontology WHERE id IS NOT NULL),
    e AS (SELECT DISTINCT p AS parent, id AS child FROM (SELECT id, unnest(parents) AS p FROM ccpa_data_ontology) WHERE p IN (SELECT id FROM ids) AND id IS NOT NULL),
    paths(id, path) AS (
        SELECT id, [id] FROM ids WHERE id NOT IN (SELECT child FROM e)
        UNION ALL SELECT e.child, list_append(path, e.child) FROM paths JOIN e ON e.parent = paths.id WHERE NOT list_contains(path, e.child)),
    reach(a, b) AS (SELECT parent, child FROM e UNION SELECT r.a, e.child FROM reach r JOIN e ON e.parent = r.b)
"""


@query(_P3 + "SELECT id, array_to_string(path, '/') AS path FROM paths UNION ALL SELECT a, 'cycle' FROM reach WHERE a = b")
def p3_found(spark, d):
    h = expand_hierarchy(Tables(spark, d).ccpa_data_ontology)
    return h.paths.select("id", F.array_join("path", "/").alias("path")).unionByName(h.cyclic.select("id", F.lit("cycle").alias("path")))


@query(_P3 + """,
    d AS (SELECT DISTINCT anc, id FROM (SELECT id, unnest(path) AS anc FROM paths) WHERE anc <> id),
    nd AS (SELECT anc AS id, count(*) AS n FROM d GROUP BY 1),
    p AS (SELECT id, min(len(path)) AS lo, max(len(path)) AS hi, count(*) AS n, array_to_string(list_sort(list(DISTINCT path[1])), ';') AS roots FROM paths GROUP BY 1)
    SELECT ids.id, CAST(lo AS INT) AS min_depth, CAST(hi AS INT) AS max_depth, coalesce(p.n, 0) AS n_paths, roots, coalesce(nd.n, 0) AS n_descendants,
           ids.id IN (SELECT a FROM reach WHERE a = b) AS on_cycle
    FROM ids LEFT JOIN p USING (id) LEFT JOIN nd USING (id)""")
def p3_summary(spark, d):
    return expand_hierarchy(Tables(spark, d).ccpa_data_ontology).summary().withColumn("roots", F.array_join("roots", ";"))


_ONTO = """WITH lab AS (SELECT id, min(coalesce(label, id)) AS label FROM ccpa_data_ontology WHERE id IS NOT NULL GROUP BY 1),
    oe AS (SELECT DISTINCT b.label AS hypernym, a.label AS hyponym FROM (SELECT id, unnest(parents) AS p FROM ccpa_data_ontology) x JOIN lab a ON a.id = x.id JOIN lab b ON b.id = x.p)"""


@query(_ONTO + " SELECT * FROM oe")
def o1_ontology_edges(spark, d):
    return graph.ontology_edges(Tables(spark, d).ccpa_data_ontology)


@query(_ONTO.replace("WITH ", "WITH RECURSIVE ", 1) + """, cl(a, b) AS (SELECT hypernym, hyponym FROM oe UNION SELECT c.a, oe.hyponym FROM cl c JOIN oe ON oe.hypernym = c.b)
    SELECT a AS ancestor, b AS descendant FROM cl""")
def o4_ontology_closure(spark, d):
    return graph.closure(graph.ontology_edges(Tables(spark, d).ccpa_data_ontology), src="hypernym", dst="hyponym")


@query(_ONTO + " SELECT DISTINCT label AS name, label NOT IN (SELECT hyponym FROM oe) AS is_root, label NOT IN (SELECT hypernym FROM oe) AS is_leaf FROM lab")
def o5_roots_and_leaves(spark, d):
    o = Tables(spark, d).ccpa_data_ontology
    return graph.roots_and_leaves(graph.ontology_edges(o), o.where("id IS NOT NULL").groupBy("id").agg(F.min(F.coalesce("label", "id")).alias("name")))


@query("""WITH n AS (SELECT DISTINCT lower(trim(regexp_replace(data_type, '\\s+', ' ', 'g'))) AS name FROM collect_edges WHERE data_type IS NOT NULL)
    SELECT n.name, max(def) AS definition, count(o.id) > 0 AS known FROM n LEFT JOIN ccpa_data_ontology o ON lower(o.label) = n.name WHERE n.name <> '' GROUP BY 1""")
def o6_define_terms(spark, d):
    t = Tables(spark, d)
    n = t.collect_edges.select(F.lower(tx.clean(F.col("data_type"))).alias("name")).where("name <> ''").distinct()
    o = t.ccpa_data_ontology.select(F.lower("label").alias("name"), "def", "id")
    return n.join(o, "name", "left").groupBy("name").agg(F.max("def").alias("definition"), (F.count("id") > 0).alias("known"))


# -- sources and collection -----------------------------------------------------


@query("WITH " + _TARGETS + """ SELECT *, substr(regexp_replace(regexp_replace(lower(coalesce(name, url, app_id, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM tg""")
def c1_seed_targets(spark, d):
    t = Tables(spark, d).clean_targets()
    return t.withColumn("slug", urls.slug(F.coalesce("name", "url", "app_id", F.lit(""))))


@query("WITH " + _DOCS + """ SELECT doc_id, target_id, role, ok, strftime(make_timestamp(CAST(floor(CASE WHEN fetched_at >= 1e11 THEN fetched_at / 1000 ELSE fetched_at END) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS fetched,
    sha1(url) AS cache_key FROM dc""")
def c5_latest_docs(spark, d):
    x = Tables(spark, d).clean_docs()
    at = F.date_format(corpus.fetched_time(F.floor(F.when(F.col("fetched_at") >= 1e11, F.col("fetched_at") / 1000).otherwise(F.col("fetched_at")))), "yyyy-MM-dd HH:mm:ss")
    return x.select("doc_id", "target_id", "role", "ok", at.alias("fetched"), F.sha1("url").alias("cache_key"))


@query("""SELECT doc_id, coalesce(contains(lower(content_type), 'pdf'), false) OR coalesce(ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.pdf'), false) AS is_pdf, count(*) AS n FROM docs GROUP BY 1, 2""")
def c11_looks_like_pdf(spark, d):
    x = Tables(spark, d).docs
    return x.select("doc_id", urls.looks_like_pdf(F.col("content_type"), F.col("url"), F.lit(None).cast("binary")).alias("is_pdf")).groupBy("doc_id", "is_pdf").agg(F.count("*").alias("n"))


_ROLE_LIST = ", ".join(f"('{r}', {i}, '{p.replace(chr(39), chr(39) * 2)}')" for i, (r, p) in enumerate(lx.LINK_ROLES))


@query(f"""WITH {_DOCS}, roles(role, rank, pat) AS (VALUES {_ROLE_LIST}),
    l AS (SELECT p.doc_id, regexp_extract(dc.url, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) AS org, unnest(links) AS x FROM parsed_docs p JOIN dc USING (doc_id))
    SELECT doc_id, org || x.href AS url, roles.role AS role, count(*) AS n FROM l JOIN roles ON regexp_matches(concat_ws(' ', x.text, x.href), roles.pat) WHERE x.href LIKE '/%' GROUP BY 1, 2, 3""")
def c19_discovered_links(spark, d):
    t = Tables(spark, d)
    pages = t.parsed_docs.select("doc_id", "links").join(t.clean_docs().select("doc_id", "url"), "doc_id")
    return collect.discovered_links(pages).groupBy("doc_id", "url", "role").agg(F.count("*").alias("n"))


@query("WITH " + _DOCS + """ SELECT target_id, url FROM (SELECT target_id, url, row_number() OVER (PARTITION BY target_id ORDER BY CAST(contains(lower(url), 'cookie') AS INT),
    CAST(regexp_matches(lower(url), 'settings|preference|choices') AS INT), CAST(NOT contains(lower(url), 'privacy') AS INT), length(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), url) AS r FROM dc) WHERE r = 1""")
def c20_best_policy_url(spark, d):
    return collect.best_policy_url(Tables(spark, d).clean_docs().select("target_id", "url"))


@query("""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM docs WHERE url IS NOT NULL)
    SELECT host, CASE WHEN len(string_split(host, '.')) < 3 THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS registrable FROM h""")
def c21_registrable(spark, d):
    h = Tables(spark, d).docs.where("url IS NOT NULL").select(urls.host(F.col("url")).alias("host")).distinct()
    return h.select("host", urls.registrable(F.col("host")).alias("registrable"))


@query("WITH " + _DOCS + """ SELECT target_id, doc_id FROM (SELECT target_id, doc_id, row_number() OVER (PARTITION BY target_id, sha1(trim(coalesce(text, ''))) ORDER BY doc_id) AS r FROM parsed_docs JOIN dc USING (doc_id)) WHERE r = 1""")
def c22_first_per_content(spark, d):
    t = Tables(spark, d)
    # twenty bytes of each text go to the join, not the text
    keys = materialize(t.parsed_docs.select("doc_id", tx.sha1_of_trimmed(F.coalesce("text", F.lit(""))).alias("key")), "keys")
    x = keys.join(t.clean_docs().select("doc_id", "target_id"), "doc_id").withColumn("ord", F.col("doc_id"))
    return collect.first_per_content(x, key="key").select("target_id", "doc_id")


_ROOT = """, c AS (SELECT target_id, 0 AS rank, seed_policy_url AS url FROM tg UNION ALL SELECT target_id, 1, url FROM tg UNION ALL SELECT target_id, CASE WHEN role = 'privacy_policy' THEN 2 ELSE 3 END, url FROM dc),
    rt AS (SELECT target_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS root FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rank, url) AS r FROM c
      WHERE coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') NOT IN ('', 'play.google.com', 'apps.apple.com', 'itunes.apple.com', 'support.google.com')) WHERE r = 1)"""


@query("WITH " + _TARGETS + ", " + _DOCS + _ROOT + """, want AS (SELECT target_id, unnest(CASE WHEN target_type IN ('play_store_app', 'app_store_app')
      THEN [{'role': 'app_ads_txt', 'path': '/app-ads.txt'}, {'role': 'sellers_json', 'path': '/sellers.json'}, {'role': 'vendors_json', 'path': '/vendors.json'}]
      ELSE [{'role': 'ads_txt', 'path': '/ads.txt'}, {'role': 'sellers_json', 'path': '/sellers.json'}, {'role': 'vendors_json', 'path': '/vendors.json'}] END) AS w FROM tg)
    SELECT target_id, w.role AS role, root || w.path AS url FROM want JOIN rt USING (target_id) WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.target_id = want.target_id AND dc.role = w.role)""")
def c24_registry_candidates(spark, d):
    t = Tables(spark, d)
    return collect.registry_candidates(t.clean_targets(), t.clean_docs())


@query("WITH " + _TARGETS + ", " + _DOCS + _ROOT + " SELECT * FROM rt")
def c26_root_urls(spark, d):
    t = Tables(spark, d)
    return collect.root_urls(t.clean_targets(), t.clean_docs())


@query("WITH " + _DOCS + ", " + _CLASSIFIED + " SELECT DISTINCT cl.target_id FROM cl JOIN dc USING (doc_id) WHERE dc.ok AND cl.medium IS NOT NULL")
def c30_usable_targets(spark, d):
    t = Tables(spark, d)
    return collect.usable_targets(t.classified(), t.clean_docs())


@query("WITH " + _TARGETS + ", " + _DOCS + ", " + _CLASSIFIED + """, u AS (SELECT DISTINCT cl.target_id FROM cl JOIN dc USING (doc_id) WHERE dc.ok AND cl.medium IS NOT NULL),
    t AS (SELECT target_type, target_id, row_number() OVER (PARTITION BY target_type ORDER BY substr(sha1('1234|' || target_id), 1, 12), target_id) AS tried FROM tg),
    s AS (SELECT t.*, u.target_id IS NOT NULL AS ok, sum(CASE WHEN u.target_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY target_type ORDER BY tried) AS n FROM t LEFT JOIN u USING (target_id) WHERE tried <= 30)
    SELECT target_type, target_id, CAST(tried AS INT) AS tried FROM s WHERE ok AND n <= 10""")
def c32_stratified_sample(spark, d):
    t = Tables(spark, d)
    return collect.stratified_sample(t.clean_targets(), collect.usable_targets(t.classified(), t.clean_docs()), 10)


@query("WITH " + _DOCS + """ SELECT count(DISTINCT target_id) AS targets, count(*) AS docs, count(*) FILTER (WHERE ok) AS ok_docs, count(*) FILTER (WHERE role IN ('ads_txt', 'app_ads_txt', 'sellers_json', 'vendors_json', 'tcf_gvl')) AS registries,
    count(*) FILTER (WHERE role = 'vendor_list') AS vendor_list, count(*) FILTER (WHERE role = 'subprocessor_list') AS subprocessor_list, count(*) FILTER (WHERE role = 'do_not_sell') AS do_not_sell, count(*) FILTER (WHERE role = 'partners_page') AS partners_page FROM dc""")
def c33_collection_report(spark, d):
    return collect.collection_report(Tables(spark, d).clean_docs())


# -- text -------------------------------------------------------------------------


@query("""SELECT doc_id, trim(regexp_replace(text, '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS cleaned FROM documents""")
def x1_clean(spark, d):
    return Tables(spark, d).documents.select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(None)
def x2_parse_html(spark, d):
    p = hx.parse_documents(spread(Tables(spark, d).parsed_docs.select("doc_id", "raw")), "doc_id", "raw")
    return p.select(F.col("id").alias("doc_id"), "doc.title", F.length("doc.text").alias("chars"), F.size("doc.segments").alias("segments"), F.size("doc.tables").alias("tables"), F.size("doc.links").alias("links"), F.size("doc.nodes").alias("nodes"))


@query("""SELECT doc_id, CAST(len(list_filter(segments, lambda x, i: i = 1 OR x IS DISTINCT FROM segments[i - 1])) AS INT) AS kept, CAST(len(segments) AS INT) AS n FROM parsed_docs WHERE segments IS NOT NULL""")
def x10_dedupe_adjacent(spark, d):
    p = Tables(spark, d).parsed_docs.where("segments IS NOT NULL")
    return p.select("doc_id", F.size(tx.dedupe_adjacent(F.col("segments"))).alias("kept"), F.size("segments").alias("n"))


@query(None)
def x11_reflow(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.size(tx.reflow(F.coalesce("text", F.lit("")))).alias("segments"))


@query(None)
def x14_sentences(spark, d):
    p = hx.parse_documents(spread(Tables(spark, d).parsed_docs.select("doc_id", "raw")), "doc_id", "raw", ("nodes",))
    n = p.select(F.col("id").alias("doc_id"), F.inline("doc.nodes"))
    return hx.sentences(n).groupBy("doc_id", "variant").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, unnest(segments) AS s FROM parsed_docs),
    p AS (SELECT doc_id, CASE WHEN length(s) <= 600 THEN [s] ELSE list_filter(string_split(regexp_replace(s, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: trim(x) <> '') END AS a FROM s)
    SELECT doc_id, CAST(sum(len(a)) AS BIGINT) AS parts FROM p GROUP BY 1""")
def x17_sentence_segments(spark, d):
    p = Tables(spark, d).parsed_docs
    return p.select("doc_id", F.explode(tx.sentence_segments("segments")).alias("s")).groupBy("doc_id").agg(F.count("*").alias("parts"))


@query("SELECT doc_id, regexp_extract(url, '^(https?://[^/?#\\s]+)', 1) AS origin, count(*) AS n FROM docs WHERE url LIKE 'http%' GROUP BY 1, 2")
def x18_origin(spark, d):
    return Tables(spark, d).docs.where("url LIKE 'http%'").select("doc_id", urls.origin(F.col("url")).alias("origin")).groupBy("doc_id", "origin").agg(F.count("*").alias("n"))


def _sq(p: str) -> str:
    return p.replace("'", "''")


@query(f"""WITH s AS (SELECT doc_id, unnest(segments) AS s FROM parsed_docs)
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(s, '{_sq(lx.CATEGORY)}')) AS category, count(*) FILTER (WHERE regexp_matches(s, '{_sq(lx.GENERIC)}')) AS generic, count(*) FILTER (WHERE regexp_matches(s, '{_sq(lx.SHARING)}')) AS sharing,
    count(*) FILTER (WHERE regexp_matches(s, '{_sq(lx.COLLECTION)}')) AS collection, count(*) FILTER (WHERE regexp_matches(s, '{_sq(lx.DATA_NOUN)}')) AS data_noun, count(*) FILTER (WHERE regexp_matches(s, '{_sq(lx.FIRST_PARTY)}')) AS first_party FROM s GROUP BY 1""")
def l0_lexicon_hits(spark, d):
    s = Tables(spark, d).parsed_docs.select("doc_id", F.explode("segments").alias("s"))
    hit = lambda p, n: F.count_if(F.col("s").rlike(p)).alias(n)
    return s.groupBy("doc_id").agg(hit(lx.CATEGORY, "category"), hit(lx.GENERIC, "generic"), hit(lx.SHARING, "sharing"), hit(lx.COLLECTION, "collection"), hit(lx.DATA_NOUN, "data_noun"), hit(lx.FIRST_PARTY, "first_party"))


@query(None)
def l9_clause_predicates(spark, d):
    s = spread(Tables(spark, d).parsed_docs.select("doc_id", "segments")).select("doc_id", F.explode("segments").alias("s"))
    s = s.select("doc_id", tx.positive_sharing(F.col("s")).alias("a"), tx.positive_collection(F.col("s")).alias("b"), tx.implicit_sale(F.col("s")).alias("c"), tx.third_party_collects(F.col("s")).alias("e"))
    return s.groupBy("doc_id").agg(F.count_if("a").alias("sharing"), F.count_if("b").alias("collection"), F.count_if("c").alias("sale"), F.count_if("e").alias("third_party"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{_sq(lx.SELLERS_JSON)}') THEN 'sellers_json' WHEN regexp_matches(text, '{_sq(lx.TCF_GVL)}') THEN 'tcf_gvl'
    WHEN regexp_matches(text, '{_sq(lx.VENDORS_JSON)}') THEN 'vendors_json' WHEN regexp_matches(text, '{_sq(lx.ADS_TXT)}') THEN 'ads_txt' ELSE '' END AS kind FROM documents WHERE text IS NOT NULL""")
def l10_machine_readable_kind(spark, d):
    return Tables(spark, d).documents.where("text IS NOT NULL").select("doc_id", tx.machine_readable_kind(F.col("text")).alias("kind"))


@query("""WITH s AS (SELECT doc_id, unnest(segments) AS s FROM parsed_docs), w AS (SELECT doc_id, s, regexp_extract_all(s, '[A-Za-z][\\w''&-]*', 0) AS w FROM s)
    SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(s, '[.!?]') AND len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.6 * len(w)) AS junk FROM w GROUP BY 1""")
def l12_navigation_junk(spark, d):
    s = Tables(spark, d).parsed_docs.select("doc_id", F.explode("segments").alias("s"))
    return s.groupBy("doc_id").agg(F.count_if(tx.navigation_junk(F.col("s"))).alias("junk"))


# -- entities ---------------------------------------------------------------------


@query("""WITH g AS (SELECT lower(trim(name)) AS n FROM gazetteer) SELECT DISTINCT doc_id, n AS org FROM parsed_docs JOIN g ON contains(lower(text), n)""")
def n1_gazetteer_orgs(spark, d):
    t = Tables(spark, d)
    return en.listed_orgs(t.parsed_docs, "doc_id", "text", t.gazetteer).select(F.col("id").alias("doc_id"), F.col("name").alias("org"))


@query("""WITH n AS (SELECT DISTINCT entity AS name FROM collect_edges WHERE entity <> ''), g AS (SELECT lower(trim(name)) AS n, max(coalesce(org_type, 'company')) AS t FROM gazetteer GROUP BY 1)
    SELECT name, coalesce(t, CASE WHEN len(regexp_split_to_array(lower(trim(name)), '\\s+')) >= 2 AND list_contains(['analytics', 'ads', 'pixel', 'sdk', 'api', 'connect', 'platform', 'cloud', 'network', 'beacon', 'tag', 'manager',
      'insights', 'audience', 'audiences', 'remarketing', 'metrics', 'studio', 'services'], regexp_split_to_array(lower(trim(name)), '\\s+')[-1]) THEN 'service' ELSE 'unknown' END) AS kind FROM n LEFT JOIN g ON lower(trim(name)) = g.n""")
def n2_classify_org(spark, d):
    t = Tables(spark, d)
    n = t.collect_edges.select(F.col("entity").alias("name")).where("name <> ''").distinct()
    return n.select("name", en.classify_org(F.col("name"), t.gazetteer_()).alias("kind"))


@query("""WITH x AS (SELECT DISTINCT doc_id, unnest(coalesce(named_orgs, [])) AS o FROM doc_classification), k AS (SELECT doc_id, lower(o) AS l, min(o) AS o FROM x GROUP BY 1, 2)
    SELECT doc_id, array_to_string(list(o ORDER BY l), ';') AS orgs FROM k GROUP BY 1""")
def n14_merge_orgs(spark, d):
    x = Tables(spark, d).doc_classification.select("doc_id", F.explode("named_orgs").alias("o")).groupBy("doc_id").agg(F.array_sort(F.collect_set("o")).alias("a"))
    return x.select("doc_id", F.array_join(en.merge_orgs(F.array().cast("array<string>"), F.col("a")), ";").alias("orgs"))


# -- classification -----------------------------------------------------------------


def _documents_to_classify(t: Tables) -> DataFrame:
    """Parsed pages with their tables, and what is known of them and their targets; pages aren't shuffled where that is small."""
    docs, tg = t.clean_docs(), t.clean_targets()
    u = docs.where(F.col("role").isin(*lx.FIRST_PARTY_URL_ROLES)).groupBy("target_id").agg(F.collect_set("url").alias("urls"))
    fp = tg.join(u, "target_id", "left").select("target_id", "target_type", en.first_party_tokens(F.col("urls"), F.col("name")).alias("first_party"))
    meta = materialize(docs.where("ok").select("doc_id", "target_id", "role", "url").join(fp, "target_id", "left"), "meta")
    pages = hx.with_tables(spread(t.parsed_docs.select("doc_id", "title", "text", "segments", "raw")), "raw")
    return pages.join(meta, "doc_id")


def _verdicts(t: Tables) -> DataFrame:
    """Verdicts on the pages as the interface gives them, with its stub for a model."""
    return verdicts.document_verdicts(t.parsed_docs.select("text", "segments"))


@query(None)
def s11_classify_documents(spark, d):
    t = Tables(spark, d)
    c = typology.classify_documents(_documents_to_classify(t), t.gazetteer_(), _verdicts(t))
    return c.select("target_id", "doc_id", "role", "medium", "reason", "relevant", j("facets"), "decisive", j("named_orgs"), j("category_terms"), "org_typing", "evidence")


@query(None)
def s13_classify_targets(spark, d):
    t = Tables(spark, d)
    a = typology.assemble_targets(typology.classify_documents(_documents_to_classify(t), t.gazetteer_(), _verdicts(t)))
    return a.select("target_id", typology.typology_class(F.col("facets")).alias("class"), "relevant_docs", "docs", "classified")


@query("WITH " + _CLASSIFIED + """ SELECT target_id, array_to_string(list_sort(list_distinct(flatten(list(facets)))), ';') AS class, count(*) FILTER (WHERE relevant) AS relevant_docs, count(*) AS docs, bool_or(len(facets) > 0) AS classified FROM cl GROUP BY 1""")
def s12_assemble_targets(spark, d):
    c = Tables(spark, d).classified().withColumn("decisive", F.size("facets") > 0)
    return typology.assemble_targets(c).select("target_id", typology.typology_class(F.col("facets")).alias("class"), "relevant_docs", "docs", "classified")


@query("WITH " + _CLASSIFIED + """ SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(facets, lambda f: split_part(f, ':', 1)))), ';') AS media FROM cl""")
def s9_media_of(spark, d):
    return Tables(spark, d).classified().select("doc_id", F.array_join(typology.media_of(F.col("facets")), ";").alias("media"))


@query(f"""WITH s AS (SELECT sha1(trim(coalesce(text, ''))) AS text_hash, unnest(segments) AS s FROM parsed_docs) SELECT text_hash, CAST(max(CAST(regexp_matches(s, '{_sq(lx.CATEGORY)}') AS INT)) AS INT) AS main_third FROM s WHERE s <> '' GROUP BY 1""")
def s17_document_verdicts(spark, d):
    """Verdicts of the stand-in for a model, which flags a segment that names a group of recipients."""
    return verdicts.document_verdicts(Tables(spark, d).parsed_docs.select("text", "segments"))


# -- relations ------------------------------------------------------------------------

_CASES = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(p, {chr(39)}{c}{chr(39)})' for c in cues)} THEN '{k}' END" for k, cues in lx.PURPOSE_CUES.items()
)


@query(f"""WITH x AS (SELECT DISTINCT unnest(text) AS t FROM collect_edges), y AS (SELECT t, ' ' || lower(t) || ' ' AS p FROM x WHERE t IS NOT NULL)
    SELECT t AS text, array_to_string(list_sort(list_filter([{_CASES}], lambda z: z IS NOT NULL)), ';') AS purposes FROM y""")
def r1_purposes(spark, d):
    x = Tables(spark, d).collect_edges.select(F.explode("text").alias("text")).where("text IS NOT NULL").distinct()
    return x.select("text", F.array_join(tx.purposes_of(F.col("text")), ";").alias("purposes"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE NOT regexp_matches(text, '(?i)"seller_id"\s*:|"sellers"\s*:|"vendors"\s*:')),
    r AS (SELECT doc_id, pos, lower(regexp_extract(line, '(?i)^[ \t]*([a-z0-9.-]+\.[a-z]{2,})[ \t]*,[ \t]*[^,]+,[ \t]*(DIRECT|RESELLER)\b', 1)) AS domain, lower(regexp_extract(line, '(?i)^[ \t]*[a-z0-9.-]+\.[a-z]{2,}[ \t]*,[ \t]*[^,]+,[ \t]*(DIRECT|RESELLER)\b', 1)) AS kind FROM l)
    SELECT doc_id, domain AS entity, CASE WHEN bool_or(kind = 'direct') THEN 'direct' ELSE 'reseller' END AS qualifier FROM r WHERE domain <> '' GROUP BY 1, 2""")
def r3_ads_txt_relations(spark, d):
    return ads_txt_relations(Tables(spark, d).documents.select("doc_id", F.col("text").alias("raw"))).select("doc_id", "entity", "qualifier")


@query("WITH " + _RELATIONS + """ SELECT target_id, entity, data_type, action, negative, arg_min(party, ord) AS party, array_to_string(list_sort(list_distinct(flatten(list(coalesce(purposes, []))))), ';') AS purposes,
    coalesce(arg_min(text, ord) FILTER (WHERE text <> ''), '') AS text, array_to_string(list_sort(list(DISTINCT doc_id)), ';') AS doc_ids FROM rl GROUP BY 1, 2, 3, 4, 5""")
def r14_merge_relations(spark, d):
    m = relations.merge_relations(Tables(spark, d).relations(), ["target_id"])
    return m.select("target_id", "entity", "data_type", "action", "negative", "party", j("purposes"), "text", j("doc_ids"))


# -- knowledge graphs ------------------------------------------------------------------

_GRAPH = _EDGES + """, ge AS (SELECT doc_id AS graph_id, lower(trim(entity)) AS src, lower(trim(regexp_replace(data_type, '\\s+', ' ', 'g'))) AS dst, edge_type AS etype, action, subject,
    list_sort(list_distinct(flatten(list(coalesce(purposes, []))))) AS purposes, list_sort(list_distinct(flatten(list(coalesce(text, []))))) AS text FROM ce WHERE trim(entity) <> '' AND trim(data_type) <> '' GROUP BY ALL)"""


def _graph(t: Tables) -> DataFrame:
    return graph.graph_edges(t.edges().select(F.col("doc_id").alias("graph_id"), "entity", "data_type", "edge_type", "action", "subject", "purposes", "text"))


@query("WITH " + _GRAPH.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6") + " SELECT graph_id, src, dst, etype, action, subject, array_to_string(purposes, ';') AS purposes, CAST(len(text) AS INT) AS texts FROM ge")
def q3_graph_edges(spark, d):
    return _graph(Tables(spark, d)).select("graph_id", "src", "dst", "etype", "action", "subject", F.array_join("purposes", ";").alias("purposes"), F.size("text").alias("texts"))


def _nodes(t: Tables) -> DataFrame:
    e = t.edges()
    m = e.select(F.col("doc_id").alias("graph_id"), F.col("entity").alias("name"), F.lit("ENTITY").alias("ntype"), F.lit(None).cast("string").alias("subject"), F.col("edge_id").alias("ord")).unionByName(
        e.select(F.col("doc_id").alias("graph_id"), tx.clean(F.col("data_type")).alias("name"), F.lit("DATA").alias("ntype"), "subject", F.col("edge_id").alias("ord"))
    )
    return graph.graph_nodes(m)


@query("WITH " + _EDGES + """, m AS (SELECT doc_id AS graph_id, lower(trim(entity)) AS name, 'ENTITY' AS ntype, NULL AS subject, edge_id FROM ce UNION ALL SELECT doc_id, lower(trim(regexp_replace(data_type, '\\s+', ' ', 'g'))), 'DATA', subject, edge_id FROM ce)
    SELECT graph_id, name, arg_min(ntype, edge_id) AS ntype, array_to_string(coalesce(list_sort(list(DISTINCT subject) FILTER (WHERE subject IS NOT NULL)), []), ';') AS subjects FROM m WHERE name <> '' GROUP BY 1, 2""")
def q1_graph_nodes(spark, d):
    return _nodes(Tables(spark, d)).select("graph_id", "name", "ntype", F.array_join("subjects", ";").alias("subjects"))


@query(None)
def q10_graph_json(spark, d):
    t = Tables(spark, d)
    return graph.graph_json(_nodes(t), _graph(t))


@query(None)
def g1_build_graphs(spark, d):
    """Graphs of the pages' markup; the companies are those of the gazetteer."""
    t = Tables(spark, d)
    s = annotate.document_sentences(spread(t.parsed_docs.select("doc_id", "raw")))
    nodes, edges = annotate.build_graphs(s, tuple(n for n, _ in t.gazetteer_().types))
    return edges.select("graph_id", "src", "dst", "etype", "action", "subject", j("purposes"))


# -- graph applications -------------------------------------------------------------------


# -- evaluation -----------------------------------------------------------------------------


@query("WITH " + _CLASSIFIED + """, g AS (SELECT target_id, doc_id, medium = 'prose' AS g, relevant AS p FROM cl WHERE medium IS NOT NULL), t AS (SELECT target_id, bool_and(p) AS a FROM g WHERE g GROUP BY 1),
    x AS (SELECT count(*) AS n, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND p) AS fp FROM g), y AS (SELECT count(*) AS targets, count(*) FILTER (WHERE a) AS complete FROM t)
    SELECT n, tp, fn, fp, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, targets, complete,
    round(CASE WHEN targets = 0 THEN 0 ELSE complete / targets END, 6) AS target_recall FROM x, y""")
def e1_relevance(spark, d):
    c = Tables(spark, d).classified()
    gold = c.where("medium IS NOT NULL").select("target_id", "doc_id", (F.col("medium") == "prose").cast("int").alias("gold"))
    r = evaluate.relevance(c, gold)
    return r.select("n", "tp", "fn", "fp", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "targets", "complete", F.round("target_recall", 6).alias("target_recall"))


@query("WITH " + _CLASSIFIED + ", t AS (SELECT target_id, bool_or(len(facets) > 0) AS c FROM cl GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE c) AS classified, round(count(*) FILTER (WHERE c) / count(*), 6) AS coverage FROM t")
def e2_coverage(spark, d):
    t = typology.assemble_targets(Tables(spark, d).classified().withColumn("decisive", F.size("facets") > 0))
    return evaluate.coverage(t).select("n", "classified", F.round("coverage", 6).alias("coverage"))


@query("WITH " + _CLASSIFIED + """, g AS (SELECT target_id, list_sort(list_distinct(flatten(list(facets)))) AS g FROM cl WHERE medium = 'prose' GROUP BY 1), p AS (SELECT target_id, list_sort(list_distinct(flatten(list(facets)))) AS p FROM cl GROUP BY 1),
    x AS (SELECT g, p, len(list_intersect(g, p)) AS i, len(list_distinct(list_concat(g, p))) AS u FROM g JOIN p USING (target_id))
    SELECT count(*) AS n, count(*) FILTER (WHERE g = p) AS exact, round(count(*) FILTER (WHERE g = p) / count(*), 6) AS exact_share, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u END), 6) AS mean_jaccard FROM x""")
def e3_agreement(spark, d):
    c = Tables(spark, d).classified()
    gold = c.where("medium = 'prose'").groupBy("target_id").agg(F.array_distinct(F.flatten(F.collect_set("facets"))).alias("facets"))
    a = evaluate.agreement(c, gold)
    return a.select("n", "exact", F.round("exact_share", 6).alias("exact_share"), F.round("mean_jaccard", 6).alias("mean_jaccard"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(max(value) FILTER (WHERE k = least(n - 1, floor(0.95 * n))), 6) AS p95, round(avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END), 6) AS under FROM r GROUP BY 1""")
def e5_latency(spark, d):
    r = evaluate.latency(Tables(spark, d).events, "value", ["event_type"])
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("max", "mean", "p95", "under")])


@query("WITH " + _CLASSIFIED + ", " + _TARGETS + """ SELECT CASE WHEN target_type IN ('play_store_app', 'app_store_app') THEN 'app' ELSE 'website' END AS grp, count(*) AS n, count(*) FILTER (WHERE len(named_orgs) > 0) AS naming,
    round(count(*) FILTER (WHERE len(named_orgs) > 0) / count(*), 6) AS rate FROM cl JOIN tg USING (target_id) GROUP BY 1""")
def e6_naming_rate(spark, d):
    t = Tables(spark, d)
    return evaluate.naming_rate(t.classified().join(t.clean_targets().select("target_id", "target_type"), "target_id")).select("grp", "n", "naming", F.round("rate", 6).alias("rate"))


def _identified(roles: str) -> str:
    return "WITH " + _TARGETS + ", " + _DOCS + f""", h AS (SELECT DISTINCT target_id FROM dc WHERE ok AND role IN ({roles}))
    SELECT CASE WHEN target_type IN ('play_store_app', 'app_store_app') THEN 'app' ELSE 'website' END AS grp, count(*) AS present, count(h.target_id) AS identified, round(count(h.target_id) / count(*), 6) AS rate
    FROM tg LEFT JOIN h USING (target_id) WHERE seed_policy_url IS NOT NULL GROUP BY 1"""


@query(_identified("'privacy_policy'"))
def e7_policy_identification(spark, d):
    t = Tables(spark, d)
    tg = t.clean_targets()
    gold = tg.select("target_id", F.col("seed_policy_url").isNotNull().alias("present"))
    return evaluate.policy_identification(tg, t.clean_docs(), gold).select("grp", "present", "identified", F.round("rate", 6).alias("rate"))


@query(_identified("'vendor_list', 'subprocessor_list', 'ads_txt', 'app_ads_txt', 'sellers_json', 'vendors_json', 'tcf_gvl'"))
def e8_list_identification(spark, d):
    t = Tables(spark, d)
    tg = t.clean_targets()
    gold = tg.select("target_id", F.col("seed_policy_url").isNotNull().alias("present"))
    return evaluate.list_identification(tg, t.clean_docs(), gold).select("grp", "present", "identified", F.round("rate", 6).alias("rate"))


@query("WITH " + _RELATIONS + """, n AS (SELECT DISTINCT data_type AS name FROM rl WHERE data_type <> ''), k AS (SELECT DISTINCT lower(label) AS name FROM ccpa_data_ontology)
    SELECT count(*) AS n, count(k.name) AS known, round(count(k.name) / count(*), 6) AS share, count(*) - count(k.name) AS missing FROM n LEFT JOIN k USING (name)""")
def e10_ontology_accommodation(spark, d):
    t = Tables(spark, d)
    a = evaluate.ontology_accommodation(t.relations(), t.ccpa_data_ontology.select(F.col("label").alias("name")).where("name IS NOT NULL"))
    return a.select("n", "known", F.round("share", 6).alias("share"), "missing")


@query("WITH " + _RELATIONS + """, g AS (SELECT target_id, entity, data_type, max(negative) AS neg FROM rl GROUP BY 1, 2, 3) SELECT count(*) AS n, count(*) FILTER (WHERE neg) AS wrong, count(*) >= 30 AND count(*) FILTER (WHERE neg) = 0 AS passed FROM g""")
def e11_propagation(spark, d):
    g = Tables(spark, d).relations().groupBy("target_id", "entity", "data_type").agg((~F.max("negative")).alias("correct"))
    return evaluate.propagation(g)


# -- label sheets ---------------------------------------------------------------------------


@query("WITH " + _CLASSIFIED + """, t AS (SELECT DISTINCT target_id FROM cl) SELECT target_id, CAST(row_number() OVER (ORDER BY substr(sha1('1234|' || target_id), 1, 12), target_id) AS INT) AS label_order FROM t WHERE target_id IS NOT NULL""")
def b1_shuffled_targets(spark, d):
    return labels.shuffled_targets(Tables(spark, d).classified())


@query("WITH " + _CLASSIFIED + ", " + _TARGETS + """, o AS (SELECT target_id, row_number() OVER (ORDER BY substr(sha1('1234|' || target_id), 1, 12), target_id) AS k FROM (SELECT DISTINCT target_id FROM cl))
    SELECT CAST(k AS VARCHAR) AS label_order, target_id, coalesce(tg.target_type, '') AS target_type, doc_id, coalesce(role, '') AS role, coalesce(cl.url, '') AS url, coalesce(medium, '') AS predicted_medium, CAST(CAST(relevant AS INT) AS VARCHAR) AS predicted_relevant,
    substr(coalesce(evidence, ''), 1, 200) AS predicted_evidence, '' AS gold_relevant, '' AS notes FROM cl JOIN o USING (target_id) LEFT JOIN tg USING (target_id)""")
def b4_relevance_sheet(spark, d):
    t = Tables(spark, d)
    return labels.relevance_sheet(t.classified().join(t.clean_targets().select("target_id", "target_type"), "target_id", "left"))


@query("WITH " + _RELATIONS + " SELECT target_id, entity, arg_min(data_type, ord) AS data_type FROM rl WHERE NOT negative AND data_type <> '' GROUP BY 1, 2")
def b6_data_type_clauses(spark, d):
    return labels.data_type_clauses(Tables(spark, d).relations())


@query("WITH " + _CLASSIFIED + """, x AS (SELECT target_id, unnest(CASE WHEN len(facets) = 0 THEN ['none'] ELSE facets END) AS f FROM cl) SELECT target_id, array_to_string(coalesce(list_sort(list(DISTINCT f) FILTER (WHERE f <> 'none')), []), ';') AS facets FROM x GROUP BY 1""")
def b9_typology_gold(spark, d):
    s = Tables(spark, d).classified().select("target_id", "doc_id", F.when(F.size("facets") == 0, "none").otherwise(F.array_join("facets", "; ")).alias("gold_facets"))
    return labels.typology_gold(s).select("target_id", F.array_join("facets", ";").alias("facets"))


# -- read models ------------------------------------------------------------------------------


@query("WITH " + _CLASSIFIED + """, t AS (SELECT target_id, unnest(list_sort(list_distinct(flatten(list(facets))))) AS f FROM cl GROUP BY 1)
    SELECT 'medium' AS kind, split_part(f, ':', 1) AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'facet', f, count(*) FROM t GROUP BY 2""")
def c37_facet_distribution(spark, d):
    t = typology.assemble_targets(Tables(spark, d).classified().withColumn("decisive", F.lit(True)))
    return report.facet_distribution(t)


@query("WITH " + _CLASSIFIED + """, t AS (SELECT target_id, list_sort(list_distinct(flatten(list(facets)))) AS f FROM cl GROUP BY 1)
    SELECT CASE WHEN len(f) = 0 THEN '(none)' ELSE array_to_string(f, ';') END AS class, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, class LIMIT 8""")
def c37_top_classes(spark, d):
    return report.top_classes(typology.assemble_targets(Tables(spark, d).classified().withColumn("decisive", F.lit(True))))


@query("WITH " + _CLASSIFIED + """, t AS (SELECT target_id, list_distinct(flatten(list(facets))) AS f FROM cl GROUP BY 1), m(medium) AS (VALUES ('prose'), ('structured'), ('machine_readable'), ('other_doc')), s(specificity) AS (VALUES ('named'), ('category'), ('generic'))
    SELECT target_id, medium, specificity, list_contains(f, medium || ':' || specificity) AS present FROM t, m, s""")
def u5_facet_grid(spark, d):
    return report.facet_grid(typology.assemble_targets(Tables(spark, d).classified().withColumn("decisive", F.lit(True))))


@query("WITH " + _RELATIONS + """, a AS (SELECT target_id, entity, count(*) AS relations, array_to_string(list_sort(list_distinct(flatten(list(coalesce(purposes, []))))), ';') AS purposes FROM rl WHERE party = 'third' GROUP BY 1, 2),
    f AS (SELECT target_id, count(*) AS n FROM rl WHERE party = 'first' GROUP BY 1) SELECT a.target_id, entity, relations, purposes, coalesce(f.n, 0) AS first_party FROM a LEFT JOIN f USING (target_id)""")
def u6_relations_view(spark, d):
    return report.relations_view(Tables(spark, d).relations()).select("target_id", "entity", "relations", F.array_join("purposes", ";").alias("purposes"), "first_party")


@query("WITH " + _RELATIONS + """, e AS (SELECT target_id, entity, count(*) AS c FROM rl GROUP BY 1, 2), eb AS (SELECT target_id, entity, CASE WHEN row_number() OVER (PARTITION BY target_id ORDER BY c DESC, entity) <= 8 THEN entity
      ELSE '+' || CAST(count(*) OVER (PARTITION BY target_id) - 8 AS VARCHAR) || ' more' END AS b FROM e),
    t AS (SELECT target_id, data_type, count(*) AS c FROM rl GROUP BY 1, 2), tb AS (SELECT target_id, data_type, CASE WHEN row_number() OVER (PARTITION BY target_id ORDER BY c DESC, data_type) <= 8 THEN data_type
      ELSE '+' || CAST(count(*) OVER (PARTITION BY target_id) - 8 AS VARCHAR) || ' more' END AS b FROM t)
    SELECT DISTINCT rl.target_id, tb.b AS data_type, eb.b AS entity, action, negative FROM rl JOIN eb USING (target_id, entity) JOIN tb USING (target_id, data_type)""")
def u7_graph_model(spark, d):
    return report.graph_model(Tables(spark, d).relations())


@query("WITH " + _CLASSIFIED + " SELECT target_id, doc_id, role, url, medium, array_to_string(facets, ';') AS facets FROM cl WHERE medium IS NOT NULL")
def u8_documents_with_medium(spark, d):
    return report.documents_with_medium(Tables(spark, d).classified())


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")
def t1_grouping_sets(spark, d):
    o = Tables(spark, d).orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return o.groupingSets([["status", "priority"], ["status"], []], "status", "priority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
