"""Registered queries of sources, collection, classification steps, relations and graphs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions import entities as en
from tessella.functions import text as tx
from tessella.functions import urls
from tessella.functions.registry import relation
from tessella.operators import collect, graph, recognise, relations, tables, typology
from tessella.operators.scratch import materialize, scratch_root, work_partitions
from tessella.plans.queries import _CASES, _DOCS, _EDGES, _GRAPH, _ONTO, _TARGETS, Tables, _graph, _nodes, _sq, j, query
from tessella.sources import corpus, fetch

_NONE = "array<string>"
_GE = _GRAPH.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6")


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _quoted(words) -> str:
    return ", ".join(f"'{_sq(w)}'" for w in words)


# -- sources: what is written is read back -------------------------------------------


@query("""WITH s AS (SELECT nullif(trim(target_type), '') AS ty, nullif(trim(name), '') AS n, nullif(trim(url), '') AS u, nullif(trim(app_id), '') AS a, nullif(trim(seed_policy_url), '') AS p FROM targets)
    SELECT ty || '__' || substr(regexp_replace(regexp_replace(lower(coalesce(n, u, a, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS target_id, ty AS target_type, n AS name, u AS url, a AS app_id, p AS seed_policy_url FROM s""")
def c2_load_seed_dir(spark, d):
    """All CSV files of a folder of seeds, in order of their names and rows."""
    t, path = Tables(spark, d).targets, _folder(spark, "seeds")
    t.select(F.col("target_type").alias("type"), "name", "url", "app_id", "seed_policy_url").write.csv(path, **corpus.CSV)
    return corpus.load_seeds(spark, path)


@query("WITH " + _DOCS + " SELECT DISTINCT target_id FROM dc WHERE target_id <> '_cache'")
def c4_list_targets(spark, d):
    return corpus.list_targets(Tables(spark, d).clean_docs())


@query("WITH " + _DOCS + ", " + _TARGETS + " SELECT tg.target_id, tg.name, dc.doc_id, dc.role, dc.http_status, dc.url FROM dc JOIN tg USING (target_id)")
def c6_manifests(spark, d):
    """Manifests of all targets, written and read back."""
    t, path = Tables(spark, d), _folder(spark, "manifests")
    corpus.write_manifests(t.clean_targets(), t.clean_docs(), path)
    tg, docs = corpus.read_manifest_lines(spark, path)
    return docs.join(tg.select("target_id", "name"), "target_id").select("target_id", "name", "doc_id", "role", "http_status", "url")


@query("SELECT doc_id, length(raw) AS chars, sha1(raw) AS content FROM parsed_docs WHERE raw IS NOT NULL")
def c7_saved_bodies(spark, d):
    t, path = Tables(spark, d), _folder(spark, "bodies")
    corpus.save_bodies(t.parsed_docs.where("raw IS NOT NULL").select(F.lit("t").alias("target_id"), "doc_id", "raw"), path)
    return spark.read.parquet(path).select("doc_id", F.length("raw").alias("chars"), F.sha1("raw").alias("content"))


@query("WITH " + _DOCS + """, c AS (SELECT url, min(http_status) AS status FROM dc WHERE http_status IS NOT NULL AND length(url) % 4 <> 0 GROUP BY 1)
    SELECT DISTINCT dc.url, coalesce(c.status, 0) AS status, CASE WHEN c.status IS NULL THEN 'not cached' ELSE '' END AS error, sha1(dc.url) AS cache_key FROM dc LEFT JOIN c USING (url) WHERE dc.url IS NOT NULL""")
def c9_fetch_from_cache(spark, d):
    x = Tables(spark, d).clean_docs().where("url IS NOT NULL")
    cache = x.where("http_status IS NOT NULL AND length(url) % 4 <> 0").groupBy("url").agg(F.min("http_status").alias("status"))
    empty = F.lit(None).cast("string")
    cache = cache.select("url", "status", empty.alias("content_type"), empty.alias("text"), F.lit("").alias("error"), empty.alias("final_url"))
    return fetch.from_cache(x, cache).select("url", "status", "error", fetch.cache_key(F.col("url")).alias("cache_key"))


@query("WITH " + _DOCS + """, c AS (SELECT DISTINCT url FROM dc WHERE http_status IS NOT NULL AND http_status NOT IN (0, 429, 500, 502, 503, 504)) SELECT DISTINCT url FROM dc WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM c WHERE url IS NOT NULL)""")
def c9_requests_to_make(spark, d):
    x = Tables(spark, d).clean_docs()
    return fetch.missing(x.where("url IS NOT NULL"), x.where("http_status IS NOT NULL").select("url", F.col("http_status").alias("status")))


@query("WITH " + _DOCS + """, o AS (SELECT p.doc_id, dc.url AS base, list_filter(links, lambda x: contains(lower(concat_ws(' ', x.text, x.href)), 'privacy') AND regexp_matches(CASE WHEN x.href LIKE '/%' THEN dc.url ELSE x.href END, '^https?://')) AS l
      FROM parsed_docs p JOIN dc USING (doc_id))
    SELECT doc_id, CASE WHEN l[1].href LIKE '/%' THEN regexp_extract(base, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) || l[1].href ELSE l[1].href END AS policy_url FROM o""")
def c18_extract_policy_url(spark, d):
    t = Tables(spark, d)
    x = t.parsed_docs.select("doc_id", "links").join(t.clean_docs().select("doc_id", "url"), "doc_id")
    return x.select("doc_id", collect.extract_policy_url(F.col("links"), F.col("url"), lx.STORE_HOSTS).alias("policy_url"))


_ROLE_LIST = ", ".join(f"('{r}', {i}, '{_sq(p)}')" for i, (r, p) in enumerate(lx.LINK_ROLES))
_HOST = "lower(regexp_extract(%s, '^[a-z]+://([^/?#:]*)', 1))"
_SITE = "array_to_string(list_slice(string_split(%s, '.'), -2, -1), '.')"
_TWO = f"(CASE WHEN len(string_split({_HOST}, '.')) < 3 THEN {_HOST} ELSE {_SITE % _HOST} END)"
_REGISTRIES = """CASE WHEN target_type IN ('play_store_app', 'app_store_app') THEN [{'role': 'app_ads_txt', 'path': '/app-ads.txt'}, {'role': 'sellers_json', 'path': '/sellers.json'}, {'role': 'vendors_json', 'path': '/vendors.json'}]
      ELSE [{'role': 'ads_txt', 'path': '/ads.txt'}, {'role': 'sellers_json', 'path': '/sellers.json'}, {'role': 'vendors_json', 'path': '/vendors.json'}] END"""


@query(f"WITH {_TARGETS}, {_DOCS}, roles(role, rank, pat) AS (VALUES {_ROLE_LIST})" + f""",
    st AS (SELECT DISTINCT target_id, role, url FROM (SELECT target_id, 'privacy_policy' AS role, seed_policy_url AS url FROM tg UNION ALL SELECT target_id, CASE WHEN target_type IN ('play_store_app', 'app_store_app') THEN 'store_listing' ELSE 'home' END,
      coalesce(CASE target_type WHEN 'play_store_app' THEN 'https://play.google.com/store/apps/details?id=' || app_id WHEN 'app_store_app' THEN 'https://apps.apple.com/app/id' || app_id END, url) FROM tg) WHERE url <> ''),
    rs AS (SELECT dc.url, min(coalesce(dc.http_status, 0)) AS status FROM dc WHERE dc.url IS NOT NULL GROUP BY 1), lk AS (SELECT dc.url, p.links FROM dc JOIN parsed_docs p USING (doc_id)),
    l AS (SELECT st.target_id, st.url AS base, unnest(lk.links) AS x FROM st JOIN rs USING (url) JOIN lk USING (url) WHERE rs.status = 200),
    fl AS (SELECT target_id, base, roles.role, regexp_extract(base, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) || x.href AS url FROM l JOIN roles ON regexp_matches(concat_ws(' ', x.text, x.href), roles.pat) WHERE x.href LIKE '/%'),
    c AS (SELECT target_id, 0 AS rank, seed_policy_url AS url FROM tg UNION ALL SELECT target_id, 1, url FROM tg),
    rt AS (SELECT target_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS root FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rank, url) AS r FROM c
      WHERE coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') NOT IN ('', {_quoted(lx.STORE_HOSTS)})) WHERE r = 1),
    rg AS (SELECT target_id, unnest({_REGISTRIES}) AS w FROM tg),
    w AS (SELECT target_id, url, role, 0 AS rank FROM st UNION ALL SELECT target_id, url, role, 1 FROM fl WHERE {_TWO.replace('%s', 'url')} = {_TWO.replace('%s', 'base')} UNION ALL SELECT target_id, root || w.path, w.role, 2 FROM rg JOIN rt USING (target_id)),
    o AS (SELECT target_id, url, arg_min(role, (rank, role)) AS role FROM w GROUP BY 1, 2)
    SELECT o.*, CAST(coalesce(status, 0) AS INT) AS http_status, CASE WHEN status IS NULL THEN 'no response' WHEN status = 200 THEN '' ELSE 'status ' || status END AS error FROM o LEFT JOIN rs USING (url)""")
def c13_collect_targets(spark, d):
    """The stored documents stand for the network."""
    t = Tables(spark, d)
    x = t.clean_docs().where("url IS NOT NULL").select("doc_id", "url", F.coalesce("http_status", F.lit(0)).alias("status"))
    return collect.collect_targets(t.clean_targets(), x.join(t.parsed_docs.select("doc_id", "links"), "doc_id", "left"))


_BACKFILL = ", ".join(f"('{r}', {i + 1})" for i, r in enumerate(lx.BACKFILL_ROLES))
_COMPANIONS = ", ".join(f"('{r}', '{p}')" for r, p in lx.COMPANION_PATHS)


@query(f"WITH {_TARGETS}, {_DOCS}, roles(role, rank, pat) AS (VALUES {_ROLE_LIST}), bf(role, p) AS (VALUES {_BACKFILL}), cp(role, path) AS (VALUES {_COMPANIONS})" + f""",
    l AS (SELECT dc.target_id, regexp_extract(dc.url, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) AS org, unnest(links) AS x FROM parsed_docs p JOIN dc USING (doc_id)),
    fl AS (SELECT target_id, org || x.href AS url, roles.role, 0 AS rank FROM l JOIN roles ON regexp_matches(concat_ws(' ', x.text, x.href), roles.pat) WHERE x.href LIKE '/%'),
    c AS (SELECT target_id, 0 AS rank, seed_policy_url AS url FROM tg UNION ALL SELECT target_id, 1, url FROM tg UNION ALL SELECT target_id, CASE WHEN role = 'privacy_policy' THEN 2 ELSE 3 END, url FROM dc),
    rt AS (SELECT target_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS root FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY rank, url) AS r FROM c
      WHERE coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') NOT IN ('', {_quoted(lx.STORE_HOSTS)})) WHERE r = 1),
    a AS (SELECT target_id, role, url, rank FROM fl UNION ALL SELECT target_id, cp.role, root || path, 1 FROM rt, cp)
    SELECT a.target_id, a.url, arg_min(a.role, (rank, bf.p)) AS role, min(rank) AS rank FROM a JOIN bf USING (role) JOIN tg USING (target_id) WHERE tg.target_type IN ('website', 'data_broker')
      AND NOT EXISTS (SELECT 1 FROM dc WHERE dc.target_id = a.target_id AND dc.role = a.role) AND NOT EXISTS (SELECT 1 FROM dc WHERE dc.target_id = a.target_id AND dc.url = a.url) GROUP BY 1, 2""")
def c23_companion_candidates(spark, d):
    t = Tables(spark, d)
    docs = t.clean_docs()
    pages = t.parsed_docs.select("doc_id", "links").join(docs.select("doc_id", "url"), "doc_id")
    links = collect.discovered_links(pages).join(docs.select("doc_id", "target_id"), "doc_id")
    return collect.companion_candidates(t.clean_targets(), docs, links)


@query("WITH " + _DOCS + " SELECT target_id, arg_min(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), doc_id) AS host FROM dc WHERE role = 'privacy_policy' GROUP BY 1")
def c27_policy_hosts(spark, d):
    return collect.policy_hosts(Tables(spark, d).clean_docs())


@query("WITH " + _DOCS + f""" SELECT p.doc_id, CASE WHEN role IN ({_quoted(lx.SCRIPTED_ROLES)}) AND length(raw) % 2 = 0 THEN length(raw) + 2000 ELSE length(raw) END AS chars FROM parsed_docs p JOIN dc USING (doc_id) WHERE raw IS NOT NULL""")
def c34_rendered(spark, d):
    t = Tables(spark, d)
    old = t.parsed_docs.where("raw IS NOT NULL").select("doc_id", "raw").join(t.clean_docs().select("doc_id", "role"), "doc_id")
    more = F.when(F.length("raw") % 2 == 0, 2000).otherwise(1999)
    return collect.rendered(old, old.select("doc_id", F.concat("raw", F.repeat(F.lit("x"), more)).alias("raw"))).select("doc_id", F.length("raw").alias("chars"))


# -- registries and labels -------------------------------------------------------------

_KIND = f"""CASE WHEN regexp_matches(text, '{_sq(lx.SELLERS_JSON)}') THEN 'sellers_json' WHEN regexp_matches(text, '{_sq(lx.TCF_GVL)}') THEN 'tcf_gvl'
    WHEN regexp_matches(text, '{_sq(lx.VENDORS_JSON)}') THEN 'vendors_json' WHEN regexp_matches(text, '{_sq(lx.ADS_TXT)}') THEN 'ads_txt' ELSE '' END"""
_NAMES = f"""k AS (SELECT doc_id, text, {_KIND} AS kind FROM documents WHERE text IS NOT NULL),
    nm AS (SELECT doc_id, kind, CASE kind WHEN 'ads_txt' THEN list_transform(regexp_extract_all(text, '{_sq(lx.ADS_TXT_ROW)}', 1), lambda x: lower(x))
      WHEN 'sellers_json' THEN list_concat(list_transform(regexp_extract_all(text, '(?i)"domain"\\s*:\\s*"([^"]+)"', 1), lambda x: lower(x)), regexp_extract_all(text, '(?i)"name"\\s*:\\s*"([^"]+)"', 1))
      ELSE regexp_extract_all(text, '(?i)"name"\\s*:\\s*"([^"]+)"', 1) END AS a FROM k WHERE kind <> ''),
    nx AS (SELECT doc_id, kind, trim(unnest(a)) AS x, generate_subscripts(a, 1) AS pos FROM nm),
    ny AS (SELECT doc_id, kind, arg_min(x, pos) AS x, min(pos) AS pos FROM nx WHERE x <> '' AND lower(x) NOT IN ({_quoted(lx.REGISTRY_NOT_NAMES)}) GROUP BY 1, 2, lower(x))"""


@query(f"WITH {_NAMES} SELECT nm.doc_id, nm.kind, coalesce(string_agg(x, ';' ORDER BY pos), '') AS names FROM nm LEFT JOIN ny USING (doc_id, kind) GROUP BY 1, 2")
def l11_registry_names(spark, d):
    from tessella.functions.registry import registry_names

    x = Tables(spark, d).documents.where("text IS NOT NULL").withColumn("kind", tx.machine_readable_kind(F.col("text"))).where("kind <> ''")
    return x.select("doc_id", "kind", F.array_join(registry_names(F.col("text"), F.col("kind")), ";").alias("names"))


# RE2 has no look-behind: what it must not follow is taken out first
_MAY = r"(?i)\bthis app may share|\bdata shared\b|\bshares? (?:these |some )?(?:user )?data (?:types )?with"
_LABEL = f"""(regexp_matches(regexp_replace(text, '(?i)no data shared|doesn''t shares? (these |some )?(user )?data', '', 'g'), '{_sq(_MAY)}'))"""
_LABELS = f"""lb AS (SELECT doc_id, coalesce(role, '') AS role, coalesce(text, '') AS text FROM documents),
    lc AS (SELECT doc_id, role, text, role = 'play_data_safety' OR regexp_matches(text, '(?i)\\bdata safety\\b') AS play, regexp_matches(text, '(?i)\\bapp privacy\\b') AS apple,
      NOT regexp_matches(text, '{_sq(lx.NOTHING_SHARED)}') OR {_LABEL} AS yes, regexp_matches(text, '{_sq(lx.TRACKS)}') AS tracks FROM lb)"""


@query(f"WITH {_LABELS} SELECT doc_id, play OR apple AS has_label, CASE WHEN play THEN yes WHEN apple THEN tracks ELSE false END AS shares, CASE WHEN play THEN 'play_data_safety' WHEN apple THEN 'app_privacy' ELSE '' END AS kind FROM lc")
def l14_platform_label(spark, d):
    x = Tables(spark, d).documents
    return x.select("doc_id", tx.platform_label(F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))).alias("l")).select("doc_id", "l.has_label", "l.shares", "l.kind")


_WHOLE = lambda p: "^" + p.replace("(?i)", "(?:") + ")$"


_CLEANED = f"""ca AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(name, '\\s+', ' ', 'g')), '^[\\s\\p{{P}}\\p{{S}}]+', ''), '(?i)^(?:the|a|an|our|your|their|its|this|these|such)\\s+', ''), '[\\s.,;:]+$', '') AS s FROM n),
    cw AS (SELECT name, s, lower(s) AS low, regexp_split_to_array(lower(s), '\\s+') AS w, lower(s) IN (SELECT g FROM g) AS listed FROM ca),
    cn AS (SELECT name, CASE WHEN listed THEN s WHEN s = '' OR low IN ({_quoted(lx.LEGAL_TERMS)}) OR len(list_filter(w, lambda x: x NOT IN ({_quoted(lx.DEFINED_TERMS)}))) = 0 OR NOT regexp_matches(s, '[A-Z]') OR regexp_matches(s, '^[A-Z]{{2,5}}$')
      OR (len(w) >= 4 AND NOT regexp_matches(s, '{_sq(lx.CORPORATE_SUFFIX)}')) OR regexp_matches(low, '{_sq(_WHOLE(lx.CATEGORY))}') OR regexp_matches(low, '{_sq(_WHOLE(lx.GENERIC))}')
      OR regexp_matches(low, '(?:authority|commission|regulation|directive|shield|act)$') THEN NULL ELSE s END AS cleaned FROM cw)"""
_LISTED_NAMES = "g AS (SELECT DISTINCT lower(trim(name)) AS g FROM gazetteer)"


@query(f"WITH n AS (SELECT DISTINCT entity AS name FROM collect_edges WHERE entity <> '' UNION SELECT DISTINCT data_type FROM collect_edges WHERE data_type <> ''), {_LISTED_NAMES}, {_CLEANED} SELECT name, cleaned FROM cn")
def n3_clean_org(spark, d):
    t = Tables(spark, d)
    n = t.collect_edges.select(F.explode(F.array("entity", "data_type")).alias("name")).where("name <> ''").distinct()
    return n.select("name", en.clean_org(F.col("name"), t.gazetteer_()).alias("cleaned"))


@query(rf"""WITH s AS (SELECT DISTINCT unnest(segments) AS s FROM parsed_docs), x AS (SELECT s, unnest(regexp_extract_all(s, '{_sq(recognise.COMPANY)}')) AS n FROM s) SELECT s AS text, array_to_string(list_sort(list(DISTINCT n)), ';') AS names FROM x GROUP BY 1""")
def n18_recognised_names(spark, d):
    """Names that the stand-in for a recogniser finds in the distinct segments."""
    s = Tables(spark, d).parsed_docs.select(F.explode("segments").alias("text"))
    return recognise.recognised_names(s).where("size(names) > 0").select("text", F.array_join("names", ";").alias("names"))


@query("SELECT doc_id, CASE WHEN role IN ('ads_txt', 'app_ads_txt', 'sellers_json', 'vendors_json', 'tcf_gvl') THEN least(length(text), 200000) WHEN role IN ('store_listing', 'play_data_safety', 'app_privacy') THEN least(length(text), 3000000) ELSE least(length(text), 800000) END AS brief, length(text) AS whole FROM documents WHERE text IS NOT NULL")
def s15_characters_read(spark, d):
    x, role = Tables(spark, d).documents.where("text IS NOT NULL"), F.coalesce("role", F.lit(""))
    read = lambda limits: F.length(typology.read_chars(F.col("text"), role, limits))
    return x.select("doc_id", read(typology.BRIEF).alias("brief"), read(typology.WHOLE).alias("whole"))


@query(f"""WITH x AS (SELECT doc_id, min(coalesce(evidence, '')) AS evidence, any_value(coalesce(named_orgs, [])) AS orgs FROM doc_classification GROUP BY 1), n AS (SELECT DISTINCT unnest(orgs) AS name FROM x), {_LISTED_NAMES}, {_CLEANED},
    gt AS (SELECT lower(trim(name)) AS g, max(coalesce(org_type, 'company')) AS t FROM gazetteer GROUP BY 1), f AS (SELECT doc_id, g AS o FROM x JOIN g ON contains(lower(evidence), g)),
    r AS (SELECT DISTINCT doc_id, cleaned AS o FROM (SELECT doc_id, unnest(orgs) AS name FROM x) u JOIN cn USING (name) WHERE cleaned IS NOT NULL), a AS (SELECT * FROM f UNION SELECT * FROM r WHERE (doc_id, lower(o)) NOT IN (SELECT doc_id, o FROM f)),
    k AS (SELECT doc_id, o, coalesce(t, CASE WHEN len(regexp_split_to_array(lower(trim(o)), '\\s+')) >= 2 AND regexp_split_to_array(lower(trim(o)), '\\s+')[-1] IN ({_quoted(lx.SERVICE_TAILS)}) THEN 'service' ELSE 'unknown' END) AS kind FROM a LEFT JOIN gt ON gt.g = lower(trim(o))),
    t AS (SELECT doc_id, array_to_string(list_sort(list(o)), ';') AS orgs, list(DISTINCT kind) FILTER (WHERE kind <> 'unknown') AS ks FROM k GROUP BY 1)
    SELECT x.doc_id, coalesce(t.orgs, '') AS orgs, CASE WHEN t.orgs IS NULL THEN '' WHEN coalesce(len(ks), 0) = 0 THEN 'unknown' WHEN len(ks) > 1 THEN 'mixed' ELSE ks[1] END AS typing FROM x LEFT JOIN t USING (doc_id)""")
def n4_detect_orgs(spark, d):
    t = Tables(spark, d)
    x = t.doc_classification.groupBy("doc_id").agg(F.min(F.coalesce("evidence", F.lit(""))).alias("evidence"), F.first(F.coalesce("named_orgs", F.array().cast(_NONE))).alias("named_orgs"))
    o = en.detect_orgs(F.col("evidence"), t.gazetteer_(), None, F.col("named_orgs"))
    return x.select("doc_id", o.alias("o")).select("doc_id", j("o.orgs", "orgs"), "o.typing")


# -- steps of the classification ---------------------------------------------------------

_STRUCT = f"""w AS (SELECT p.doc_id, concat_ws(' ', coalesce(title, ''), coalesce(dc.url, ''), coalesce(dc.role, '')) AS w, coalesce(dc.role, '') AS role, coalesce(title, '') || chr(10) || substr(coalesce(text, ''), 1, 600) AS head, lower(coalesce(text, '')) AS low
    FROM parsed_docs p JOIN dc USING (doc_id)),
    s AS (SELECT *, regexp_matches(w, '{_sq(lx.SUBPROCESSOR_TITLE)}') AS sub_title, regexp_matches(w, '{_sq(lx.COOKIE_TITLE)}') AS cookie_titled, regexp_matches(w, '{_sq(lx.HELP_TITLE)}') OR role = 'help_doc' AS help,
      regexp_matches(w, '{_sq(lx.PARTNERS_TITLE)}') OR role = 'partners_page' AS partners, role IN ({_quoted(lx.LIST_ROLES)}) OR regexp_matches(w, '{_sq(lx.SUBPROCESSOR_TITLE)}') OR regexp_matches(head, '{_sq(lx.VENDOR_LIST_TITLE)}') AS framed FROM w)"""


@query("WITH " + _DOCS + ", " + _STRUCT + """, g AS (SELECT DISTINCT lower(trim(name)) AS g FROM gazetteer)
    SELECT doc_id, sub_title, cookie_titled, help, partners, framed, CASE WHEN framed THEN (SELECT count(*) FROM g WHERE contains(low, g)) ELSE 0 END AS n_list_orgs FROM s""")
def s2_structural_flags(spark, d):
    t = Tables(spark, d)
    x = t.parsed_docs.select("doc_id", "title", "text", "segments", F.lit("").alias("raw")).join(t.clean_docs().select("doc_id", "url", "role"), "doc_id")
    r = typology.read_documents(x.withColumn("target_type", F.lit("website")), t.gazetteer_())
    return r.select("doc_id", "sub_title", "cookie_titled", "help", "partners", "framed", F.size("list_orgs").cast("bigint").alias("n_list_orgs"))


_MEDIUM = f"""x AS (SELECT doc_id, d.target_id, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(tg.target_type, '') AS ty FROM documents d LEFT JOIN tg ON tg.target_id = d.target_id), g AS (SELECT DISTINCT lower(trim(name)) AS g FROM gazetteer),
    y AS (SELECT x.*, {_KIND} AS kind, length(text) >= 600 AND len(list_distinct(list_transform(regexp_extract_all(text, '{_sq(lx.POLICY_CUES)}'), lambda c: lower(c)))) >= 4 AS prose, regexp_matches('  ' || role, '{_sq(lx.SUBPROCESSOR_TITLE)}') AS sub_title,
      regexp_matches('  ' || role, '{_sq(lx.HELP_TITLE)}') OR role = 'help_doc' AS help, regexp_matches('  ' || role, '{_sq(lx.PARTNERS_TITLE)}') OR role = 'partners_page' AS partners,
      role IN ({_quoted(lx.LIST_ROLES)}) OR regexp_matches('  ' || role, '{_sq(lx.SUBPROCESSOR_TITLE)}') OR regexp_matches(chr(10) || substr(text, 1, 600), '{_sq(lx.VENDOR_LIST_TITLE)}') AS framed,
      regexp_matches(' ' || substr(text, 1, 3000), '{_sq(lx.PARKED)}') AS parked FROM x),
    z AS (SELECT y.*, CASE WHEN framed THEN (SELECT count(*) FROM g WHERE contains(lower(text), g)) ELSE 0 END AS n_orgs, CASE WHEN role <> '' THEN role ELSE kind END AS gate, play OR apple AS has_label, CASE WHEN play THEN yes WHEN apple THEN tracks ELSE false END AS shares FROM y JOIN (SELECT doc_id, play, apple, yes, tracks FROM lc) USING (doc_id)),
    v AS (SELECT *, CASE WHEN ty IN ({_quoted(lx.WEB_TYPES)}) THEN gate IN ({_quoted(lx.WEB_REGISTRIES)}) WHEN ty IN ({_quoted(lx.APP_TYPES)}) THEN gate IN ({_quoted(lx.APP_REGISTRIES)}) ELSE gate IN ({_quoted(lx.REGISTRY_ROLES)}) END AS allowed,
      CASE WHEN ty IN ({_quoted(lx.APP_TYPES)}) AND has_label AND shares THEN 'platform_label' WHEN framed AND n_orgs >= 5 THEN 'vendor_list' END AS why FROM z)"""


@query("WITH " + _TARGETS + ", " + _LABELS + ", " + _MEDIUM + f""" SELECT doc_id, CASE WHEN parked THEN NULL WHEN kind <> '' AND allowed THEN 'machine_readable' WHEN why IS NOT NULL THEN 'structured'
      WHEN (help OR partners) AND NOT (prose AND role IN ({_quoted(lx.POLICY_ROLES)})) THEN 'other_doc' WHEN prose THEN 'prose' END AS medium,
    CASE WHEN parked THEN 'parked_domain' WHEN kind <> '' AND allowed THEN 'registry:' || kind WHEN why IS NOT NULL THEN why WHEN (help OR partners) AND NOT (prose AND role IN ({_quoted(lx.POLICY_ROLES)})) THEN CASE WHEN help THEN 'help_doc' ELSE 'partners_page' END
      WHEN prose THEN CASE WHEN regexp_matches(' ' || role, '{_sq(lx.TERMS_TITLE)}') THEN 'policy_prose(tos_titled)' ELSE 'policy_prose' END ELSE 'unrecognised' END AS reason FROM v""")
def s6_medium(spark, d):
    """Medium of every text of the corpus; texts have neither title nor segments, so short policies stay unrecognised."""
    t = Tables(spark, d)
    x = t.documents.select("doc_id", "target_id", "role", "text").join(t.clean_targets().select("target_id", "target_type"), "target_id", "left")
    none = F.lit(None).cast("string")
    x = x.withColumns({"title": none, "url": none, "raw": F.col("text"), "segments": F.array().cast(_NONE)})
    r = typology.classify_medium(typology.structural_signals(materialize(typology.read_documents(x, t.gazetteer_()), "read")))
    return r.select("doc_id", "medium", "reason")


# -- relations from tables and registries ------------------------------------------------


def _listed(t: Tables) -> DataFrame:
    """Vendor lists of the corpus with their lines "- name: to purpose" as a table of two columns."""
    x = t.documents.where("role IN ('vendor_list', 'subprocessor_list') AND text IS NOT NULL")
    rows = F.transform(
        F.filter(F.split("text", "\n"), lambda s: s.rlike("^- [^:]+: to ")), lambda s: F.array(F.regexp_extract(s, "^- ([^:]+): to (.*)$", 1), F.regexp_extract(s, "^- ([^:]+): to (.*)$", 2))
    )
    table = F.struct(
        F.array(F.lit("vendor"), F.lit("purpose")).alias("headers"), (F.size("rows") + 1).alias("n_rows"), F.lit(2).alias("n_cols"), F.array_join(F.flatten("rows"), " • ").alias("cell_text"), F.col("rows")
    )
    return x.select("doc_id", "target_id", "role", F.col("text").alias("raw"), rows.alias("rows")).select("doc_id", "target_id", "role", "raw", F.when(F.size("rows") > 0, F.array(table)).otherwise(F.array().cast(f"array<{_TABLE}>")).alias("tables"))


_TABLE = "struct<headers:array<string>,n_rows:int,n_cols:int,cell_text:string,rows:array<array<string>>>"
_CLEAN = r"regexp_replace(regexp_replace(lower(trim(%s)), '^[\s.,;:•*()\[\]-]+', ''), '[\s.,;:•*()\[\]-]+$', '')"
_IS_CELL = rf"(%s <> '' AND length(%s) <= 60 AND regexp_matches(%s, '\p{{L}}') AND %s NOT IN ({_quoted(lx.OWN_CELLS)}))"
_LIST = rf"""li AS (SELECT doc_id, target_id, role, unnest(string_split(text, chr(10))) AS s FROM documents WHERE role IN ('vendor_list', 'subprocessor_list')),
    ce2 AS (SELECT doc_id, target_id, role, {_CLEAN % "regexp_extract(s, '^- ([^:]+): to (.*)$', 1)"} AS entity, ' ' || lower(regexp_extract(s, '^- ([^:]+): to (.*)$', 2)) || ' ' AS p FROM li WHERE regexp_matches(s, '^- [^:]+: to ')),
    cp AS (SELECT doc_id, target_id, entity, list_filter([{_CASES}], lambda z: z IS NOT NULL) AS ps, role FROM ce2 WHERE {_IS_CELL % (("entity",) * 4)}),
    tr AS (SELECT doc_id, target_id, entity, list_sort(list_distinct(flatten(list(CASE WHEN len(ps) = 0 AND role = 'subprocessor_list' THEN ['services'] ELSE ps END)))) AS purposes FROM cp GROUP BY 1, 2, 3)"""


@query(rf"""WITH n AS (SELECT DISTINCT entity AS cell FROM collect_edges WHERE entity IS NOT NULL UNION SELECT DISTINCT unnest(segments) FROM parsed_docs), c AS (SELECT cell, {_CLEAN % "cell"} AS s FROM n WHERE cell IS NOT NULL)
    SELECT cell, CASE WHEN {_IS_CELL % (("s",) * 4)} THEN s END AS entity FROM c""")
def r7_clean_cells(spark, d):
    t = Tables(spark, d)
    n = t.collect_edges.select(F.col("entity").alias("cell")).unionByName(t.parsed_docs.select(F.explode("segments").alias("cell"))).where("cell IS NOT NULL").distinct()
    return n.select("cell", tables.clean_cell(F.col("cell")).alias("entity"))


@query("WITH " + _LIST + " SELECT doc_id, entity, 'personal data' AS data_type, 'be_shared' AS action, array_to_string(purposes, ';') AS purposes, 'vendor_table' AS sources FROM tr")
def r8_table_relations(spark, d):
    return tables.table_relations(_listed(Tables(spark, d))).select("doc_id", "entity", "data_type", "action", j("purposes"), j("sources"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^- [^:]+: to '))) >= 2 AS is_list FROM documents WHERE role IN ('vendor_list', 'subprocessor_list') AND text IS NOT NULL")
def s1_subprocessor_tables(spark, d):
    x = _listed(Tables(spark, d))
    return x.select("doc_id", F.coalesce(typology.subprocessor_table(F.col("tables")), F.lit(False)).alias("is_list"))


@query("WITH " + _LIST + " SELECT doc_id, count(*) AS names FROM (SELECT DISTINCT doc_id, regexp_extract(s, '^- ([^:]+): to (.*)$', 1) AS c FROM li WHERE regexp_matches(s, '^- [^:]+: to ')) WHERE c <> '' AND NOT regexp_matches(c, '^[_.\\w-]*[_\\d][_.\\w-]*$') GROUP BY 1")
def n16_table_names(spark, d):
    x = _listed(Tables(spark, d))
    names = F.array_distinct(F.flatten(F.transform("tables", tables.name_cells)))
    return x.select("doc_id", F.size(names).cast("bigint").alias("names")).where("names > 0")


_ADS = r"""al AS (SELECT doc_id, target_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE NOT regexp_matches(text, '(?i)"seller_id"\s*:|"sellers"\s*:|"vendors"\s*:') %s),
    ar AS (SELECT doc_id, target_id, lower(regexp_extract(line, '(?i)^[ \t]*([a-z0-9.-]+\.[a-z]{2,})[ \t]*,[ \t]*[^,]+,[ \t]*(DIRECT|RESELLER)\b', 1)) AS domain, lower(regexp_extract(line, '(?i)^[ \t]*[a-z0-9.-]+\.[a-z]{2,}[ \t]*,[ \t]*[^,]+,[ \t]*(DIRECT|RESELLER)\b', 1)) AS kind FROM al),
    rg AS (SELECT doc_id, target_id, domain AS entity, 'be_sold' AS action, CASE WHEN bool_or(kind = 'direct') THEN 'direct' ELSE 'reseller' END AS qualifier, 'ads_txt' AS sources FROM ar WHERE domain <> '' GROUP BY 1, 2, 3
      UNION ALL SELECT doc_id, target_id, lower(trim(coalesce(nullif(trim(s->>'name'), ''), nullif(trim(s->>'domain'), '')))), 'be_shared', lower(coalesce(s->>'seller_type', '')), 'sellers_json'
        FROM (SELECT doc_id, target_id, unnest(CAST(json_extract(text, '$.sellers') AS JSON[])) AS s FROM documents WHERE json_valid(text) AND regexp_matches(text, '(?i)"seller_id"\s*:|"sellers"\s*:\s*\[') %s)
        WHERE coalesce(CAST(s->>'is_confidential' AS INT), 0) <> 1 AND coalesce(nullif(trim(s->>'name'), ''), nullif(trim(s->>'domain'), '')) IS NOT NULL)"""
_IN_ROLES = f"AND role IN ({_quoted(lx.REGISTRY_ROLES)})"


@query("WITH " + _ADS.replace("%s", "") + " SELECT doc_id, entity, 'advertising bid data' AS data_type, action, 'advertising' AS purposes, qualifier, sources FROM rg")
def r6_registry_relations(spark, d):
    from tessella.functions.registry import registry_relations

    r = registry_relations(Tables(spark, d).documents.select("doc_id", F.col("text").alias("raw")))
    return r.select("doc_id", "entity", "data_type", "action", j("purposes"), "qualifier", j("sources"))


def _structured(t: Tables) -> DataFrame:
    none = F.array().cast(f"array<{_TABLE}>")
    reg = t.documents.where(F.col("role").isin(*lx.REGISTRY_ROLES)).select("doc_id", "target_id", "role", F.col("text").alias("raw"), none.alias("tables"))
    return _listed(t).unionByName(reg)


@query("WITH " + _LIST + ", " + _ADS.replace("%s", _IN_ROLES) + """ SELECT doc_id, entity, 'personal data' AS data_type, 'be_shared' AS action, array_to_string(purposes, ';') AS purposes, '' AS qualifier, 'vendor_table' AS sources FROM tr
    UNION ALL SELECT doc_id, entity, 'advertising bid data', action, 'advertising', qualifier, sources FROM rg""")
def r9_structured_relations(spark, d):
    r = relations.structured_relations(_structured(Tables(spark, d)))
    return r.select("doc_id", "entity", "data_type", "action", j("purposes"), "qualifier", j("sources"))


@query("WITH " + _LIST + ", " + _ADS.replace("%s", _IN_ROLES) + """, a AS (SELECT doc_id, target_id, entity, 'personal data' AS data_type, 'be_shared' AS action, purposes, '' AS qualifier, 'vendor_table' AS sources FROM tr
      UNION ALL SELECT doc_id, target_id, entity, 'advertising bid data', action, ['advertising'], qualifier, sources FROM rg)
    SELECT target_id, entity, data_type, action, array_to_string(list_sort(list_distinct(flatten(list(purposes)))), ';') AS purposes, bool_or(qualifier = 'direct') AS direct, array_to_string(list_sort(list(DISTINCT sources)), ';') AS sources, count(DISTINCT doc_id) AS docs
    FROM a GROUP BY 1, 2, 3, 4""")
def r15_target_relations(spark, d):
    x = _structured(Tables(spark, d))
    m = relations.target_relations(relations.structured_relations(x), x.select("target_id", "doc_id"))
    return m.select("target_id", "entity", "data_type", "action", j("purposes"), (F.col("qualifier") == "direct").alias("direct"), j("sources"), F.size("doc_ids").cast("bigint").alias("docs"))


@query("WITH " + _DOCS + f""", p AS (SELECT doc_id, sha1(trim(coalesce(raw, ''))) AS h, length(raw) % 2 AS odd FROM parsed_docs JOIN dc USING (doc_id) WHERE role IN ({_quoted(lx.GRAPH_ROLES)})) SELECT doc_id, h AS content_hash FROM p WHERE coalesce(odd, 0) = 1""")
def r16_changed_documents(spark, d):
    t = Tables(spark, d)
    x = t.parsed_docs.select("doc_id", "raw").join(t.clean_docs().select("doc_id", "role"), "doc_id")
    cache = x.select("doc_id", F.when(F.coalesce(F.length("raw") % 2, F.lit(0)) == 1, "old").otherwise(tx.sha1_of_trimmed(F.coalesce("raw", F.lit("")))).alias("content_hash"))
    return relations.changed_documents(x, cache).select("doc_id", "content_hash")


_SUFFIXES = ("Act", "Framework", "Group")


@query(f"""WITH n AS (SELECT DISTINCT entity FROM collect_edges WHERE entity <> ''), x AS (SELECT entity FROM n UNION SELECT entity || ' ' || [{_quoted(_SUFFIXES)}][1 + length(entity) % 3] FROM n)
    SELECT entity FROM x WHERE regexp_split_to_array(lower(trim(entity)), '\\s+')[-1] IN ({_quoted(lx.NOT_ACTORS)})""")
def r12_not_actors(spark, d):
    n = Tables(spark, d).collect_edges.select("entity").where("entity <> ''").distinct()
    named = n.select(F.concat_ws(" ", "entity", F.get(F.array(*map(F.lit, _SUFFIXES)), F.length("entity") % 3)).alias("entity"))
    n = n.unionByName(named).distinct()
    return n.where(relations.not_an_actor(F.col("entity")))


# -- graphs with a subsumption that isn't the identity -------------------------------------

_UP = _ONTO.removeprefix("WITH ") + ", up(a, b) AS (SELECT lower(hypernym), lower(hyponym) FROM oe UNION SELECT u.a, lower(oe.hyponym) FROM up u JOIN oe ON lower(oe.hypernym) = u.b)"
_REACH = """, ends AS (SELECT graph_id, src AS name, 'ENTITY' AS ty FROM ge UNION SELECT graph_id, dst, 'DATA' FROM ge), gn AS (SELECT DISTINCT graph_id, name FROM ends),
    rc AS (SELECT graph_id, name AS a, name AS b FROM gn UNION SELECT x.graph_id, up.a, up.b FROM up JOIN gn x ON x.name = up.a JOIN gn y ON y.name = up.b AND y.graph_id = x.graph_id
      UNION SELECT graph_id, 'unspecified third party', name FROM ends WHERE ty = 'ENTITY' AND name <> 'we' AND graph_id IN (SELECT graph_id FROM ends WHERE name = 'unspecified third party'))"""


def _low(t: Tables) -> DataFrame:
    return graph.ontology_edges(t.ccpa_data_ontology).select(F.lower("hypernym").alias("hypernym"), F.lower("hyponym").alias("hyponym"))


def _bare(t: Tables) -> DataFrame:
    """Edges of the graphs without their sentences, which the applications don't read; those of a graph lie together."""
    return materialize(graph.graph_edges(_unsaid(t).repartition("graph_id")), "edges")


def _unsaid(t: Tables) -> DataFrame:
    return t.edges().select(F.col("doc_id").alias("graph_id"), "entity", "data_type", "edge_type", "action", "subject", "purposes")


def _terms(e: DataFrame) -> DataFrame:
    """``(graph_id, entities, data)``: the distinct ends of each graph's edges."""
    return e.groupBy("graph_id").agg(F.collect_set("src").alias("entities"), F.collect_set("dst").alias("data"))


def _ends(e: DataFrame) -> DataFrame:
    of = lambda c, ty: F.transform(c, lambda x: F.struct(x.alias("name"), F.lit(ty).alias("ty")))
    return _terms(e).select("graph_id", F.inline(F.concat(of("entities", "ENTITY"), of("data", "DATA"))))


def _subsumed(t: Tables, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local reach of every graph, and the ontology's closure.

    In a graph, terms subsume those below them in the ontology, and the
    unspecified third party all entities but the first.
    """
    up = graph.closure(_low(t), src="hypernym", dst="hyponym")
    return _reach(e, up), up


def _reach(e: DataFrame, up: DataFrame) -> DataFrame:
    terms = materialize(_terms(e).withColumn("names", F.array_union("entities", "data")), "terms")
    data = graph.within_graphs(terms.select("graph_id", "names", F.col("names").alias("below")), up)
    third = terms.where(F.array_contains("names", graph.UNSPECIFIED_PARTY)).select("graph_id", F.lit(graph.UNSPECIFIED_PARTY).alias("ancestor"), F.explode("entities").alias("descendant")).where(F.col("descendant") != graph.WE)
    own = terms.select("graph_id", F.explode("names").alias("ancestor")).withColumn("descendant", F.col("ancestor"))
    return materialize(data.unionByName(third).where("ancestor <> descendant").distinct().unionByName(own), "reach")


_R = "WITH RECURSIVE "


@query(_R + _GE + ", " + _UP + _REACH + """, q AS (SELECT DISTINCT e.graph_id, e.name AS entity, x.name AS data_type FROM ends e JOIN ends x USING (graph_id) WHERE e.ty = 'ENTITY' AND x.ty = 'DATA' AND e.name = 'unspecified third party' UNION SELECT graph_id, src, dst FROM ge)
    SELECT q.graph_id, q.entity, q.data_type, array_to_string(list_sort(list_distinct(flatten(list(ge.purposes)))), ';') AS purposes FROM q JOIN rc n ON n.graph_id = q.graph_id AND n.a = q.entity JOIN rc c ON c.graph_id = q.graph_id AND c.b = q.data_type
    JOIN ge ON ge.graph_id = q.graph_id AND ge.src = n.b AND ge.dst = c.a AND ge.etype = 'COLLECT' GROUP BY 1, 2, 3""")
def q6_collects(spark, d):
    t = Tables(spark, d)
    e = _bare(t)
    reach, _ = _subsumed(t, e)
    ends = _ends(e)
    some = ends.where(F.col("name") == graph.UNSPECIFIED_PARTY).where("ty = 'ENTITY'").select("graph_id", F.col("name").alias("entity"))
    q = some.join(ends.where("ty = 'DATA'").select("graph_id", F.col("name").alias("data_type")), "graph_id").unionByName(e.select("graph_id", F.col("src").alias("entity"), F.col("dst").alias("data_type"))).distinct()
    return graph.collects(q, e, reach).select("graph_id", "entity", "data_type", F.array_join("purposes", ";").alias("purposes"))


_BOTH = """SELECT DISTINCT p.graph_id, p.action, p.subject, p.src AS entity_pos, p.dst AS data_pos, n.src AS entity_neg, n.dst AS data_neg FROM ge p JOIN ge n ON p.graph_id = n.graph_id AND p.action = n.action AND p.subject IS NOT DISTINCT FROM n.subject
    WHERE p.etype = 'COLLECT' AND n.etype = 'NOT_COLLECT' AND p.subject IS NOT NULL AND (len(n.purposes) = 0 OR list_has_any(p.purposes, n.purposes))
      AND (p.src = n.src OR EXISTS (SELECT 1 FROM rc x JOIN rc y ON x.graph_id = y.graph_id AND x.b = y.b WHERE x.graph_id = p.graph_id AND x.a = p.src AND y.a = n.src))
      AND (p.dst = n.dst OR EXISTS (SELECT 1 FROM rc x JOIN rc y ON x.graph_id = y.graph_id AND x.b = y.b WHERE x.graph_id = p.graph_id AND x.a = p.dst AND y.a = n.dst) OR EXISTS (SELECT 1 FROM rf x JOIN rf y ON x.b = y.b WHERE x.a = p.dst AND y.a = n.dst))"""
_RF = ", rf AS (SELECT a, b FROM up UNION SELECT lower(label), lower(label) FROM lab)"


def _contradictions(t: Tables) -> DataFrame:
    low = materialize(_low(t), "low", free=True)
    up = graph.closure(low, src="hypernym", dst="hyponym")
    edges = graph.graph_edges(_unsaid(t).repartition(work_partitions(t.spark), "graph_id"))
    names = low.select(F.explode(F.array("hypernym", "hyponym")).alias("name")).distinct()
    c, odd = graph.contradictions_without_reach(graph.opposed(edges), names, up)
    if not odd.isEmpty():
        e = materialize(edges.join(odd, "graph_id", "left_semi"), "edges", free=True)
        c = c.unionByName(graph.contradictions(e, _reach(e, up), up).select(*c.columns))
    return c


@query(_R + _GE + ", " + _UP + _REACH + _RF + " " + _BOTH)
def a1_contradictions(spark, d):
    return _contradictions(Tables(spark, d))


@query(_R + _GE + ", " + _UP + _REACH + _RF + ", b AS (" + _BOTH + ") SELECT graph_id, string_agg(entity_pos || ' ' || action || ' ' || data_pos || ' <> not ' || entity_neg || ' ' || data_neg, chr(10) ORDER BY entity_pos || ' ' || action || ' ' || data_pos || ' <> not ' || entity_neg || ' ' || data_neg) AS report FROM b GROUP BY 1")
def a9_contradiction_report(spark, d):
    return graph.format_contradictions(_contradictions(Tables(spark, d)))


@query(_R + _GE + ", " + _UP + _REACH + """, f AS (SELECT DISTINCT graph_id, src AS entity, dst AS data_type FROM ge),
    co AS (SELECT f.*, flatten(list(ge.purposes)) AS ps FROM f JOIN rc n ON n.graph_id = f.graph_id AND n.a = f.entity JOIN rc c ON c.graph_id = f.graph_id AND c.b = f.data_type JOIN ge ON ge.graph_id = f.graph_id AND ge.src = n.b AND ge.dst = c.a AND ge.etype = 'COLLECT' GROUP BY 1, 2, 3),
    wd AS (SELECT f.graph_id, f.entity, f.data_type, up.a AS d2 FROM f JOIN up ON up.b = f.data_type WHERE up.a <> f.data_type),
    vg AS (SELECT w.graph_id, w.entity, w.data_type, w.d2, list_sort(list_distinct(flatten(list(ge.purposes)))) AS ps FROM wd w JOIN rc n ON n.graph_id = w.graph_id AND n.a = w.entity JOIN rc c ON c.graph_id = w.graph_id AND c.b = w.d2 JOIN ge ON ge.graph_id = w.graph_id AND ge.src = n.b AND ge.dst = c.a AND ge.etype = 'COLLECT' GROUP BY 1, 2, 3, 4),
    v1 AS (SELECT graph_id, entity, data_type, arg_min(ps, d2) AS ps FROM vg GROUP BY 1, 2, 3),
    r AS (SELECT f.*, CASE WHEN co.ps IS NOT NULL THEN 'clear' WHEN v1.ps IS NOT NULL THEN 'vague' ELSE 'inconsistent' END AS disclosure, list_sort(list_distinct(coalesce(co.ps, v1.ps, []))) AS ps FROM f LEFT JOIN co USING (graph_id, entity, data_type) LEFT JOIN v1 USING (graph_id, entity, data_type))
    SELECT graph_id, entity, data_type, disclosure, disclosure <> 'inconsistent' AS consistent, array_to_string(ps, ';') AS purposes,
      CASE WHEN list_has_any(ps, ['services', 'security', 'legal']) AND list_has_any(ps, ['advertising', 'analytics']) THEN 'both' WHEN list_has_any(ps, ['advertising', 'analytics']) THEN 'non-core' WHEN list_has_any(ps, ['services', 'security', 'legal']) THEN 'core' ELSE 'unknown' END AS purpose_class FROM r""")
def a5_flow_consistency(spark, d):
    """Every pair of ends of an edge, affirmed or denied, looked at as a flow that was observed."""
    t = Tables(spark, d)
    e = _bare(t)
    reach, up = _subsumed(t, e)
    flows = e.select("graph_id", F.col("src").alias("entity"), F.col("dst").alias("data_type"))
    r = graph.classify_flows(flows, _ends(e), e, reach, up)
    return r.select("graph_id", "entity", "data_type", "disclosure", "consistent", "purpose_class", F.array_join("purposes", ";").alias("purposes"))


@query(_R + _GE + ", " + _UP + _REACH + f""", dn AS (SELECT graph_id, list_sort(list(DISTINCT a || ' > ' || b)) AS m FROM rc WHERE a <> b AND a IN ({_quoted(graph.NON_PERSONAL)}) AND b NOT IN ('unspecified data', 'unspecified third party') AND b IN (SELECT lower(label) FROM lab) GROUP BY 1),
    od AS (SELECT rc.graph_id, list_sort(list(DISTINCT a)) AS o FROM rc JOIN ends ON ends.graph_id = rc.graph_id AND ends.name = rc.a AND ends.ty = 'DATA' WHERE a <> b AND a NOT IN ('unspecified data', 'unspecified third party') AND length(a) % 2 = 0 GROUP BY 1)
    SELECT g.graph_id, array_to_string(coalesce(m, []), ';') AS misleading, array_to_string(coalesce(o, []), ';') AS non_standard FROM (SELECT DISTINCT graph_id FROM ends) g LEFT JOIN dn USING (graph_id) LEFT JOIN od USING (graph_id)""")
def a7_check_terms(spark, d):
    """Against an ontology that knows only the terms of odd length, so that there is something to report."""
    t = Tables(spark, d)
    e = _bare(t)
    reach, _ = _subsumed(t, e)
    nodes = _ends(e).withColumnRenamed("ty", "ntype")
    label = t.ccpa_data_ontology.where("id IS NOT NULL").groupBy("id").agg(F.min(F.coalesce("label", "id")).alias("label")).select(F.lower("label").alias("name")).distinct()
    sub = reach.where("ancestor <> descendant").select("graph_id", F.col("ancestor").alias("src"), F.col("descendant").alias("dst"))
    r = graph.check_terms(nodes, reach, label.where("length(name) % 2 = 1"), label, sub)
    return r.select("graph_id", j("misleading"), j("non_standard"))


@query(_R + _GE + ", " + _UP + _REACH + f""", ex AS (SELECT graph_id, a AS src, array_to_string(list_sort(list(DISTINCT b))[1:5], ';') AS ex FROM rc WHERE a <> b AND (graph_id, b) IN (SELECT graph_id, name FROM ends WHERE ty = 'ENTITY') GROUP BY 1, 2)
    SELECT graph_id AS doc_id, src AS entity, CASE WHEN src = 'we' THEN 'first' ELSE 'third' END AS party, src = 'unspecified third party' AS unspecified, dst AS data_type, action, etype = 'NOT_COLLECT' AS negative, array_to_string(purposes, ';') AS purposes,
      CASE WHEN src = 'we' THEN '' ELSE coalesce(ex, '') END AS examples FROM ge LEFT JOIN ex USING (graph_id, src) WHERE regexp_split_to_array(src, '\\s+')[-1] NOT IN ({_quoted(lx.NOT_ACTORS)})""")
def r10_graph_relations(spark, d):
    t = Tables(spark, d)
    e = _bare(t)
    reach, _ = _subsumed(t, e)
    r = relations.relations_from_graph(_ends(e).withColumnRenamed("ty", "ntype"), e, reach)
    return r.select("doc_id", "entity", "party", "unspecified", "data_type", "action", "negative", F.array_join("purposes", ";").alias("purposes"), F.array_join("examples", ";").alias("examples"))


@query("SELECT DISTINCT org_type AS hypernym, name AS hyponym FROM gazetteer WHERE org_type IS NOT NULL AND name IS NOT NULL")
def o2_entity_ontology(spark, d):
    g = Tables(spark, d).gazetteer.where("org_type IS NOT NULL AND name IS NOT NULL")
    return graph.entity_ontology(g.groupBy(F.col("org_type").alias("category")).agg(F.collect_set("name").alias("members")), g)


def _direct(t: Tables, e: DataFrame) -> DataFrame:
    n = _ends(e).select("graph_id", "name").distinct()
    low = _low(t).distinct()
    sub = low.join(n.withColumnRenamed("name", "hypernym"), "hypernym").join(n.withColumnRenamed("name", "hyponym"), ["graph_id", "hyponym"])
    return sub.select("graph_id", F.col("hypernym").alias("src"), F.col("hyponym").alias("dst"), F.lit("SUBSUME").alias("etype"))


@query("WITH " + _GE + ", " + _ONTO.removeprefix("WITH ") + """, gn AS (SELECT graph_id, dst AS name FROM ge GROUP BY 1, 2)
    SELECT DISTINCT x.graph_id, lower(hypernym) AS hypernym, lower(hyponym) AS hyponym FROM oe JOIN gn x ON x.name = lower(hypernym) JOIN gn y ON y.name = lower(hyponym) AND y.graph_id = x.graph_id""")
def o3_local_ontology(spark, d):
    t = Tables(spark, d)
    e = materialize(_graph(t), "edges")
    return graph.local_ontology(_ends(e).withColumnRenamed("ty", "ntype"), _direct(t, e), "DATA").distinct()


@query("WITH " + _GE + """, t AS (SELECT graph_id, src, dst, etype FROM ge UNION ALL SELECT graph_id, dst, src, 'COLLECT' FROM ge WHERE length(src) % 3 = 0 UNION ALL SELECT graph_id, src, 'nowhere', 'SUBSUME' FROM ge WHERE length(dst) % 3 = 0 UNION ALL SELECT graph_id, dst, dst, 'SUBSUME' FROM ge WHERE length(dst) % 3 = 1),
    n AS (SELECT DISTINCT graph_id, src AS name, 'ENTITY' AS ty FROM ge), m AS (SELECT DISTINCT graph_id, dst AS name, 'DATA' AS ty FROM ge), nd AS (SELECT * FROM n UNION ALL SELECT * FROM m WHERE (graph_id, name) NOT IN (SELECT graph_id, name FROM n))
    SELECT DISTINCT t.graph_id, t.src, t.dst, t.etype, CASE WHEN a.ty IS NULL OR b.ty IS NULL THEN 'unknown end' WHEN t.etype = 'SUBSUME' AND t.src = t.dst THEN 'loop' WHEN t.etype = 'SUBSUME' AND a.ty <> b.ty THEN 'ends of two types'
      WHEN t.etype <> 'SUBSUME' AND (a.ty <> 'ENTITY' OR b.ty <> 'DATA') THEN 'not from entity to data' END AS problem FROM t LEFT JOIN nd a ON a.graph_id = t.graph_id AND a.name = t.src LEFT JOIN nd b ON b.graph_id = t.graph_id AND b.name = t.dst
    WHERE a.ty IS NULL OR b.ty IS NULL OR (t.etype = 'SUBSUME' AND (t.src = t.dst OR a.ty <> b.ty)) OR (t.etype <> 'SUBSUME' AND (a.ty <> 'ENTITY' OR b.ty <> 'DATA'))""")
def q9_validate(spark, d):
    """Edges of the graphs together with some that are wrong."""
    e = materialize(_graph(Tables(spark, d)).select("graph_id", "src", "dst", "etype"), "edges")
    bad = e.where("length(src) % 3 = 0").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("COLLECT").alias("etype"))
    lost = e.where("length(dst) % 3 = 0").select("graph_id", "src", F.lit("nowhere").alias("dst"), F.lit("SUBSUME").alias("etype"))
    loop = e.where("length(dst) % 3 = 1").select("graph_id", F.col("dst").alias("src"), "dst", F.lit("SUBSUME").alias("etype"))
    nodes = _ends(e).groupBy("graph_id", "name").agg(F.max("ty").alias("ntype"))
    return graph.validate(nodes, e.unionByName(bad).unionByName(lost).unionByName(loop)).where("problem <> 'cycle'")


@query("WITH " + _GE + " SELECT graph_id, count(*) AS edges, count(*) FILTER (WHERE etype = 'COLLECT') AS collect_edges, count(DISTINCT dst) AS data_nodes, count(DISTINCT src) AS entity_nodes FROM ge GROUP BY 1")
def q8_graph_views(spark, d):
    e = _graph(Tables(spark, d))
    return e.groupBy("graph_id").agg(
        F.count("*").alias("edges"), F.count_if(F.col("etype") == "COLLECT").alias("collect_edges"), F.count_distinct("dst").alias("data_nodes"), F.count_distinct("src").alias("entity_nodes")
    )


@query("WITH " + _GE + " SELECT graph_id, src, dst, etype, count(*) AS n FROM ge GROUP BY ALL")
def q10_json_round_trip(spark, d):
    """Edges of the graphs, written as JSON and read back."""
    t = Tables(spark, d)
    back = graph.graphs_from_json(graph.graph_json(_nodes(t), _graph(t)))[1]
    return back.groupBy("graph_id", "src", "dst", "etype").agg(F.count("*").alias("n"))
