"""Registered queries of scalar operators over the driver's texts, names and addresses, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions import entities as en
from tessella.functions import html as hx
from tessella.functions import pdf
from tessella.functions import text as tx
from tessella.functions import urls
from tessella.operators import annotate, collect, labels, relations, report, tables, typology
from tessella.operators.scratch import scratch_root, spread
from tessella.plans.queries import _CLASSIFIED, _DOCS, _RELATIONS, _TARGETS, Tables, _sq, j, query
from tessella.sources import corpus


def _quoted(words) -> str:
    return ", ".join(f"'{_sq(w)}'" for w in words)


# -- pages ---------------------------------------------------------------------------


@query(r"""SELECT doc_id, replace(replace(replace(trim(regexp_replace(regexp_extract(raw, '(?is)<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '&gt;', '>'), '&lt;', '<'), '&amp;', '&') AS title,
    len(regexp_extract_all(raw, '(?i)<a\s[^>]*href=')) AS links, len(regexp_extract_all(raw, '(?i)<table[\s>]')) AS tables FROM parsed_docs""")
def x3_page_counts(spark, d):
    p = hx.parse_documents(spread(Tables(spark, d).parsed_docs.select("doc_id", "raw")), "doc_id", "raw", ("title", "links", "tables"))
    return p.select(F.col("id").alias("doc_id"), "doc.title", F.size("doc.links").cast("bigint").alias("links"), F.size("doc.tables").cast("bigint").alias("tables"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list_transform(segments, lambda s: regexp_extract_all(lower(s), '[a-z][a-z\\-]+'))))), ' ') AS words FROM parsed_docs WHERE segments IS NOT NULL")
def x9_header_tokens(spark, d):
    """Words of headers, here of all segments of a page."""
    p = Tables(spark, d).parsed_docs.where("segments IS NOT NULL")
    return p.select("doc_id", F.array_join(F.array_sort(tables.header_tokens(F.transform("segments", lambda s: F.lower(s)))), " ").alias("words"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS items FROM l WHERE regexp_matches(s, '^\s*(?:[-*•▪‣·–]|\d{1,2}[.)])\s+') GROUP BY 1""")
def x12_plain_list_items(spark, d):
    x = Tables(spark, d).documents.where("text IS NOT NULL")
    n = x.select("doc_id", F.explode(hx.nodes_of_plain(F.col("text"))).alias("n")).where("n.type = 'LISTITEM'")
    return n.groupBy("doc_id").agg(F.count("*").alias("items"))


@query(r"""WITH n AS (SELECT DISTINCT coalesce(data_type, '') AS p, coalesce(entity, '') AS i FROM collect_edges) SELECT p AS lead_in, i AS item, CASE WHEN rtrim(p) = '' THEN i WHEN regexp_matches(rtrim(p), '[:.;]$') THEN rtrim(p) || ' ' || i ELSE rtrim(p) || ': ' || i END AS joined FROM n""")
def x16_join_lead_in(spark, d):
    n = Tables(spark, d).collect_edges.select(F.coalesce("data_type", F.lit("")).alias("lead_in"), F.coalesce("entity", F.lit("")).alias("item")).distinct()
    return n.withColumn("joined", tx.join_lead_in(F.col("lead_in"), F.col("item")))


@query(f"""WITH s AS (SELECT doc_id, unnest(segments) AS s FROM parsed_docs) SELECT doc_id, count(*) FILTER (WHERE regexp_matches(trim(s), '{_sq(lx.ASKS_HEADING)}')) AS headings FROM s GROUP BY 1""")
def l13_informational_headings(spark, d):
    s = Tables(spark, d).parsed_docs.select("doc_id", F.explode("segments").alias("s"))
    return s.groupBy("doc_id").agg(F.count_if(tx.informational_heading(F.col("s"))).alias("headings"))


@query(f"""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '{_sq(lx.POLICY_CUES)}'), lambda c: lower(c)))) AS cues FROM documents WHERE text IS NOT NULL""")
def s5_policy_cues(spark, d):
    return Tables(spark, d).documents.where("text IS NOT NULL").select("doc_id", typology.policy_cues(F.col("text")).cast("bigint").alias("cues"))


@query("WITH " + _DOCS + """ SELECT p.doc_id, CASE WHEN regexp_matches(raw, '(?i)<head[^>]*>') THEN sha1(regexp_replace(raw, '(?i)(<head[^>]*>)', '\\1<base href="' || dc.url || '">')) ELSE sha1('<base href="' || dc.url || '">' || raw) END AS page
    FROM parsed_docs p JOIN dc USING (doc_id) WHERE raw IS NOT NULL AND dc.url IS NOT NULL""")
def b21_page_with_base(spark, d):
    t = Tables(spark, d)
    x = t.parsed_docs.select("doc_id", "raw").join(t.clean_docs().select("doc_id", "url"), "doc_id").where("raw IS NOT NULL AND url IS NOT NULL")
    return x.select("doc_id", F.sha1(hx.with_base(F.col("raw"), F.col("url"))).alias("page"))


@query("SELECT target_id, '<html><head><title>' || target_id || '</title></head><body><p>' || url || '</p></body></html>' AS page FROM targets WHERE url IS NOT NULL AND length(url) >= 3")
def c12_pdf_pages(spark, d):
    """Every target's address as a file of one page, read again."""
    x = Tables(spark, d).targets.where("url IS NOT NULL AND length(url) >= 3")
    data = F.concat(F.lit("%PDF-1.4\n1 0 obj << >> stream\nBT ("), "url", F.lit(") Tj ET\nendstream\n")).cast("binary")
    return x.select("target_id", pdf.pdf_to_html(data, F.col("target_id")).alias("page"))


# -- names -----------------------------------------------------------------------------


@query("""SELECT DISTINCT target_id, entity, list_has_any(list_filter(regexp_split_to_array(lower(entity), '[^a-z0-9]+'), lambda w: length(w) >= 4), list_filter(string_split(split_part(target_id, '__', 2), '-'), lambda w: length(w) >= 3)) AS own FROM collect_edges WHERE entity IS NOT NULL""")
def n7_is_first_party(spark, d):
    e = Tables(spark, d).collect_edges.where("entity IS NOT NULL").select("target_id", "entity").distinct()
    tokens = F.filter(F.split(F.split_part("target_id", F.lit("__"), F.lit(2)), "-"), lambda w: F.length(w) >= 3)
    return e.select("target_id", "entity", en.is_first_party(F.col("entity"), tokens).alias("own"))


_LABEL = f"list_filter(string_split(lower(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)), '.'), lambda x: length(x) >= 3 AND x NOT IN ({_quoted(urls.GENERIC_LABELS)}))"


@query("WITH " + _TARGETS + ", " + _DOCS + f""", u AS (SELECT target_id, list_sort(list(DISTINCT url)) AS us FROM dc WHERE role IN ({_quoted(lx.FIRST_PARTY_URL_ROLES)}) AND url IS NOT NULL GROUP BY 1),
    l AS (SELECT target_id, u, {_LABEL} AS ls FROM (SELECT target_id, unnest(us) AS u FROM u)), b AS (SELECT DISTINCT target_id, list_sort(list_filter(ls, lambda x: length(x) = list_max(list_transform(ls, lambda y: length(y)))))[1] AS t FROM l WHERE len(ls) > 0),
    n AS (SELECT target_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({_quoted(lx.CORPORATE_WORDS)}))) AS t FROM tg), a AS (SELECT * FROM b UNION SELECT * FROM n)
    SELECT tg.target_id, coalesce(array_to_string(list_sort(list(DISTINCT t) FILTER (WHERE t IS NOT NULL)), ';'), '') AS tokens FROM tg LEFT JOIN a USING (target_id) GROUP BY 1""")
def n6_first_party_tokens(spark, d):
    t = Tables(spark, d)
    u = t.clean_docs().where(F.col("role").isin(*lx.FIRST_PARTY_URL_ROLES)).groupBy("target_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    return t.clean_targets().join(u, "target_id", "left").select("target_id", j(en.first_party_tokens(F.col("urls"), F.col("name")), "tokens"))


_TERMS = " ".join(f"WHEN regexp_matches(p, '{_sq(p)}') THEN '{_sq(t)}'" for t, p in annotate.DATA_TERMS)


@query(f"""WITH n AS (SELECT DISTINCT data_type AS phrase FROM collect_edges UNION SELECT label FROM ccpa_data_ontology UNION SELECT unnest(list_distinct(regexp_extract_all(text, '[a-z]+ [a-z]+ [a-z]+'))) FROM documents), x AS (SELECT phrase, lower(trim(phrase)) AS p FROM n WHERE phrase IS NOT NULL)
    SELECT phrase, CASE {_TERMS} END AS term FROM x""")
def g14_data_terms(spark, d):
    """Terms of all data types, concepts and three-word phrases of the corpus."""
    t = Tables(spark, d)
    three = t.documents.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+ [a-z]+ [a-z]+"), F.lit(0)))).alias("phrase"))
    n = t.collect_edges.select(F.col("data_type").alias("phrase")).unionByName(t.ccpa_data_ontology.select(F.col("label").alias("phrase"))).unionByName(three)
    return n.where("phrase IS NOT NULL").distinct().select("phrase", annotate.data_term(F.col("phrase")).alias("term"))


_OWN = annotate._OWN


@query(f"""WITH n AS (SELECT DISTINCT entity AS e FROM collect_edges WHERE entity IS NOT NULL UNION SELECT unnest(regexp_extract_all(text, '(?i)\\b(?:we|our [a-z]+|other [a-z]+|third parties|the [a-z]+) ')) FROM documents),
    x AS (SELECT e, lower(trim(e)) AS p FROM n) SELECT e AS entity, CASE WHEN regexp_matches(p, '{_sq(_OWN)}') THEN 'we' WHEN len(list_filter(regexp_extract_all(p, '[a-z]+'), lambda w: w NOT IN ({_quoted(annotate._GENERIC_WORDS)}))) = 0 OR p = 'unspecified third party' THEN 'unspecified third party' ELSE 'named' END AS kind,
      CASE WHEN regexp_matches(p, '{_sq(_OWN)}') THEN 'first' ELSE 'third' END AS party FROM x""")
def g15_entity_kinds(spark, d):
    t = Tables(spark, d)
    said = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:we|our [a-z]+|other [a-z]+|third parties|the [a-z]+) "), F.lit(0))).alias("entity"))
    n = t.collect_edges.select("entity").where("entity IS NOT NULL").unionByName(said).distinct()
    e = annotate.normalize_entity(F.col("entity"))
    kind = F.when(e.isin("we", "unspecified third party"), e).otherwise("named")
    return n.select("entity", kind.alias("kind"), annotate.classify_party(F.col("entity")).alias("party"))


# -- addresses, results and sheets --------------------------------------------------------


@query("SELECT DISTINCT app_id, CASE WHEN contains(app_id, '.') THEN 'https://lookup.example/?bundleId=' || app_id ELSE 'https://lookup.example/?id=' || app_id END AS url FROM targets WHERE app_id IS NOT NULL")
def c17_lookup_urls(spark, d):
    return Tables(spark, d).targets.where("app_id IS NOT NULL").select("app_id", collect.lookup_url(F.col("app_id"), "https://lookup.example/").alias("url")).distinct()


@query("WITH t AS (SELECT DISTINCT target_id, url FROM targets WHERE url LIKE 'http%'), x AS (SELECT target_id, lower(regexp_extract(t.url, '^[a-z]+://([^/?#:]*)', 1)) AS a, d.url AS u, lower(regexp_extract(d.url, '^[a-z]+://([^/?#:]*)', 1)) AS b FROM t JOIN docs d USING (target_id) WHERE d.url LIKE 'http%')"
       " SELECT DISTINCT target_id, u AS url, array_to_string(list_slice(string_split(a, '.'), -2, -1), '.') = array_to_string(list_slice(string_split(b, '.'), -2, -1), '.') AS same FROM x")
def c21_same_site(spark, d):
    t = Tables(spark, d)
    base = t.targets.where("url LIKE 'http%'").select("target_id", F.col("url").alias("base")).distinct()
    x = t.docs.where("url LIKE 'http%'").select("target_id", "url").distinct().join(base, "target_id")
    return x.select("target_id", "url", urls.same_site(F.col("url"), F.col("base")).alias("same")).distinct()


@query("WITH " + _CLASSIFIED + " SELECT target_id, doc_id, coalesce(medium, '') AS medium, CAST(relevant AS VARCHAR) AS relevant, array_to_string(facets, ';') AS facets, array_to_string(named_orgs, ';') AS named_orgs FROM cl")
def c36_written_results(spark, d):
    """Results written as CSV and read back."""
    c, path = Tables(spark, d).classified(), f"{scratch_root(spark)}/results-{uuid.uuid4().hex}"
    none = F.array().cast("array<string>")
    c = c.withColumns({"target_type": F.lit(""), "reason": F.lit(""), "decisive": F.col("relevant"), "category_terms": none, "org_typing": F.lit(""), "structural_fired": none})
    corpus.write_results(c, typology.assemble_targets(c), path)
    back = spark.read.csv(f"{path}/documents", multiLine=True, **corpus.CSV)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return back.select("target_id", "doc_id", text("medium"), "relevant", text("facets"), text("named_orgs"))


@query("WITH " + _CLASSIFIED + " SELECT target_id, doc_id, coalesce(role, '') AS role, coalesce(medium, '') AS predicted_medium, CAST(CAST(relevant AS INT) AS VARCHAR) AS predicted_relevant FROM cl")
def c38_written_sheet(spark, d):
    """The relevance sheet written as CSV and read back."""
    c, path = Tables(spark, d).classified().withColumn("target_type", F.lit("")), f"{scratch_root(spark)}/sheet-{uuid.uuid4().hex}"
    corpus.write_sheet(labels.relevance_sheet(c), path)
    back = corpus.read_sheet(spark, path, labels.RELEVANCE)
    return back.select("target_id", "doc_id", *[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("role", "predicted_medium", "predicted_relevant")])


@query("WITH " + _CLASSIFIED + ", " + _RELATIONS + """, f AS (SELECT DISTINCT target_id, unnest(facets) AS f FROM cl)
    SELECT target_id, 'facet' AS section, f AS key, split_part(f, ':', 1) AS value FROM f UNION ALL SELECT target_id, 'document', doc_id, coalesce(medium, '') FROM cl
    UNION ALL SELECT target_id, 'relation', entity || '|' || data_type || '|' || action || '|' || CAST(negative AS VARCHAR), array_to_string(list_sort(list_distinct(flatten(list(coalesce(purposes, []))))), ';') FROM rl GROUP BY target_id, entity, data_type, action, negative""")
def u1_analysis_rows(spark, d):
    t = Tables(spark, d)
    c = t.classified()
    a = typology.assemble_targets(c.withColumn("decisive", F.size("facets") > 0))
    x = t.clean_docs().select("target_id", "doc_id", "role", "url", "ok").join(t.parsed_docs.select("doc_id", "text", "links"), "doc_id")
    rows = report.analysis_rows(a, c, relations.merge_relations(t.relations(), ["target_id"]), report.rights_info(x))
    return rows.where("section NOT IN ('link', 'address')")  # these are compared by u2_rights_info


def _starts(p: str) -> str:
    """SQL for the matches of a pattern in ``s`` as (start, end), counted from 0."""
    f, b = f"regexp_extract_all(s, '{_sq(p)}')", f"regexp_split_to_array(s, '{_sq(p)}')"
    size = lambda x, n: f"coalesce(list_sum(list_transform(list_slice({x}, 1, {n}), lambda z: length(z))), 0)"
    return f"list_transform(range(1, len({f}) + 1), lambda i: {{'a': CAST({size(b, 'i')} + {size(f, 'i - 1')} AS BIGINT), 'b': CAST({size(b, 'i')} + {size(f, 'i')} AS BIGINT)}})"


_NEGATED = f"""(regexp_matches(regexp_replace(substr(s, greatest(m.a - {lx.NEGATION_WINDOW}, 0) + 1, least(m.a, {lx.NEGATION_WINDOW})), '{_sq(lx.CLAUSE_END)}', ''), '{_sq(lx.NEGATION)}')
    AND NOT regexp_matches(substr(s, m.a + 1, {lx.EXCEPTION_WINDOW}), '{_sq(lx.EXCEPTION)}'))"""


def _affirmed(p: str, more: str) -> str:
    return f"len(list_filter({_starts(p)}, lambda m: {more} AND NOT {_NEGATED})) > 0"


_SELF = f"NOT regexp_matches(substr(s, m.b + 1), '{_sq(lx.SELF_RECIPIENT)}')"
_STOPPED = f"NOT regexp_matches(substr(s, 1, m.a), '{_sq(lx.SALE_STOPPED)}')"


@query(f"""WITH n AS (SELECT DISTINCT unnest(segments) AS s FROM parsed_docs) SELECT s AS segment, {_affirmed(lx.SHARING, _SELF)} AS sharing, {_affirmed(lx.COLLECTION, _SELF)} AS collection, {_affirmed(lx.SALE, _STOPPED)} AS sale FROM n WHERE s IS NOT NULL""")
def l4_affirmed_clauses(spark, d):
    """Which distinct segments affirm a sharing, a collection or a sale, whatever they deny."""
    s = Tables(spark, d).parsed_docs.select(F.explode("segments").alias("segment")).where("segment IS NOT NULL").distinct()
    c = F.col("segment")
    return s.select("segment", tx.positive_sharing(c).alias("sharing"), tx.positive_collection(c).alias("collection"), tx.implicit_sale(c).alias("sale"))


_MAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"


@query("WITH " + _DOCS + rf""", x AS (SELECT dc.target_id, dc.doc_id, dc.role, dc.url, p.text, p.links FROM dc JOIN parsed_docs p USING (doc_id) WHERE dc.ok AND dc.role IN ({_quoted(lx.RIGHTS_ROLES)})),
    f AS (SELECT target_id, role, arg_min(url, doc_id) AS url FROM x GROUP BY 1, 2), l AS (SELECT target_id, string_agg(role || '=' || url, ';' ORDER BY role) AS links FROM f GROUP BY 1),
    m AS (SELECT target_id, unnest(list_concat(list_transform(list_filter(coalesce(links, []), lambda y: starts_with(lower(y.href), 'mailto:')), lambda y: regexp_replace(y.href, '(?i)^mailto:|\?.*$', '', 'g')), regexp_extract_all(coalesce(text, ''), '{_sq(_MAIL)}'))) AS e FROM x),
    d AS (SELECT DISTINCT target_id, lower(e) AS e FROM m WHERE regexp_matches(lower(e), '^(?:{_MAIL.removeprefix('(?i)')})$')), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY CAST(NOT regexp_matches(e, '^(?:privacy|dpo|gdpr|data-?protection|ccpa)') AS INT), length(e), e) AS k FROM d),
    g AS (SELECT target_id, string_agg(e, ';' ORDER BY k) AS emails FROM r WHERE k <= 3 GROUP BY 1) SELECT l.target_id, l.links, coalesce(emails, '') AS emails FROM l LEFT JOIN g USING (target_id)""")
def u2_rights_info(spark, d):
    t = Tables(spark, d)
    x = t.clean_docs().select("target_id", "doc_id", "role", "url", "ok").join(t.parsed_docs.select("doc_id", "text", "links"), "doc_id")
    return report.rights_info(x).select("target_id", F.array_join(F.transform("links", lambda y: F.concat_ws("=", y["role"], y["url"])), ";").alias("links"), F.array_join("emails", ";").alias("emails"))
