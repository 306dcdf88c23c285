"""Structure signals, medium, specificity and typology of documents.

Input is a table of parsed documents ``(doc_id, target_id, target_type, role,
url, title, text, segments, raw[, tables, first_party])``.  What has to be read
from texts, markup and tables is read once and written; medium, facets and
evidence follow from those columns, and segments are scanned in the order in
which they lie.  Nothing but ids, names and evidence is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions import entities as en
from tessella.functions import text as tx
from tessella.functions import urls
from tessella.functions.registry import registry_names
from tessella.operators.scratch import materialize
from tessella.operators.tables import header_tokens, name_cells

LONG_TABLE, LISTED_ORGS, HEADER_MAX = 12, 5, 40
PROSE_CHARS, CUES, CUES_SHORT, TABLE_SHARE = 600, 4, 2, 0.08
#: A page's head, where a list says what it lists and a parked domain says that it is for sale.
HEAD_CHARS, PARKED_CHARS = 600, 3000
CARRY, DECISIVE_CHARS, EVIDENCE_CHARS = 8, 1500, 200
_NONE = "array<string>"


@dataclass(frozen=True)
class Limits:
    """How much of a document is read; None, the default everywhere, reads all of it."""

    segments: int | None = None
    clause_segments: int | None = None
    names: int | None = None
    registry_chars: int | None = None
    label_chars: int | None = None
    page_chars: int | None = None


WHOLE = Limits()
#: Bounds for interactive use, where an answer on the head of a page is good enough.
BRIEF = Limits(segments=600, clause_segments=200, names=200, registry_chars=200_000, label_chars=3_000_000, page_chars=800_000)


def read_chars(text: Column, role: Column, limits: Limits = WHOLE) -> Column:
    """The part of a document that is read, by its role."""
    part = lambda n: text if n is None else F.substring(text, 1, n)
    if limits.registry_chars == limits.label_chars == limits.page_chars:
        return part(limits.page_chars)
    return (
        F.when(role.isin(*lx.REGISTRY_ROLES), part(limits.registry_chars)).when(role.isin(*lx.LABEL_ROLES), part(limits.label_chars)).otherwise(part(limits.page_chars))
    )


def subprocessor_table(tables: Column) -> Column:
    """Some table of three rows or more whose headers read like a list of processors."""

    def fits(t: Column) -> Column:
        words = header_tokens(t["headers"])
        listed = F.array(*[F.lit(w) for w in lx.SUBPROCESSOR_WORDS])
        strong = F.array(*[F.lit(w) for w in lx.SUBPROCESSOR_STRONG])
        return (t["n_rows"] >= 3) & (F.size(words) <= HEADER_MAX) & (F.size(F.array_intersect(words, listed)) >= 2) & F.arrays_overlap(words, strong)

    return F.exists(tables, fits)


def read_documents(docs: DataFrame, gaz: en.Gazetteer, limits: Limits = WHOLE) -> DataFrame:
    """Everything that is read from texts, markup and tables: one narrow pass, each expression once.

    Columns of ``docs`` without ``text``, ``raw`` and ``tables``, and: ``chars``,
    ``text_hash``, ``registry_kind``, ``registry_names``, ``label``, ``cues``,
    ``clause`` (a segment shares or says that others collect, asked of short
    policies only), ``parked``, ``framed``, names in tables and lists, and
    facts about tables.
    """
    role, none = F.coalesce("role", F.lit("")), F.array().cast(_NONE)
    text = read_chars(F.coalesce("text", F.lit("")), role, limits)
    raw = read_chars(F.coalesce(F.nullif("raw", F.lit("")), F.col("text"), F.lit("")), role, limits)
    title = F.coalesce("title", F.lit(""))
    where = F.concat_ws(" ", title, F.coalesce("url", F.lit("")), role)
    tables = F.coalesce(F.col("tables"), F.expr("array()").cast(docs.schema["tables"].dataType)) if "tables" in docs.columns else None
    of_tables = lambda f, empty: empty if tables is None else F.coalesce(f(tables), empty)
    head = F.concat_ws("\n", title, F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS))
    kind = tx.machine_readable_kind(raw)
    first = docs.select(
        *[c for c in docs.columns if c not in ("tables",)], text.alias("_text"), raw.alias("_raw"), kind.alias("registry_kind"),
        tx.platform_label(text, role).alias("label"), F.when(F.length(text) >= PROSE_CHARS, policy_cues(text)).otherwise(0).alias("cues"),
        where.rlike(lx.SUBPROCESSOR_TITLE).alias("sub_title"), where.rlike(lx.COOKIE_TITLE).alias("cookie_titled"),
        (where.rlike(lx.HELP_TITLE) | (role == "help_doc")).alias("help"), (where.rlike(lx.PARTNERS_TITLE) | (role == "partners_page")).alias("partners"),
        head.rlike(lx.VENDOR_LIST_TITLE).alias("list_head"),
        of_tables(subprocessor_table, F.lit(False)).alias("sub_table"),
        of_tables(lambda t: F.array_sort(F.array_distinct(F.flatten(F.transform(t, lambda x: en.gazetteer_orgs(x["cell_text"], gaz))))), none).alias("table_orgs"),
        of_tables(lambda t: F.exists(t, lambda x: x["n_rows"] >= LONG_TABLE), F.lit(False)).alias("long_table"),
        of_tables(lambda t: F.aggregate(t, F.lit(0), lambda n, x: n + F.length(x["cell_text"])), F.lit(0)).alias("table_chars"),
        of_tables(lambda t: F.array_distinct(F.flatten(F.transform(t, name_cells))), none).alias("cells"),
    )
    framed = role.isin(*lx.LIST_ROLES) | F.col("sub_title") | F.col("list_head")
    short = role.isin(*lx.POLICY_ROLES) & (F.col("cues") >= CUES_SHORT) & (F.col("cues") < CUES)
    return first.select(
        *[c for c in first.columns if c not in ("text", "raw", "_text", "_raw", "list_head")], F.length("_text").alias("chars"),
        tx.sha1_of_trimmed(F.coalesce("text", F.lit(""))).alias("text_hash"), framed.alias("framed"),
        F.when(framed & ~F.col("sub_table"), F.array_sort(en.gazetteer_orgs(F.col("_text"), gaz))).otherwise(none).alias("list_orgs"),
        F.coalesce(read_chars(F.col("raw"), role, limits).rlike(lx.CMP), F.lit(False)).alias("cmp"),
        F.when(short, has_disclosure_clause(F.col("segments"), limits.clause_segments)).otherwise(False).alias("clause"),
        F.concat_ws(" ", title, F.substring("_text", 1, PARKED_CHARS)).rlike(lx.PARKED).alias("parked"),
        F.when(F.col("registry_kind") != "", registry_names(F.col("_raw"), F.col("registry_kind"), limits.names)).otherwise(none).alias("registry_names"),
    )


def structural_signals(read: DataFrame) -> DataFrame:
    """Adds ``signals`` to ``read_documents``: flags, organisations in tables and lists, and the names of the flags that hold in fixed order."""
    flags = {
        "subprocessor_title": "sub_title", "subprocessor_table": "sub_table", "cmp_fingerprint": "cmp", "cookie_titled": "cookie_titled", "help_doc": "help",
        "partners_page": "partners", "long_table": "long_table", "vendor_list_framed": "framed",
    }
    fired = F.array_compact(F.array(*[F.when(F.col(c), F.lit(k)) for k, c in flags.items()]))
    signals = F.struct(
        *[F.col(c).alias(k) for k, c in flags.items()], F.col("table_orgs").alias("table_named_orgs"), F.size("table_orgs").alias("n_table_orgs"),
        F.col("list_orgs").alias("list_named_orgs"), F.size("list_orgs").alias("n_list_orgs"), "table_chars", fired.alias("fired"),
    )
    return read.select(*[c for c in read.columns if c not in (*flags.values(), "table_orgs", "list_orgs", "table_chars")], signals.alias("signals"))


def structured_reason(s: Column, label: Column, role: Column, target_type: Column, chars: Column) -> Column:
    """Why a document is a structured list, in order of precedence; null if it isn't."""
    strong = s["cookie_titled"] | role.isin("cookie_policy", "do_not_sell", "vendor_list")
    listish = (s["cmp_fingerprint"] & (strong | s["long_table"])) | (s["cookie_titled"] & s["long_table"])
    dominate = s["table_chars"] >= F.lit(TABLE_SHARE) * F.greatest(F.lit(1), chars)
    return (
        F.when(target_type.isin(*lx.APP_TYPES) & label["has_label"] & label["shares"], "platform_label")
        .when(s["subprocessor_table"], "subprocessor_table")
        .when(s["subprocessor_title"] & (s["long_table"] | (s["n_table_orgs"] >= LISTED_ORGS)), "subprocessor_list")
        .when(s["vendor_list_framed"] & (s["n_list_orgs"] >= LISTED_ORGS), "vendor_list")
        .when(listish & dominate & ((s["n_table_orgs"] >= 1) | (strong & s["long_table"])), "cmp_vendor_list")
        .when(s["long_table"] & (s["n_table_orgs"] >= LISTED_ORGS), "vendor_table")
    )


def policy_cues(text: Column) -> Column:
    """Number of different policy phrases in a text."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(lx.POLICY_CUES), F.lit(0)), lambda x: F.lower(x))))


def has_disclosure_clause(segments: Column, first: int | None = None) -> Column:
    """A segment, or one of the ``first`` ones, shares, or says that others collect."""
    return F.coalesce(F.exists(segments if first is None else F.slice(segments, 1, first), lambda s: tx.positive_sharing(s) | tx.third_party_collects(s)), F.lit(False))


def classify_medium(docs: DataFrame) -> DataFrame:
    """Adds ``medium`` (null if none), ``reason`` and ``fired`` to documents with ``signals``.

    In order: parked, machine-readable, structured, other document, terms page
    (none), prose, unrecognised.
    """
    title = F.coalesce("title", F.lit(""))
    role, kind_of, kind = F.coalesce("role", F.lit("")), F.coalesce("target_type", F.lit("")), F.col("registry_kind")
    # the role gates a registry where there is one, and the kind otherwise
    gate = F.when(role != "", role).otherwise(kind)
    allowed = (
        F.when(kind_of.isin(*lx.WEB_TYPES), gate.isin(*lx.WEB_REGISTRIES))
        .when(kind_of.isin(*lx.APP_TYPES), gate.isin(*lx.APP_REGISTRIES))
        .otherwise(gate.isin(*lx.REGISTRY_ROLES))
    )
    d = docs.withColumns({
        "_why": structured_reason(F.col("signals"), F.col("label"), role, kind_of, F.col("chars")),
        "_prose": F.when(F.col("cues") >= CUES, "policy_prose").when(F.col("clause"), "policy_prose(short)"),
    })
    s = F.col("signals")
    is_prose = F.col("_prose").isNotNull()
    wins = is_prose & (role.isin(*lx.POLICY_ROLES) | title.rlike(lx.PRIVACY_TITLE))
    out = lambda medium, reason, fired: F.struct(
        F.lit(medium).cast("string").alias("medium"), reason.alias("reason"), fired.alias("fired")
    )
    none = F.array().cast(_NONE)
    verdict = (
        F.when(F.col("parked"), out(None, F.lit("parked_domain"), none))
        .when((kind != "") & allowed, out("machine_readable", F.concat(F.lit("registry:"), kind), F.array(F.concat(F.lit("machine_readable:"), kind))))
        .when(F.col("_why").isNotNull(), out("structured", F.col("_why"), F.concat(s["fired"], F.array("_why"))))
        .when((s["help_doc"] | s["partners_page"]) & ~wins, out("other_doc", F.when(s["help_doc"], "help_doc").otherwise("partners_page"), s["fired"]))
        .when(is_prose & title.rlike(lx.TERMS_TITLE) & ~title.rlike(lx.PRIVACY_TITLE), out(None, F.lit("tos_page"), none))
        .when(is_prose, out("prose", F.when(F.concat_ws(" ", title, role).rlike(lx.TERMS_TITLE), "policy_prose(tos_titled)").otherwise(F.col("_prose")), F.array(F.lit("policy_prose"))))
        .otherwise(out(None, F.lit("unrecognised"), none))
    )
    return d.withColumn("_v", verdict).select(*docs.columns, "_v.medium", "_v.reason", "_v.fired")


def carried(df: DataFrame, part: list[str], pos: str, qualifies: str, leads: str, skipped: str, carry: int = CARRY) -> DataFrame:
    """Adds ``carried``: the row qualifies, or one of the ``carry`` rows after a qualifying lead-in that don't.

    Skipped rows neither carry nor count.  Only rows of one ``part`` matter.
    """
    w = Window.partitionBy(*part).orderBy(pos)
    d = df.withColumn("_k", F.sum(F.when(F.col(qualifies) & ~F.col(skipped), 1).otherwise(0)).over(w))
    g = Window.partitionBy(*part, "_k").orderBy(pos)
    d = d.withColumn("_lead", F.max(F.when(F.col(qualifies) & ~F.col(skipped) & F.col(leads), True).otherwise(False)).over(g.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_n", F.sum(F.when(~F.col(skipped) & ~F.col(qualifies), 1).otherwise(0)).over(g))
    return d.withColumn(
        "carried", ~F.col(skipped) & (F.col(qualifies) | ((F.col("_k") > 0) & F.col("_lead") & (F.col("_n") <= carry)))
    ).drop("_k", "_lead", "_n")


def _carry_on(it: Iterator[pa.RecordBatch], carry: int = CARRY) -> Iterator[pa.RecordBatch]:
    """What ``carried`` does, over rows that lie in the order of their document and place: keeps the rows that count."""
    doc, lead, left = None, False, 0
    for b in it:
        keep = []
        for i, q, ends, skip in zip(*(b.column(c).to_pylist() for c in ("doc_id", "q", "lead", "skip"))):
            if i != doc:
                doc, lead, left = i, False, 0
            if skip:
                keep.append(False)
            elif q:
                lead, left = ends, carry
                keep.append(True)
            else:
                keep.append(lead and left > 0)
                left -= 1
        yield b.filter(pa.array(keep, pa.bool_())).select(["doc_id", "fp", "pos", "seg"])


def scan_prose(docs: DataFrame, gaz: en.Gazetteer, limits: Limits = WHOLE) -> DataFrame:
    """``(doc_id, specificities, named_orgs, category_terms, org_typing, deferred, evidence)`` from the segments of documents.

    A segment counts if it shares, lets others collect or sells, or, in a
    policy, names somebody in a disclosing context; outside policies it must
    speak of its own site.  A counting segment that ends with a colon lends
    its standing to the next segments.
    """
    fp = F.coalesce("first_party", F.array().cast(_NONE)) if "first_party" in docs.columns else F.array().cast(_NONE)
    segments = F.col("segments") if limits.segments is None else F.slice("segments", 1, limits.segments)
    seg = docs.select(
        "doc_id", F.coalesce(F.col("role").isin(*lx.POLICY_CONTEXT_ROLES), F.lit(False)).alias("ctx"), fp.alias("fp"), F.posexplode(tx.sentence_segments(segments)).alias("pos", "seg")
    )
    s = F.col("seg")
    skip = F.coalesce(tx.navigation_junk(s) | tx.informational_heading(s), F.lit(True))
    q = tx.positive_sharing(s) | tx.third_party_collects(s) | tx.implicit_sale(s) | (F.col("ctx") & en.disclosure_context(s, gaz, F.col("fp")))
    q = q & (F.col("ctx") | tx.has_first_party_anchor(s))
    # the segments of a document stay together and in order from the explode on, so nothing has to be shuffled or sorted
    flagged = seg.select("doc_id", "fp", "pos", "seg", skip.alias("skip"), F.coalesce(q, F.lit(False)).alias("q"), F.rtrim(s).endswith(":").alias("lead"))
    kept = flagged.mapInArrow(_carry_on, flagged.select("doc_id", "fp", "pos", "seg").schema)
    kept = materialize(kept.withColumn("det", en.detect_orgs(s, gaz, F.col("fp"))), "counting")
    own = F.when(en.org_collects(s, gaz), en.domain_orgs(s, F.col("fp"))).otherwise(F.array().cast(_NONE))
    kept = materialize(kept.select("doc_id", "pos", "seg", F.col("det.typing").alias("typing"), F.array_union(en.party_orgs(s, F.col("det.orgs")), own).alias("orgs")), "named")
    kept = kept.withColumn("cats", en.category_terms(s, F.col("orgs")))
    generic = en.bare_generic(s, F.col("orgs")) | ((F.size("orgs") == 0) & (F.size("cats") == 0) & tx.implicit_sale(s))
    cut = F.when(F.length(s) <= EVIDENCE_CHARS, s).otherwise(F.concat(F.substring(s, 1, EVIDENCE_CHARS - 3), F.lit("...")))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    got = kept.groupBy("doc_id").agg(
        flat("orgs").alias("named_orgs"), flat("cats").alias("category_terms"), F.bool_or(generic).alias("gen"),
        F.min_by("typing", F.when((F.size("orgs") > 0) & (F.col("typing") != ""), F.col("pos"))).alias("org_typing"),
        F.bool_or(s.rlike(lx.POINTER)).alias("deferred"), F.min_by(cut, F.col("pos")).alias("evidence"),
    )
    spec = F.array_compact(
        F.array(F.when(F.size("category_terms") > 0, "category"), F.when(F.col("gen"), "generic"), F.when(F.size("named_orgs") > 0, "named"))
    )
    return got.select("doc_id", spec.alias("specificities"), "named_orgs", "category_terms", F.coalesce("org_typing", F.lit("")).alias("org_typing"), "deferred", "evidence")


def specificities(docs: DataFrame, gaz: en.Gazetteer, limits: Limits = WHOLE) -> DataFrame:
    """Adds ``specificities``, ``named_orgs``, ``category_terms``, ``org_typing`` and ``evidence`` to documents with a medium."""
    none = F.array().cast(_NONE)
    fp = F.coalesce("first_party", none) if "first_party" in docs.columns else none
    role = F.coalesce("role", F.lit(""))
    scanned = docs.where("medium IN ('prose', 'other_doc', 'structured')").where(
        ~((F.col("medium") == "structured") & F.col("label.has_label") & role.isin(*lx.LABEL_ROLES))
    )
    cells = F.filter("cells", lambda v: (F.length(v) <= 60) & v.rlike(r"\p{L}") & ~en.is_first_party(v, fp))
    s = F.col("signals")
    own = docs.drop("segments").withColumns({
        "_cells": cells, "_listed": F.array_sort(F.array_union(s["table_named_orgs"], s["list_named_orgs"])),
        "_reg": F.filter("registry_names", lambda o: ~en.is_first_party(o, fp)),
    }).drop("cells", "registry_names")
    own = own.withColumn("_embedded", F.filter("_cells", lambda v: (F.size(en.gazetteer_orgs(v, gaz)) > 0) | v.rlike(lx.CORPORATE_SUFFIX)))
    # written, so that the scan's few columns are joined by id to small rows that nobody computes again
    own, scan = materialize(own, "decided"), materialize(scan_prose(scanned, gaz, limits), "scanned")
    d = own.join(scan, "doc_id", "left")
    d = d.withColumns({c: F.coalesce(c, none) for c in ("specificities", "named_orgs", "category_terms")} | {c: F.coalesce(c, F.lit("")) for c in ("evidence", "org_typing")})
    medium, ctx, label = F.col("medium"), role.isin(*lx.POLICY_CONTEXT_ROLES), F.col("label")
    add = lambda spec, cond, tag: F.when(cond & ~F.array_contains(spec, tag), F.array_sort(F.array_append(spec, F.lit(tag)))).otherwise(spec)
    d = d.withColumn("specificities", add(F.col("specificities"), (medium == "machine_readable") | ((medium == "structured") & (F.size("_listed") > 0)), "named"))
    # a structured page that shows none otherwise: a label that declares sharing is generic, a list names whom it lists
    bare = (medium == "structured") & (F.size("specificities") == 0)
    shown = F.when(label["has_label"] & label["shares"], F.array(F.lit("generic"))).when(s["subprocessor_table"] | s["long_table"] | s["vendor_list_framed"], F.array(F.lit("named")))
    d = d.withColumn("specificities", F.when(bare, F.coalesce(shown, none)).otherwise(F.col("specificities")))
    embedded = (medium == "prose") & ctx & (F.size("_embedded") > 0)
    d = d.withColumn("specificities", add(F.col("specificities"), embedded, "named"))
    is_named = F.array_contains("specificities", "named")
    names = (
        F.when(medium == "machine_readable", en.merge_orgs(F.col("_reg"), none, limits.names))
        .when((medium == "structured") & is_named, en.merge_orgs(F.array_union("named_orgs", "_listed"), F.col("_cells"), limits.names))
        .when((medium == "other_doc") & is_named, en.merge_orgs(F.col("named_orgs"), F.col("_cells"), limits.names))
        .when(embedded, en.merge_orgs(F.col("named_orgs"), F.col("_embedded"), limits.names))
        .otherwise(F.col("named_orgs"))
    )
    count = lambda c: F.size(c).cast("string")
    note = F.when(F.col("evidence") != "", F.col("evidence")).otherwise(
        F.when(medium == "machine_readable", F.concat(count("_reg"), F.lit(" vendors in the registry file")))
        .when((medium == "structured") & is_named, "list of vendors or processors")
        .when((medium == "structured") & label["has_label"], F.concat(F.lit("sharing declared in the label "), label["kind"]))
        .when((medium == "prose") & (F.size("_embedded") > 0), F.concat(count("_embedded"), F.lit(" organisations in tables of the policy")))
        .otherwise("")
    )
    typing = F.when((F.col("org_typing") == "") & ((medium == "machine_readable") | embedded), "company").otherwise(F.col("org_typing"))
    return d.withColumns({"evidence": note, "org_typing": typing, "named_orgs": names}).drop("_listed", "_cells", "_embedded", "_reg")


def facet(medium: Column, specificity: Column) -> Column:
    """Code of one facet."""
    return F.concat_ws(":", medium, specificity)


def media_of(facets: Column) -> Column:
    """Distinct media of an array of facets, sorted."""
    return F.array_sort(F.array_distinct(F.transform(facets, lambda f: F.split_part(f, F.lit(":"), F.lit(1)))))


def generic_platform_policy(url: Column, first_party: Column) -> Column:
    """The address is a platform's own policy, and the platform isn't the first party."""
    h, p = urls.host(url), urls.path(url)
    out = F.lit(False)
    for host, prefix in lx.PLATFORM_POLICIES:
        brand = host.split(".")[-2]
        out = out | ((h == host) & p.startswith(prefix) & ~F.coalesce(F.array_contains(first_party, brand), F.lit(False)))
    return out


def classify_documents(docs: DataFrame, gaz: en.Gazetteer, verdicts: DataFrame | None = None, limits: Limits = WHOLE) -> DataFrame:
    """Full classification: one row per document with facets, relevance and evidence.

    ``verdicts(text_hash, main_third)`` may hold judgements of an outside
    model, joined by the hash of the trimmed text; an unrecognised document
    that it flags gets the facet prose:generic.
    """
    none = F.array().cast(_NONE)
    fp = F.coalesce("first_party", none) if "first_party" in docs.columns else none
    read = materialize(read_documents(docs, gaz, limits), "read")
    d = specificities(classify_medium(structural_signals(read)), gaz, limits)
    platform = generic_platform_policy(F.coalesce("url", F.lit("")), fp)
    d = d.withColumns({"medium": F.when(platform, None).otherwise(F.col("medium")), "reason": F.when(platform, "generic_platform_policy").otherwise(F.col("reason"))})
    med = F.col("medium")
    facets = F.when(med.isNull(), none).otherwise(F.array_sort(F.transform("specificities", lambda s: F.concat_ws(":", med, s))))
    if verdicts is not None:
        v = verdicts.groupBy("text_hash").agg(F.bool_or(F.col("main_third") == 1).alias("_flag"))
        d = d.join(v, "text_hash", "left")
        facets = F.when(med.isNull() & (F.col("reason") == "unrecognised") & F.coalesce("_flag", F.lit(False)), F.array(F.lit("prose:generic"))).otherwise(facets)
    d = d.withColumn("facets", facets)
    relevant = F.size("facets") > 0
    return d.select(
        "target_id", "doc_id", "role", "url", "target_type", "medium", "reason", relevant.alias("relevant"), "facets", (relevant | (F.col("chars") >= DECISIVE_CHARS)).alias("decisive"),
        F.when(relevant, F.col("named_orgs")).otherwise(none).alias("named_orgs"), "category_terms", "org_typing", F.col("fired").alias("structural_fired"), "evidence",
    )


def assemble_targets(classified: DataFrame) -> DataFrame:
    """Per target: facets united, number of relevant documents, and whether any document decided.  Null targets form one row."""
    return classified.groupBy("target_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("facets", F.array().cast(_NONE)))))).alias("facets"),
        F.count_if("relevant").alias("relevant_docs"), F.count("*").alias("docs"), F.coalesce(F.bool_or("decisive"), F.lit(False)).alias("classified"),
    )


def typology_class(facets: Column) -> Column:
    """Class of a target: its facets, sorted, with semicolons."""
    return F.array_join(F.array_sort(facets), ";")
