"""Knowledge graphs from sentences with a small rule tagger.

A sentence is cut into spans (noun phrases that end in a word for data or for
an actor), and rules over spans, verbs and prepositions emit edges.  There is
no dependency parser, so recall on winding sentences is lower than a model's;
a tagger of the caller's own may replace ``tag_sentence``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import lexicons as lx
from tessella.functions.html import read_html
from tessella.functions.text import purposes_or_other
from tessella.operators.graph import UNSPECIFIED_DATA, UNSPECIFIED_PARTY, WE, acyclic_subsumptions, closure, graph_edges, graph_nodes
from tessella.operators.scratch import materialize, work_partitions

# Verbs by what they do to data; action of the subject, action of a recipient.
VERBS = {
    "collect": ("collect gather obtain receive acquire request record track", "collect", None),
    "share": ("share disclose transfer provide give send pass release divulge exchange", "collect", "be_shared"),
    "sell": ("sell rent trade lease license", "collect", "be_sold"),
    "use": ("use process analyse analyze combine access", "use", None),
    "store": ("store retain keep save hold archive", "store", None),
}
_FORM: dict[str, str] = {}
for _group, (_verbs, _, _) in VERBS.items():
    for _v in _verbs.split():
        _stem = _v[:-1] if _v.endswith("e") else _v
        for _f in (_v, _v + "s", _stem + "ed", _stem + "ing", _v + _v[-1] + "ed", _v + _v[-1] + "ing", _v + "es", (_v[:-1] + "ies") if _v.endswith("y") else _v):
            _FORM[_f] = _group
_FORM.update({"sold": "sell", "selling": "sell", "gave": "share", "given": "share", "sent": "share", "held": "store", "kept": "store"})
# Heads of phrases.
DATA_HEADS = frozenset(
    "data information address addresses identifier identifiers id ids cookie cookies location locations name names number numbers email emails history details "
    "records record preferences credentials password passwords photo photos picture pictures contact contacts content contents message messages log logs activity "
    "profile profiles birthday age gender biometric fingerprint demographics interests pixel pixels tag tags token tokens reading readings counts snippets settings "
    "notes entries traces phrases captions slots paths answers facts codes nicknames".split()
)
ENTITY_HEADS = frozenset(
    "we us party parties partner partners provider providers company companies advertiser advertisers affiliate affiliates subsidiary subsidiaries vendor vendors "
    "processor processors network networks broker brokers publisher publishers contractor contractors supplier suppliers agency agencies authority authorities "
    "sponsor sponsors merchant merchants organization organizations organisation organisations service services platform platforms site website app application".split()
)
_STOP = frozenset("a an the our your their its this that these those some any all certain such other various of for in on at by from as is are was be may might will can could shall should do does did not never include includes including consists comprise comprises especially like".split())
_THESE = frozenset("this that these those such".split())
_DETERMINER = re.compile(r"^(?:(?:the|a|an|our|your|their|his|her|its|this|that|these|those|any|some|such|other|certain|all|both|each|various)\s+)+", re.I)
#: Phrases that point back to what was named before; they keep their determiner until that is found.
_POINTING = re.compile(r"(?:this|that|these|those|such)\s+(?:personal\s+)?(?:data|information|details?|records?|parties|party|compan(?:y|ies)|providers?|partners?)$", re.I)
_WORD = re.compile(r"[A-Za-z][\w'’&.-]*[A-Za-z0-9]|[A-Za-z]|[,;:]|\d+")
_CUE = re.compile(r"\b(such as|including(?: but not limited to)?|like|especially|e\.g\.|for example|for instance)\b,?\s*", re.I)
_INCLUDES = re.compile(r"\b(?:includes?|consists? of|comprises?)\b", re.I)
_COLLECTIVE = re.compile(r"\bcollectively(?:,| referred to as| known as)?\b\s*", re.I)
_PURPOSE = re.compile(r"\b(?:(?:in order )?to (?!be\b|have\b|the\b|our\b|us\b|you\b|your\b|any\b|third\b|a\b)([a-z]+(?: [\w'-]+)*)|for ([a-z]+(?: [\w'-]+)*?) purposes?|for (?:the purposes? of )?([a-z]+ing\b(?: [\w'-]+)*))", re.I)
_CHILD = re.compile(r"\b(?:child|children|minors?|kids?|under (?:the age of )?1[0-8])\b", re.I)
_NEG = re.compile(lx.NEGATION.replace("(?i)", ""), re.I)
_EXC = re.compile(lx.EXCEPTION.replace("(?i)", ""), re.I)
_CLAUSE = re.compile(r"[.;!?:] |,\s*(?:but|however|yet|although|though|whereas)\b\s*", re.I)
EDGE = "src string, src_label string, dst string, dst_label string, etype string, action string, subject string, purposes array<string>, text string"


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, label, text)`` of DATA and ENTITY phrases in order."""
    out: list[tuple[int, int, str, str]] = []
    words = [(m.start(), m.end(), m.group(0)) for m in _WORD.finditer(text)]
    lows = [w.lower().rstrip(".") for _, _, w in words] + [""]
    begin = 0
    for k, (a, b, w) in enumerate(words):
        low = lows[k]
        if w in ",;:" or low in ("and", "or", "with", "to", "but", "if", "when", "unless", "which", "who") or low in _FORM or (low in _STOP and low not in _THESE):
            begin = k + 1
            continue
        nxt = lows[k + 1]
        joined = k + 1 < len(words) and nxt not in _STOP and nxt not in _FORM and nxt not in ("and", "or", ",", ";", ":", "with", "to", "but", "if") and (nxt in DATA_HEADS or nxt in ENTITY_HEADS)
        if joined:
            continue
        proper = w[0].isupper() and k > 0
        label = "DATA" if low in DATA_HEADS else "ENTITY" if low in ENTITY_HEADS else ""
        if not label and proper and not (k + 1 < len(words) and words[k + 1][2][:1].isupper()):
            label = "ENTITY"
        if label:
            s = words[begin][0] if begin <= k else a
            out.append((s, b, label, text[s:b] if _POINTING.match(text[s:b]) else _DETERMINER.sub("", text[s:b])))
            begin = k + 1
    return out


def _negated(text: str, pos: int) -> bool:
    pre = text[max(0, pos - lx.NEGATION_WINDOW) : pos]
    cut = [m.end() for m in _CLAUSE.finditer(pre)]
    return bool(_NEG.search(pre[cut[-1] :] if cut else pre)) and not _EXC.search(text[pos : pos + lx.EXCEPTION_WINDOW])


def tag_sentence(text: str) -> list[tuple]:
    """Edges of one sentence as rows of ``EDGE``; questions and empty sentences have none."""
    if not text or text.rstrip().endswith("?"):
        return []
    verbs = [(m.start(), m.end(), _FORM[m.group(0).lower()]) for m in re.finditer(r"[A-Za-z]+", text) if m.group(0).lower() in _FORM]
    if not verbs and not (_CUE.search(text) or _INCLUDES.search(text) or _COLLECTIVE.search(text)):
        return []
    sp, out = spans(text), []
    subject = "child" if _CHILD.search(text) else "general user"
    purposes = sorted({p for m in _PURPOSE.finditer(text) for p in [next(g for g in m.groups() if g)]})
    for k, (a, b, group) in enumerate(verbs):
        stop = verbs[k + 1][0] if k + 1 < len(verbs) else len(text)
        cut = _CLAUSE.search(text, b, stop)
        stop = cut.start() if cut else stop
        _, act, to_act = VERBS[group]
        who = next((s for s in reversed(sp) if s[2] == "ENTITY" and s[1] <= a), None)
        what = [s for s in sp if s[2] == "DATA" and b <= s[0] < stop]
        if not what:  # passive: the data stand before the verb, in its clause
            clause = max((m.end() for m in _CLAUSE.finditer(text, 0, a)), default=0)
            what = [s for s in sp if s[2] == "DATA" and clause <= s[0] and s[1] <= a] if re.search(r"\b(?:is|are|was|were|be|been)\s+(?:\w+\s+)?$", text[:a]) else []
            if what:
                by = re.match(r"\s*by\s+", text[b:])
                who = next((s for s in sp if by and s[2] == "ENTITY" and s[0] >= b), None if by else who)
        said = [s for s in sp if s[2] == "ENTITY" and b <= s[0] < stop and re.search(r"\b(?:with|to)\s+(?:[\w'-]+\s+){0,4}$|,\s*$|\b(?:and|or)\s+(?:[\w'-]+\s+){0,2}$", text[b : s[0]] or " ")]
        if group == "share" and text[a:b].lower().startswith(("provid", "giv")) and not said:  # provide SOMEBODY with data
            said = [s for s in sp if s[2] == "ENTITY" and b <= s[0] < stop and re.match(r"\s+with\b", text[s[1] :])]
        if not what:
            continue
        neg = _negated(text, a)
        etype = "NOT_COLLECT" if neg else "COLLECT"
        note = lambda x, y: f"{x[3]} {text[a:b]} {y[3]}"  # noqa: E731, B023
        none = (0, 0, "ENTITY", UNSPECIFIED_PARTY)
        for d in what:
            if who and not (neg and group in ("share", "sell")):
                out.append((who[3], "ENTITY", d[3], "DATA", etype, act, subject, purposes, note(who, d)))
            if to_act:
                for r in said or ([none] if neg or group == "sell" else []):
                    out.append((r[3], "ENTITY", d[3], "DATA", etype, to_act, subject, purposes, note(r, d)))
    for m in [*_CUE.finditer(text), *_INCLUDES.finditer(text)]:
        up = next((s for s in reversed(sp) if s[1] <= m.start()), None)
        downs = [s for s in sp if s[0] >= m.end()]
        if up:
            last = m.end()
            for d in downs:
                gap = text[last : d[0]]
                if d[2] != up[2] or not re.fullmatch(r"[\s,]*(?:(?:and|or|as well as)\s+)?(?:[\w'-]+\s+){0,3}", gap):
                    break
                out.append((up[3], up[2], d[3], d[2], "SUBSUME", None, None, [], text[m.start() : m.end()].strip()))
                last = d[1]
    for m in _COLLECTIVE.finditer(text):
        up = next((s for s in sp if s[0] >= m.end()), None)
        clause = max((c.end() for c in _CLAUSE.finditer(text, 0, m.start())), default=0)
        for d in [s for s in sp if clause <= s[0] and s[1] <= m.start()] if up else []:
            if d[2] == up[2]:
                out.append((up[3], up[2], d[3], d[2], "SUBSUME", None, None, [], "collectively"))
    return list(dict.fromkeys((*t[:7], tuple(t[7]), t[8]) for t in out))


def phrase_edges(sentences: DataFrame, tagger: Callable[[str], list[tuple]] = tag_sentence) -> DataFrame:
    """``(doc_id, sent_id, ...)`` edges between phrases of ``sentences(doc_id, sent_id, text)``.

    Each distinct sentence is tagged once and its edges go back to all places
    where it stands.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["key", *[c.split()[0] for c in EDGE.split(", ")]]
        for pdf in it:
            rows = [(k, *e[:7], list(e[7]), e[8]) for k, t in zip(pdf["key"], pdf["text"]) for e in tagger(t)]
            yield pd.DataFrame(rows, columns=cols)

    n = work_partitions(sentences.sparkSession)
    at = materialize(sentences.select("doc_id", "sent_id", "text", F.unhex(F.md5("text")).alias("key")).where("text <> ''"), "sentences")
    distinct = at.select("key", "text").repartition(n, "key").dropDuplicates(["key"])
    tagged = distinct.mapInPandas(run, "key binary, " + EDGE)
    # places carry the key of their sentence, not the sentence
    return at.select("doc_id", "sent_id", "key").join(tagged, "key").drop("key")


def _with(first: str, then: str = "") -> str:
    """Pattern for one of some words, followed somewhere by one of others; words are beginnings of words unless they end with ``$``."""
    some = lambda ws: r"\b(?:" + "|".join(w[:-1] + r"\b" if w.endswith("$") else w for w in ws.replace("_", "[- ]?").split()) + ")"
    return some(first) + (".*" + some(then) if then else "")


_ID = "id$ ids$ identif number code"
_INFO = "info data$ detail record"
# Terms of data, the more specific first; their names are fixed values, those of the ontology.
DATA_TERMS = (
    ("non-personal information", _with("non_personal non_pii non_identif")),
    ("aggregate / deidentified / pseudonymized information", _with("aggregat de_identif anonym pseudonym hashed")),
    ("precise geolocation", _with("precise exact gps$", "locat geolocat position")),
    ("coarse geolocation", _with("coarse approximate general city region zip", "locat geolocat")),
    ("ip address", _with("ip$", "address") + "|" + _with("internet_protocol")),
    ("mac address", _with("mac$", "address")),
    ("email address", _with("e_mail")),
    ("postal address", _with("postal mailing home street billing shipping physical", "address")),
    ("geolocation", _with("location geo_location whereabouts")),
    ("android id", _with("android$", _ID)),
    ("gsf id", _with("gsf$ google_services_framework")),
    ("advertising id", _with("advertis ad$", "id$ ids$ identif") + "|" + _with("idfa$ gaid$ aaid$")),
    ("router ssid", _with("ssid$ bssid$")),
    ("cookie / pixel tag", _with("cookie pixel web_beacon beacon etag$ local_storage")),
    ("imei", _with("imei$")),
    ("sim serial number", _with("sim$", "serial number card")),
    ("serial number", _with("serial_number")),
    ("software identifier", _with("software", "id$ ids$ identif")),
    ("hardware identifier", _with("hardware", "id$ ids$ identif")),
    ("device identifier", _with("device", "id$ ids$ identif code")),
    ("device information", _with("device", _INFO + " model setting")),
    ("ssn", _with("social_security ssn$")),
    ("passport number", _with("passport")),
    ("driver's license number", _with("driver driving", "licen")),
    ("government identifier", _with("government national", "id$ identif")),
    ("phone number", _with("phone$ phones$ telephone mobile_number cell_number msisdn$")),
    ("person name", r"\b(?:full|first|last|given|sur|maiden)?\s?names?$"),
    ("contact information", _with("contact", _INFO + " entr method")),
    ("date of birth", _with("birth dob$")),
    ("age", _with("age$ ages$")),
    ("gender", _with("gender sex$")),
    ("race / ethnicity", _with("race$ racial ethnic")),
    ("voiceprint", _with("voice_print voice_data voice_record")),
    ("fingerprint", _with("finger_print")),
    ("biometric information", _with("biometric face_scan iris")),
    ("protected classification", _with("protected", "class characteristic")),
    ("personal characteristic", _with("demographic") + "|" + _with("personal", "characteristic")),
    ("application installed", _with("installed", "app") + "|" + _with("app_list")),
    ("browsing / search history", _with("brows search web$", "histor path phrase term")),
    ("internet activity", _with("clickstream usage internet_activity log_file log_data")),
    ("personal identifier", _with("personal", "id$ ids$ identif") + "|" + _with("pii$")),
    ("identifier", _with("identifier unique_id")),
    ("personal information", _with("personal")),
)
_BLANKET = r"^(?:data|information|details|records?|content)$"
_OWN = r"(?i)^(?:we|us|our|ourselves|i|the company|this (?:site|website|app|service)|the (?:site|website|app|service|platform))\b"
_GENERIC_WORDS = ("third", "party", "parties", "other", "others", "another", "company", "companies", "entity", "entities", "external", "outside", "person", "persons", "people", "someone", "anyone", "thirdparty", "and")


def singular(w: Column) -> Column:
    """Naive singular of a lower-case word."""
    return (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(?:ss|sh|ch|x)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & ~w.rlike("(?:ss|us|is)$") & (F.length(w) > 3), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def lemmas(phrase: Column) -> Column:
    """Phrase of singular words without determiners, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(phrase, F.lit(""))), F.lit(r"[\p{L}\p{N}'&+.-]+"), F.lit(0))
    return F.array_join(F.transform(F.filter(words, lambda w: ~w.isin(*sorted(_STOP))), singular), " ")


def data_term(phrase: Column) -> Column:
    """The first of ``DATA_TERMS`` whose pattern fits a data phrase, null if none does."""
    low = F.lower(F.trim(F.coalesce(phrase, F.lit(""))))
    out = F.when(F.lit(False), F.lit(""))
    for term, pattern in DATA_TERMS:
        out = out.when(low.rlike(pattern), term)
    return out


def normalize_data(phrase: Column) -> Column:
    """Term of a data phrase: "unspecified data" for blanket words, else the first pattern that fits, else the lemmas."""
    lem = lemmas(phrase)
    return F.when(lem.rlike(_BLANKET) | (lem == ""), UNSPECIFIED_DATA).otherwise(F.coalesce(data_term(phrase), lem))


def normalize_entity(phrase: Column, companies: tuple[str, ...] = ()) -> Column:
    """Actor of a phrase: "we", a known company (longest first), "unspecified third party" for generic words only, else the lemmas."""
    low = F.lower(F.trim(F.coalesce(phrase, F.lit(""))))
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    generic = F.size(F.array_except(words, F.array(*map(F.lit, _GENERIC_WORDS)))) == 0
    out = F.when(low.rlike(_OWN), WE)
    for c in sorted(companies, key=lambda c: (-len(c), c)):
        out = out.when(low.rlike(r"(?<!\w)\Q" + c.replace("\\E", "") + r"\E(?!\w)"), c)
    return out.when(generic, UNSPECIFIED_PARTY).otherwise(lemmas(phrase))


def classify_party(phrase: Column) -> Column:
    """first or third."""
    return F.when(F.lower(F.trim(phrase)).rlike(_OWN), "first").otherwise("third")


def resolved(edges: DataFrame) -> DataFrame:
    """Phrase edges in which phrases that point back ("this information") are replaced by what they point to.

    That is the nearest earlier phrase of the same label in the document that
    doesn't point itself; a phrase without one loses its determiner.  The
    rows of one document are ordered by one task.
    """
    back = lambda c: F.col(c).rlike("(?i)" + _POINTING.pattern)
    points = back("src") | back("dst")
    pointing = materialize(edges.where(points), "pointing")
    # only documents with such phrases have to be put in order
    near = edges.join(pointing.select("doc_id").distinct(), "doc_id", "left_semi")
    ends = F.array(*[F.struct(F.col(f"{x}_label").alias("label"), F.col(x).alias("text"), F.lit(k).alias("start")) for k, x in enumerate(("src", "dst"))])
    at = near.select("doc_id", "sent_id", F.inline(ends)).distinct()
    found = antecedents(at.withColumn("demonstrative", back("text"))).where("demonstrative")
    found = materialize(found.groupBy("doc_id", "sent_id", "label", "text").agg(F.min("antecedent").alias("antecedent")), "antecedents")
    out = pointing
    for x in ("src", "dst"):
        ref = found.select("doc_id", "sent_id", F.col("label").alias(f"{x}_label"), F.col("text").alias(x), F.col("antecedent").alias("_to"))
        out = out.join(ref, ["doc_id", "sent_id", f"{x}_label", x], "left").withColumn(x, F.coalesce("_to", F.when(back(x), F.regexp_replace(x, r"(?i)^(?:this|that|these|those|such)\s+", "")).otherwise(F.col(x)))).drop("_to")
    return edges.where(~points).unionByName(out.select(edges.columns))


def normalized_edges(edges: DataFrame, companies: tuple[str, ...] = ()) -> DataFrame:
    """Phrase edges with terms for ends and tags for purposes, keyed by document as ``graph_id``."""
    norm = lambda c, lab: F.when(F.col(lab) == "DATA", normalize_data(F.col(c))).otherwise(normalize_entity(F.col(c), companies))
    tags = F.when(F.size("purposes") == 0, F.array().cast("array<string>")).otherwise(purposes_or_other(F.array_join("purposes", " ; ")))
    # a document's many phrases are few different ones: each is normalised once
    phrases = edges.select(F.inline(F.array(*[F.struct(F.col(f"{x}_label").alias("label"), F.col(x).alias("phrase")) for x in ("src", "dst")]))).distinct()
    terms = materialize(phrases.withColumn("term", norm("phrase", "label")), "terms")
    out = edges
    for x in ("src", "dst"):
        out = out.join(terms.select(F.col("label").alias(f"{x}_label"), F.col("phrase").alias(x), F.col("term").alias(f"{x}_term")), [f"{x}_label", x])
    return out.select(
        F.col("doc_id").alias("graph_id"), "sent_id", F.col("src_term").alias("src"), "src_label", F.col("dst_term").alias("dst"), "dst_label", "etype", "action", "subject",
        tags.alias("purposes"), "text",
    )


def page_sentences(raw: str | None) -> list[tuple[int, int, int, str]]:
    """``(node, variant, k, text)`` of the sentences of a page, furniture left out.

    Variant 0 is a node's own text; a list item whose lead-in has a colon also
    stands behind it as variant 1, so that what the lead-in says holds for the
    item (the colon would end its clause and goes).  Of tables, cells of three
    words or more are taken.
    """
    nodes = {n["node_id"]: n for n in read_html(raw)["nodes"]}
    out: list[tuple[int, int, int, str]] = []
    for i, n in nodes.items():
        if n["boilerplate"] or n["type"] == "ROOT":
            continue
        texts = [(0, n["text"])]
        if n["type"] == "TABLE":
            texts = [(0, c) for c in n["text"].split(" • ") if len(c.split()) >= 3]
        elif n["type"] == "LISTITEM":
            lead = (nodes[n["parent_id"]]["text"] if n["parent_id"] in nodes else "").rstrip()
            if lead.endswith(":"):
                texts.append((1, f"{_COLON.sub(' ', lead[:-1])} {n['text']}"))
        for variant, text in texts:
            out += [(i, variant, k, t) for k, t in enumerate(x for x in _ENDS.split(text) if x.strip())]
    return out


_COLON, _ENDS = re.compile(r":\s+"), re.compile(r"(?<=[.!?])\s+")


def document_sentences(pages: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """``(doc_id, sent_id, text)`` of ``page_sentences`` for every page; ``sent_id`` is ``(node, variant, k)``.

    A page is one row, so its list items meet their lead-ins without a join.
    """
    src = pages.select(F.col(id_col).alias("doc_id"), F.col(raw_col).alias("raw")).where("raw IS NOT NULL")
    kind = dict(src.dtypes)["doc_id"]

    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, rows = [], []
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist()):
                found = page_sentences(raw)
                ids += [i] * len(found)
                rows += found
            where = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(3)], names=["node", "variant", "k"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), where, pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "sent_id", "text"])

    return src.mapInArrow(fn, f"doc_id {kind}, sent_id struct<node:int,variant:int,k:int>, text string")


def build_graphs(sentences: DataFrame, companies: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph per document from ``sentences(doc_id, sent_id, text)``.

    Phrases that point back are resolved, ends and purposes normalised, and
    SUBSUME edges that would close a cycle with those before them dropped.
    """
    e = materialize(normalized_edges(resolved(materialize(phrase_edges(sentences), "phrases")), companies), "edges")
    o = F.struct("sent_id", "etype")
    ends = e.select("graph_id", F.col("src").alias("name"), F.col("src_label").alias("ntype"), F.when(F.col("src_label") == "DATA", F.col("subject")).alias("subject"), o.alias("ord")).unionByName(
        e.select("graph_id", F.col("dst").alias("name"), F.col("dst_label").alias("ntype"), F.when(F.col("dst_label") == "DATA", F.col("subject")).alias("subject"), o.alias("ord"))
    )
    collect = graph_edges(e.where("etype <> 'SUBSUME'").select("graph_id", F.col("src").alias("entity"), F.col("dst").alias("data_type"), F.col("etype").alias("edge_type"), "action", "subject", "purposes", F.array("text").alias("text")))
    sub = e.where("etype = 'SUBSUME' AND src_label = dst_label AND src <> dst")
    kept = acyclic_subsumptions(sub.select("graph_id", "src", "dst", F.to_json("sent_id" if dict(sub.dtypes)["sent_id"].startswith("struct") else F.struct("sent_id")).alias("ord")))
    sub = sub.select("graph_id", "src", "dst", "etype", "action", "subject", "purposes", F.array("text").alias("text"))
    sub = sub.groupBy("graph_id", "src", "dst", "etype", "action", "subject").agg(F.first("purposes").alias("purposes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("text")))).alias("text"))
    return graph_nodes(ends), collect.unionByName(sub.join(kept, ["graph_id", "src", "dst"], "left_semi").select(collect.columns))


def antecedents(spans_: DataFrame) -> DataFrame:
    """Adds ``antecedent``: the nearest earlier span of the same label in the document, for demonstrative spans.

    A backward as-of join as one window: ``spans_(doc_id, sent_id, start,
    label, text, demonstrative)``.
    """
    w = Window.partitionBy("doc_id", "label").orderBy("sent_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(~F.col("demonstrative"), F.col("text")), ignorenulls=True).over(w)
    return spans_.withColumn("antecedent", F.when(F.col("demonstrative"), prev))


def list_items_inherit(items: DataFrame, lead_edges: DataFrame) -> DataFrame:
    """Edges of a lead-in copied to its list items: ``items(doc_id, parent_id, data, has_entity)`` with data and no actor of their own."""
    i = items.where("data IS NOT NULL AND NOT has_entity").select("doc_id", F.col("parent_id").alias("node_id"), F.col("data").alias("dst"))
    return lead_edges.where("etype IN ('COLLECT', 'NOT_COLLECT')").drop("dst").join(i, ["doc_id", "node_id"]).withColumn("subject", F.lit(None).cast("string"))


def follow_links(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(doc_id, src, target)``: ends of reference chains ``links(doc_id, src, dst, ord)``, the last link of a source counting.

    Pointers are doubled until none changes; on a cycle they never rest, so
    members of cycles are found first and end at the least of their cycle.
    """
    cur = links.groupBy("doc_id", "src").agg(F.max_by("dst", "ord").alias("dst"))
    cur = materialize(cur.where("src <> dst"), "links")
    reach = closure(cur, ["doc_id"])
    loops = reach.where("ancestor = descendant").select("doc_id", F.col("ancestor").alias("src"))
    # a source has one link, so whatever a member of a cycle reaches lies on the cycle
    root = reach.withColumnRenamed("ancestor", "src").join(loops, ["doc_id", "src"], "left_semi")
    root = materialize(root.groupBy("doc_id", "src").agg(F.min("descendant").alias("root")), "roots")
    cur = materialize(cur.join(root.where("src = root").select("doc_id", "src"), ["doc_id", "src"], "left_anti"), "links")
    for _ in range(max_rounds):
        nxt = cur.select("doc_id", F.col("src").alias("dst"), F.col("dst").alias("next"))
        step = materialize(cur.join(nxt, ["doc_id", "dst"], "left").select("doc_id", "src", F.coalesce("next", "dst").alias("to"), F.col("next").isNotNull().alias("moved"), "dst"), "links")
        cur = step.select("doc_id", "src", F.col("to").alias("dst"))
        if step.where("moved").isEmpty():
            heads = root.where("src = root").select("doc_id", "src", F.col("root").alias("dst"))
            return cur.unionByName(heads).withColumnRenamed("dst", "target")
    raise RuntimeError(f"links don't end after {max_rounds} rounds")
