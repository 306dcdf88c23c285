"""Text scalars: white space, segmentation, and predicates that know where a phrase stands.

Everything but ``reflow`` is a composition of built-in expressions, evaluated in
the JVM.  A null text gives null or false, an empty one an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import lexicons as lx

MAX_SEGMENT = 400
SPLIT_OVER = 600


def clean(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sha1_of_trimmed(c: Column) -> Column:
    """Content key: SHA-1 of the trimmed text."""
    return F.sha1(F.trim(c))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, text)`` of all matches, counted from 0.  The pattern must not match the empty text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda acc, p: acc + F.length(p))

    def span(x: Column, i: Column) -> Column:
        start = total(between, i + 1) + total(found, i)
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text"))

    return F.transform(found, span)


def before(text: Column, pos: Column, width: int | None = None) -> Column:
    """The ``width`` characters before ``pos``, or all of them."""
    if width is None:
        return F.substring(text, F.lit(1), pos)
    return F.substring(text, F.greatest(pos - width, F.lit(0)) + 1, F.least(pos, F.lit(width)))


def after(text: Column, pos: Column, width: int | None = None) -> Column:
    """The ``width`` characters from ``pos`` on, or all of them."""
    return F.substring(text, pos + 1, F.lit(width) if width is not None else F.length(text))


def is_negated(text: Column, pos: Column) -> Column:
    """Whether a negation in the same clause stands up to 45 characters before ``pos``, without an exception in the 140 after it."""
    clause = F.regexp_replace(before(text, pos, lx.NEGATION_WINDOW), lx.CLAUSE_END, "")
    return clause.rlike(lx.NEGATION) & ~after(text, pos, lx.EXCEPTION_WINDOW).rlike(lx.EXCEPTION)


def any_match(text: Column, pattern: str, holds) -> Column:
    """Whether some match of the pattern has a property, given as a function of its span.

    A plain search comes first: most texts have no match, and spans are only made where there is one.
    """
    return F.when(text.rlike(pattern), F.exists(match_spans(text, pattern), holds)).otherwise(False)


def affirmative(text: Column, pattern: str) -> Column:
    """Whether some match is neither negated nor directed to the reader or speaker."""
    return any_match(text, pattern, lambda m: ~after(text, m["end"]).rlike(lx.SELF_RECIPIENT) & ~is_negated(text, m["start"]))


def positive_sharing(text: Column) -> Column:
    """The text affirms a sharing of something."""
    return affirmative(text, lx.SHARING)


def positive_collection(text: Column) -> Column:
    """The text affirms a collection of something."""
    return affirmative(text, lx.COLLECTION)


def implicit_sale(text: Column) -> Column:
    """The text affirms a sale of data that isn't being stopped."""
    return any_match(text, lx.SALE, lambda m: ~is_negated(text, m["start"]) & ~before(text, m["start"]).rlike(lx.SALE_STOPPED))


def clause_window(text: Column, start: Column, width: int) -> Column:
    """``width`` characters from ``start``, cut at the first sentence end."""
    w = after(text, start, width)
    return F.regexp_extract(w, r"(?s)^(.*?)(?:(?<=[a-z]{2})[.!?]\s.*)?$", 1)


def party_follows(text: Column, end: Column) -> Column:
    """A recipient is named in the window after ``end``."""
    w = clause_window(text, end, lx.PARTY_WINDOW)
    return w.rlike(lx.GENERIC) | w.rlike(lx.CATEGORY)


def has_first_party_anchor(text: Column) -> Column:
    """The text speaks of its own site or in the first person."""
    return text.rlike(lx.FIRST_PARTY)


def _party_collects(text: Column, party: str) -> Column:
    return any_match(
        text, party, lambda m: ~is_negated(text, m["start"]) & affirmative(clause_window(text, m["end"], lx.COLLECTS_WINDOW), lx.COLLECTION)
    )


def _tracker_of_party(text: Column, tracker: str) -> Column:
    def attributed(m: Column) -> Column:
        pre = before(text, m["start"], lx.NEGATION_WINDOW)
        return ~pre.rlike(lx.NEGATION) & ~pre.rlike(lx.NO_SUCH) & party_follows(text, m["end"])

    return any_match(text, tracker, attributed)


def third_party_collects(text: Column) -> Column:
    """Somebody other than the first party is said to collect."""
    anchored = has_first_party_anchor(text) & text.rlike(lx.DATA_NOUN)
    others = (
        _party_collects(text, lx.CATEGORY)
        | _tracker_of_party(text, lx.TRACKER_BY)
        | _tracker_of_party(text, lx.TRACKER_FROM)
        | (text.rlike(lx.THIRD_PARTY_SURFACE) & positive_collection(text))
    )
    return _party_collects(text, lx.GENERIC) | (anchored & others)


def machine_readable_kind(text: Column) -> Column:
    """Kind of registry file, '' for anything else."""
    return (
        F.when(text.rlike(lx.SELLERS_JSON), "sellers_json")
        .when(text.rlike(lx.TCF_GVL), "tcf_gvl")
        .when(text.rlike(lx.VENDORS_JSON), "vendors_json")
        .when(text.rlike(lx.ADS_TXT), "ads_txt")
        .otherwise("")
    )


def navigation_junk(text: Column) -> Column:
    """A row of capitalised words without a sentence end: at least three words, three fifths of them capitalised."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][\w'&-]*"), F.lit(0))
    caps = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return ~text.rlike("[.!?]") & (F.size(words) >= 3) & (caps >= F.lit(0.6) * F.size(words))


def informational_heading(text: Column) -> Column:
    """A heading such as "How we ..." that points elsewhere."""
    return F.trim(text).rlike(lx.ASKS_HEADING)


def platform_label(text: Column, role: Column) -> Column:
    """Store label: ``(has_label, shares, kind)``."""
    play = (role == "play_data_safety") | text.rlike(r"(?i)\bdata safety\b")
    none, yes = text.rlike(lx.NOTHING_SHARED), text.rlike(lx.MAY_SHARE)
    apple, tracks = text.rlike(r"(?i)\bapp privacy\b"), text.rlike(lx.TRACKS)
    some = lambda has, shares, kind: F.struct(F.lit(has).alias("has_label"), shares.alias("shares"), F.lit(kind).alias("kind"))
    return (
        F.when(play, some(True, ~none | yes, "play_data_safety"))
        .when(apple, some(True, tracks, "app_privacy"))
        .otherwise(some(False, F.lit(False), ""))
    )


def dedupe_adjacent(a: Column) -> Column:
    """Array without elements equal to the one before."""
    return F.filter(a, lambda x, i: (i == 0) | ~F.coalesce(x.eqNullSafe(F.get(a, i - 1)), F.lit(False)))


def split_sentences(text: Column) -> Column:
    """Parts of a text between sentence ends; blanks at the ends of parts are gone."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def sentence_segments(segments: Column) -> Column:
    """Segments, those over 600 characters split at sentence ends."""
    return F.flatten(F.transform(segments, lambda s: F.when(F.length(s) <= SPLIT_OVER, F.array(s)).otherwise(split_sentences(s))))


def reflowed(text: str) -> list[str]:
    """Segments of a text from its lines: joined until a blank line, a sentence end or 400 characters; shorter than 3 left out."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for line in [*(" ".join(x.split()) for x in text.split("\n")), ""]:
        if line:
            held.append(line)
            size += len(line) + (size > 0)
        if held and (not line or line[-1] in ".!?" or size >= MAX_SEGMENT):
            whole = " ".join(held)
            out += [whole] if size <= MAX_SEGMENT else re.split(r"(?<=[.!?;:])\s+", whole)
            held, size = [], 0
    return [s for s in out if len(s) >= 3]


def reflow(text: Column) -> Column:
    """Column function for ``reflowed``, over Arrow batches: a fold over lines in the JVM copies its array at every line."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: reflowed(t) if t is not None else None)

    return run(text)


def join_lead_in(prefix: Column, item: Column) -> Column:
    """List item after its lead-in."""
    p = F.rtrim(F.coalesce(prefix, F.lit("")))
    return F.when(p == "", item).when(p.rlike("[:.;]$"), F.concat_ws(" ", p, item)).otherwise(F.concat_ws(": ", p, item))


def purposes_of(text: Column) -> Column:
    """Sorted purposes whose cue words occur."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    tags = [
        F.when(F.expr("false") if not cues else _any_contains(padded, cues), F.lit(name)) for name, cues in lx.PURPOSE_CUES.items()
    ]
    return F.array_sort(F.array_compact(F.array(*tags)))


def _any_contains(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(cues[0]))
    for c in cues[1:]:
        out = out | F.contains(text, F.lit(c))
    return out


def purposes_or_other(text: Column) -> Column:
    """``purposes_of``, or ``other`` where there is none."""
    p = purposes_of(text)
    return F.when(F.size(p) == 0, F.array(F.lit("other"))).otherwise(p)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets given as arrays; 1 if both are empty, null counts as empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n)
