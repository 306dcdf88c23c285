"""Template residue and error pages (problem 4).

1. Every block of text gets an exact hash of its normalised form, in which
   numbers, addresses and dates are masked (``mainbody.masked``), and the marks
   that phrase and placeholder rules find in it.
2. Blocks are grouped by that hash over all sources.  A group is classified by
   the marks of its members, and a group without any that recurs on several
   hosts and stands mostly beside messages goes with them whatever it says.
3. A page is judged by the groups of its blocks: a placeholder or filler
   anywhere is enough; a message has to be all there is once the furniture of
   the page, found by the wrappers of ``mainbody``, is left out.

Statuses and error columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as sre_constants
from re import _parser as sre_parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.mainbody import HEADING, classify_leaves, page_hosts, page_shapes
from tessella.llm.util import maybe_broadcast
from tessella.operators.scratch import materialize

try:
    import ahocorasick
except ImportError:  # strings are looked up one by one
    ahocorasick = None

PLACEHOLDER, FILLER, MESSAGE, DETAIL = 2, 4, 8, 16
#: Share of a block's characters in sentences that are a message or go with one, for the block to be one.
MESSAGE_SHARE = 0.4
#: Hosts on which a line must recur, and share of its pages that must hold a message, to count as part of messages.
RECURS_HOSTS, RECURS_SHARE = 3, 0.5

# Unfilled placeholders of common template languages and hand-written drafts.
_PLACEHOLDER = re.compile(
    r"""\{\{\{?\s*[\w.$|-]+(?:\s+[\w.$|-]+)*\s*\}?\}\}      # {{name}}
      | \{%-?\s*\w[^%]*%\}                                  # {% name %}
      | \[\[\s*[\w.-]+\s*\]\]                               # [[name]]
      | \$\{\s*[\w.]+\s*\}                                  # ${name}
      | \#\{\s*[\w.]+\s*\}                                  # #{name}
      | <%[=-]?\s*\w[^%>]*%>                                # <%= name %>
      | %%\s*\w+\s*%%                                       # %%NAME%%
      | (?<!\w)%[A-Z][A-Z_]{2,}%(?!\w)                      # %NAME%
      | (?<![\w%])%(?:s|d|\(\w+\)s)(?![\w%])                # %s
      | (?<![\w/])__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)         # __NAME__
      | (?<!\bis\ )(?<!are\ )(?<!\ban\ )(?<!the\ )(?<!was\ )(?<!left\ )(?<![\w-])undefined(?=\ (?:may|shares?|and|or|covers|through|with|when|if|until|unless|every|each|as|once|before|after|whenever|while|in|to|by|on|for|acts|receives|keeps|uses|at|from|will|can|must|does|during|within|under)\b)
      | \[object\ Object\] | (?<!\w)\[(?:undefined|null|NaN)\]
      | \[\s*[●•▪■_.…x]{1,}\s*\]                            # [●]
      | \[\s*(?:insert|enter|add|your|my|company|organi[sz]ation|business|website|site|app|legal|date|effective|e-?mail|contact
             |address|country|state|phone|url|firma|firmenname|ihre?|name\ der|votre|nom\ de|su\ |nombre\ de)\b[^\]\n]{0,60}\]
      | \(\s*(?:insert|fill\ in|enter|to\ be\ (?:completed|filled\ in))\b[^)\n]{0,60}\)
      | <\s*[A-Z][A-Z _-]{2,}(?:HERE|NAME|DATE|EMAIL|ADDRESS)\s*>
      | (?<!\w)X{4,}(?!\w)
      | (?<!\w)(?:TODO|TBD|FIXME|TBC)(?!\w)(?=\s*[:\])]|\s*$)
      | (?<!\w)_{4,}(?!\w)
    """,
    re.X | re.I,
)
# These are case-sensitive whatever the flags above.
_CASED = re.compile(r"XXXX|%[A-Z]|__[A-Z]|<\s*[A-Z]|TODO|TBD|FIXME|TBC|\[|\(|\{|\$|#|%s|%d|%\(|<%|____|undefined")
_MAY_HOLD = re.compile(r"[\[{$%<_]|XXXX|\((?:insert|fill|enter|to be)|TODO|TBD|TBC|FIXME|undefined", re.I)
# Words right before a token that is explained to the reader.
_EXPLAINS = re.compile(
    r"(?:\b(?:macros?|tokens?|variables?|placeholders?|merge fields?|fields?|tags?|codes?|symbols?|such as|like|for example|for instance|e\.g\.|called|named|"
    r"platzhalter|variablen?|balises?|marcador(?:es)?|wie|comme|como)[\s,:;\"'\u201c\u201e\u00ab(]*)$",
    re.I,
)
# Words of the customary pseudo-Latin filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis "
    "nostrud exercitation ullamco laboris laborum nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim est vivamus suspendisse vestibulum "
    "pellentesque curabitur pretium gravida rhoncus tellus augue ornare sapien viverra porta lectus mattis bibendum molestie".split()
)
# Phrases of draft and demonstration text.
_FILLER = re.compile(
    r"lorem ipsum|blindtext|blind text|\bfaux texte\b|texto de relleno|\btexte de remplissage\b|placeholder (?:text|copy|content|paragraph)|filler text|"
    r"\b(?:dummy|sample) (?:text|copy|section|paragraph|sentence|heading|content|page)\b|your (?:text|content|copy|title|headline) (?:goes )?here|"
    r"(?:text|content|copy) (?:goes|will go) here|(?:content|text) for this (?:block|section|page) has not been|double-click to edit|"
    r"click (?:here )?to edit this text|\basdf\b|\bqwer(?:ty)?\b.*\basdf\b|"
    r"replace this (?:text|paragraph|sample)|the writer will supply|write your (?:text|content)|hier (?:steht|entsteht) (?:ein|ihr) \w*text",
    re.I,
)
# Headings nobody has filled in, as whole sentences; and words typed again and again.
_UNTITLED = re.compile(r"(?:page title|heading (?:one|two|three|\d)|title here|untitled(?: document| page)?|new page|sample page|test page)", re.I)
_REPEATED = re.compile(r"\b(\w{3,})(?: \1){2,}\b(?<!very very very)", re.I)
# Error, blocking and script messages in English, German, French and Spanish.
_MESSAGE = re.compile(
    r"\bnot found\b|\b(?:page|link|address|document|file|resource|site)\b.{0,30}\b(?:does not exist|doesn't exist|no longer (?:exists|available)|"
    r"has expired|could not be found|cannot be (?:found|shown|displayed)|can't be (?:found|reached|displayed))|"
    r"(?:cannot|can not|can't|could not|couldn't) find (?:what|the page|that page|this page)|^[\W\d]*(?:(?:error|notice|warning|status)[\W\d]+)?gone[\W\d]*$|"
    r"internal server error|bad gateway|bad request|gateway time-?out|service (?:temporarily |is )?unavailable|temporarily unavailable|"
    r"\b(?:http )?error (?:code )?[45]\d\d\b|^[45]\d\d(?: error)?$|something (?:went|has gone) wrong|an? (?:unexpected |internal |unknown )?error (?:has )?occurred|"
    r"access .{0,30}\bdenied\b|\bforbidden\b|(?:request|access|you|ip) (?:was|has been|have been|is) blocked|too many requests|rate limit exceeded|"
    r"prove .{0,30}\bhuman\b|are you (?:a )?(?:human|robot)|not a robot|\bcaptcha\b|verify(?:ing)? (?:that )?you are|checking your browser|"
    r"not available in your (?:country|region|location)|(?:session|link|request) (?:has )?(?:timed out|expired)|connection (?:timed out|refused|reset)|"
    r"error establishing|database connection|fatal error|uncaught exception|unhandled exception|exception (?:at|in)\b|\w+exception\b|stack ?trace|traceback|"
    r"under (?:maintenance|construction)|down for maintenance|"
    r"seite .{0,20}nicht (?:gefunden|verfügbar|vorhanden)|nicht gefunden|zugriff (?:verweigert|gesperrt)|serverfehler|wartungsarbeiten|sitzung .{0,20}abgelaufen|"
    r"\bintrouvable\b|n'existe (?:pas|plus)|accès (?:refusé|interdit)|erreur (?:interne|du serveur)|session .{0,20}expiré|en maintenance|"
    r"no (?:se )?(?:ha )?(?:encontrad[oa]|encuentra)|no encontrad[oa]|acceso (?:denegado|prohibido)|error (?:interno|del servidor)|en mantenimiento|sesión .{0,20}caducad|"
    r"(?:enable|activate|turn on|switch on|allow|needs?|requires?|required|activer|activez|aktivieren|active|activar|habilit\w+|einschalten)\b.{0,40}\b(?:java ?script|js|scripts?|scripting)\b|"
    r"\b(?:java ?script|js|scripts?|scripting)\b.{0,40}\b(?:required|disabled|necessary|switched off|turned off|not enabled|enable|aktivieren|activ\w+|désactivé|deaktiviert|desactivado|erforderlich|nécessaire|necesario)\b|"
    r"\bwithout java ?script\b|\bnoscript\b",
    re.I,
)
# Lines that go with such messages.
_DETAIL = re.compile(
    r"^(?:ray(?: id)?|reference|incident|request id|error id|trace id|code|ref)\b.{0,4}[\w#.:-]*\d[\w.-]*$|try again|please wait|check the (?:address|url|spelling)|"
    r"typing errors|moved or (?:deleted|removed)|(?:start|home) ?page or use the search|go (?:back )?to the (?:start|home)|(?:is|was) a mistake|"
    r"contact the (?:owner|administrator|webmaster)|server (?:answered|responded|returned)|return to (?:the )?home|reload|refresh the page|"
    r"später (?:erneut|noch einmal)|zur startseite|überprüfen sie|prüfen sie die adresse|vérifiez l.adresse|réessayer|réessayez|retour à l.accueil|"
    r"inténte(?:lo)?|compruebe la dirección|volver al inicio",
    re.I,
)
# A sentence about messages rather than one.
_ABOUT = re.compile(
    r"\b(?:our server (?:logs|records)|we (?:log|record|store|keep|collect|use|share|may|do|will)|may contain|logs? the|describes?|explains?|for \d+ days|cookies? (?:are|is)|when a page|if a page)\b",
    re.I,
)


def _alternatives(source: str) -> list[str]:
    """Parts of a pattern between its outermost bars."""
    out, depth, start, k, within = [], 0, 0, 0, False
    while k < len(source):
        c = source[k]
        if c == "\\":
            k += 1
        elif within:
            within = c != "]"
        elif c == "[":
            within = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(source[start:k])
            start = k + 1
        k += 1
    return [*out, source[start:]]


def _literals(parsed) -> frozenset[str] | None:
    """Lower-case strings of which any match of a parsed pattern holds at least one; None if there are none such."""
    sets: list[frozenset[str]] = []
    run = ""
    for op, arg in [*parsed, (None, None)]:
        if op is sre_constants.LITERAL:
            run += chr(arg)
            continue
        if op is sre_constants.AT:  # of no width
            continue
        if run:
            sets.append(frozenset([run.lower()]))
            run = ""
        inner = None
        if op is sre_constants.BRANCH:
            each = [_literals(x) for x in arg[1]]
            inner = None if None in each else frozenset().union(*each)
        elif op is sre_constants.SUBPATTERN:
            inner = _literals(arg[3])
        elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0] > 0:
            inner = _literals(arg[2])
        if inner:
            sets.append(inner)
    sets = [x for x in sets if min(map(len, x)) > 1]
    return max(sets, key=lambda x: (min(map(len, x)), -len(x))) if sets else None


class _AnyOf:
    """Search for a pattern, case ignored, that tries an alternative only on texts that hold one of the strings it can't match without.

    The strings are derived from the alternatives, so nothing the whole pattern finds is lost; looking them up is far cheaper than searching.
    """

    def __init__(self, pattern: re.Pattern):
        self.pattern, self.always, self.by = pattern, [], {}
        for alt in _alternatives(pattern.pattern):
            search = re.compile(alt, re.I).search
            lits = _literals(sre_parser.parse(alt, re.I))
            if lits is None:
                self.always.append(search)
            for x in lits or ():
                self.by.setdefault(x, []).append(search)
    def search(self, text: str, low: str) -> bool:
        """Whether ``text``, in lower case ``low``, has a match."""
        return self.among(_held(low), text)

    def among(self, held: Iterable[str], text: str) -> bool:
        """Whether ``text`` has a match, given which of all strings it holds."""
        if not text.isascii() and _FOLDS.search(text):
            return bool(self.pattern.search(text))
        for x in held:
            for f in self.by.get(x, ()):
                if f(text):
                    return True
        for f in self.always:
            if f(text):
                return True
        return False


# Letters that patterns take for i or s, but lower case doesn't.
_FOLDS = re.compile("[\u0130\u0131\u017f]")
_FIND_FILLER, _FIND_MESSAGE, _FIND_DETAIL = _AnyOf(_FILLER), _AnyOf(_MESSAGE), _AnyOf(_DETAIL)
#: Strings of which any heading that nobody has filled in holds one.
_UNTITLED_STRINGS = frozenset(("page title", "heading ", "title here", "untitled", "new page", "sample page", "test page"))
_STRINGS = sorted({x for finder in (_FIND_FILLER, _FIND_MESSAGE, _FIND_DETAIL) for x in finder.by} | _UNTITLED_STRINGS)
if ahocorasick is not None:  # all strings in one pass over the text
    _AUTOMATON = ahocorasick.Automaton()
    for _x in _STRINGS:
        _AUTOMATON.add_word(_x, _x)
    _AUTOMATON.make_automaton()


def _held(low: str) -> set[str]:
    """Which of the strings of all patterns a lower-case text holds."""
    if ahocorasick is not None:
        return {x for _, x in _AUTOMATON.iter(low)}
    return {x for x in _STRINGS if x in low}


_TOKENS = re.compile(r"\w+")


def _placeholder(text: str) -> int:
    if not ("[" in text or "{" in text or "<" in text or "%" in text or "__" in text or "(" in text or "XXXX" in text or "TODO" in text or "undefined" in text
            or "TBD" in text or "TBC" in text or "FIXME" in text):
        return 0
    if not _MAY_HOLD.search(text):
        return 0
    for m in _PLACEHOLDER.finditer(text):
        if _CASED.search(m.group(0)) and m.group(0).lower() not in ("[on]", "[off]") and not _EXPLAINS.search(text[max(0, m.start() - 40) : m.start()]):
            return PLACEHOLDER
    return 0


def _latin(words: list[str]) -> int:
    """FILLER if words of pseudo-Latin make up most of a text or a stretch of it."""
    latin = sum(w in _LATIN for w in words)
    if (latin >= 5 and latin >= 0.5 * len(words)) or (latin >= 2 and latin >= 0.8 * len(words) and len(words) >= 3):
        return FILLER
    if latin >= 8:  # a stretch of filler inside other text
        run = best = 0
        for w in words:
            run = run + 1 if w in _LATIN else 0
            best = max(best, run)
        if best >= 6:
            return FILLER
    return 0


_SENTENCES, _STOPS = re.compile(r"(?<=[.!?:])\s+|\n"), re.compile(r"(?<=[.!?])\s+|\n")


def _kind(sentence: str, held: Iterable[str]) -> int:
    """MESSAGE, DETAIL or 0 of one sentence that holds these strings."""
    bare = sentence.strip(" .:!")
    return MESSAGE if _FIND_MESSAGE.among(held, bare) else DETAIL if _FIND_DETAIL.among(held, bare) else 0


def flag_line(text: str) -> int:
    """Bits PLACEHOLDER, FILLER, MESSAGE, DETAIL of one block of text of any length; 0 for the empty text.

    Placeholders and filler count wherever they stand.  A block is a message,
    or the detail of one, if sentences that are make up ``MESSAGE_SHARE`` of
    its characters and none of it talks about messages.
    """
    # short blocks recur on many pages and are judged once per worker
    return _flag_once(text) if len(text) <= 200 else _flag(text)


def _flag(text: str) -> int:
    low = text.lower()
    words = _TOKENS.findall(low)
    distinct = set(words)
    held = _held(low)
    bits = _placeholder(text)
    if not _LATIN.isdisjoint(distinct):
        bits |= _latin(words)
    if not bits & FILLER and (_FIND_FILLER.among(held, text) or (len(words) - len(distinct) > 1 and _REPEATED.search(text)) or _untitled(text, held)):
        bits |= FILLER
    whole = _kind(text, held)
    if not whole or _ABOUT.search(text):
        return bits
    sentences = [s for s in _STOPS.split(text) if s]
    if len(sentences) == 1:
        return bits | whole
    kinds = [_kind(s, _held(s.lower())) for s in sentences]
    size = sum(map(len, sentences))
    if sum(len(s) for s, k in zip(sentences, kinds) if k) >= MESSAGE_SHARE * size:
        bits |= MESSAGE if MESSAGE in kinds or whole == MESSAGE else DETAIL
    return bits


def _untitled(text: str, held: set[str]) -> bool:
    """Some sentence is a heading that nobody has filled in."""
    return not held.isdisjoint(_UNTITLED_STRINGS) and any(_UNTITLED.fullmatch(s.strip(" .:!")) for s in (text, *_SENTENCES.split(text)))


@lru_cache(maxsize=200_000)
def _flag_once(text: str) -> int:
    return _flag(text)


def residue_documents(
    pages: DataFrame,
    docs: DataFrame,
    id_col: str = "doc_id",
    raw_col: str = "raw",
    segments_col: str = "segments",
    url_col: str = "url",
) -> DataFrame:
    """``(doc_id, reason)`` of the pages to exclude; reason is placeholder, filler or message, the first that holds.

    A placeholder or a passage of filler anywhere in a page's text is enough.
    A page is a message if every block of its main body but headings is one or
    goes with one, and at least one block is.  Pages without any text aren't
    cases.  A repeated id gives one row.
    """
    shaped = page_shapes(pages, id_col, raw_col, segments_col, flag_line)
    leaf = materialize(classify_leaves(shaped, page_hosts(docs, id_col, url_col)).select("id", "host", "text_key", "flags", "main_body"), "leaves")
    at = materialize(_with_class(leaf), "marked")
    near = at.groupBy("id").agg(F.bool_or(F.expr(f"main_body AND marks & {MESSAGE} > 0")).alias("message")).where("message").select("id")
    # groups without marks: those that stand beside messages are counted over all pages
    unknown = at.where("main_body AND marks = 0 AND NOT heading")
    beside = materialize(unknown.join(maybe_broadcast(near), "id", "left_semi").groupBy("text_key").agg(F.count("*").alias("m")), "beside")
    total = unknown.join(maybe_broadcast(beside.select("text_key")), "text_key", "left_semi").groupBy("text_key", "host").agg(F.count("*").alias("n"))
    total = total.groupBy("text_key").agg(F.count("*").alias("hosts"), F.sum("n").alias("n"))
    recurring = beside.join(total, "text_key").where(f"hosts >= {RECURS_HOSTS} AND m >= {RECURS_SHARE} * n").select("text_key", F.lit(DETAIL).alias("recurs"))
    page = (
        at.join(maybe_broadcast(recurring), "text_key", "left")
        .withColumn("marks", F.expr("marks | coalesce(recurs, 0)"))
        .groupBy("id").agg(
            F.bool_or(F.expr(f"marks & {PLACEHOLDER} > 0")).alias("placeholder"), F.bool_or(F.expr(f"marks & {FILLER} > 0")).alias("filler"),
            F.bool_or(F.expr(f"main_body AND marks & {MESSAGE} > 0")).alias("message"),
            F.bool_or(F.expr(f"main_body AND NOT heading AND marks & {MESSAGE | DETAIL} = 0")).alias("other"),
        )
    )
    reason = F.expr("CASE WHEN placeholder THEN 'placeholder' WHEN filler THEN 'filler' WHEN message AND NOT other THEN 'message' END")
    return page.select(F.col("id").alias("doc_id"), reason.alias("reason")).where("reason IS NOT NULL")


def _with_class(leaf: DataFrame) -> DataFrame:
    """Leaves with the class of their group, the marks that half of its members have: ``(id, host, text_key, main_body, heading, marks)``."""
    bits = (PLACEHOLDER, FILLER, MESSAGE, DETAIL)
    found = leaf.where(f"flags & {sum(bits)} <> 0").groupBy("text_key").agg(*[F.count_if(F.expr(f"flags & {b} > 0")).alias(f"n{b}") for b in bits])
    found = materialize(found, "groups")
    size = leaf.join(maybe_broadcast(found.select("text_key")), "text_key", "left_semi").groupBy("text_key").agg(F.count("*").alias("n"))
    marks = F.expr(" | ".join(f"if(2 * n{b} >= n, {b}, 0)" for b in bits)).alias("marks")
    groups = found.join(size, "text_key").select("text_key", marks)
    own = leaf.select("id", "host", "text_key", "main_body", F.expr(f"flags & {HEADING} > 0").alias("heading"))
    return own.join(maybe_broadcast(groups), "text_key", "left").withColumn("marks", F.coalesce("marks", F.lit(0)))
