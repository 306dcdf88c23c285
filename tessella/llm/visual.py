"""Visually identical text with different characters (problem 8).

Two forms of a text are made.  ``visible`` undoes how characters are encoded
and keeps everything a reader sees: width variants, ligatures, composition,
look-alike letters of other scripts, kinds of space and invisible characters.
``folded`` is the comparison form: compatibility composed form (NFKC) of that,
fully case-folded.

Equal ``folded`` forms are the candidates; equal ``visible`` forms decide.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.scratch import materialize
from tessella.llm.util import digest, group_pairs, map_batches, maybe_broadcast

# Letters of other scripts that look the same as a Latin letter, chosen from the single-letter entries of the
# public Unicode confusables data (Unicode 16, as ICU 77 carries it) whose shapes a reader cannot tell apart.
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian, Georgian and Latin variants
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Ս": "U", "Տ": "S", "ჿ": "o", "ɡ": "g", "ɑ": "a", "ı": "ı",
    # Greek small letters and variants
    "α": "a", "ι": "i", "ρ": "p", "υ": "u", "ϒ": "Y", "Ϻ": "M",
    # Cyrillic letters out of use
    "Ѵ": "V", "ѵ": "v", "ҽ": "e", "Ӏ": "l",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z",
    "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B", "ꭵ": "i", "ꮁ": "r", "ꮃ": "w",
    "ꮓ": "z", "ꮩ": "v", "ꮪ": "s", "ꮯ": "c",
    # Coptic
    "ⲅ": "r", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⳑ": "L",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

#: Decompositions that change only how a character is encoded; super- and
#: subscripts, circled and squared characters and fractions look different.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
_LINE_ENDS = "\u0085  \x0b\x0c"


def _ignorable(c: int) -> bool:
    """Default-ignorable code points (Unicode, DerivedCoreProperties)."""
    return (
        c in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0)
        or 0x180B <= c <= 0x180F or 0x200B <= c <= 0x200F or 0x202A <= c <= 0x202E or 0x2060 <= c <= 0x206F
        or 0xFE00 <= c <= 0xFE0F or 0xFFF0 <= c <= 0xFFF8 or 0xE0000 <= c <= 0xE0FFF
    )


class _Table(dict):
    """Character map for ``str.translate``, filled as characters occur: one decision per distinct character."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if _ignorable(c):
            out = ""
        elif ch in LOOK_ALIKES:
            out = LOOK_ALIKES[ch]
        elif ch in _LINE_ENDS:
            out = "\n"
        elif unicodedata.category(ch) == "Zs" or ch == "\t":
            out = " "
        else:
            kind = unicodedata.decomposition(ch).partition(" ")[0]
            same = kind in _SAME_LOOK or 0xFB00 <= c <= 0xFB17 or 0x2160 <= c <= 0x217F or 0x132 <= c <= 0x133 or 0x1C4 <= c <= 0x1CC
            out = unicodedata.normalize("NFKC", ch) if same else ch
            if same and len(out) == 1 and out != ch:
                out = self[ord(out)]
        self[c] = out
        return out


_TABLE = _Table()
#: A character for which the forms may differ from the text: everything but ASCII without odd controls, and
#: composed Latin letters and punctuation that every normal form leaves alone.
_SUSPECT = re.compile("[^\x00-\x08\n\x0e-\x7f\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0130\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2010\u2012-\u2015\u2018-\u201e\u2020-\u2022\u2030\u20ac]")


def visible(text: str | None) -> str | None:
    """The text in one encoding of what a reader sees; case, accents, digits and line breaks stay.

    Null stays null, the empty text stays empty.
    """
    if text is None:
        return None
    if not _SUSPECT.search(text):
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))


def folded(text: str | None) -> str | None:
    """Comparison form: ``visible``, compatibility composed and fully case-folded; null stays null."""
    return None if text is None else _fold(visible(text))


def _fold(v: str) -> str:
    if v.isascii():
        return v.lower()
    if not _SUSPECT.search(v):
        return unicodedata.normalize("NFC", v.casefold())
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", v).casefold())


def _per_distinct(col: pa.Array, fn) -> list:
    """``fn`` once per distinct value of the batch."""
    enc = col.dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    made = [fn(x) for x in enc.dictionary.to_pylist()]
    return [None if i is None else made[i] for i in enc.indices.to_pylist()]


def _udf(fn):
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(_per_distinct(col, fn), pa.string())

    return run


def visible_form(col: Column | str) -> Column:
    """Column function for ``visible``."""
    return _udf(visible)(col)


def folded_form(col: Column | str) -> Column:
    """Column function for ``folded``."""
    return _udf(folded)(col)


def text_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, raw_key, visible_key, folded_key)``: 128-bit keys of the three forms; texts themselves aren't shuffled.

    Rows with a null text are left out; the empty text is a text.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    kind = dict(src.dtypes)["id"]

    def keys(t: str) -> tuple[bytes, bytes, bytes]:
        raw = t.encode("utf-8", "surrogatepass")
        k = digest(raw)
        v = visible(t)
        f = _fold(v)
        return k, k if v is t or v == t else digest(v.encode("utf-8", "surrogatepass")), digest(f.encode("utf-8", "surrogatepass"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        made = _per_distinct(b.column("text"), keys)
        cols = [pa.array([m[i] for m in made], pa.binary()) for i in range(3)]
        return pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", "raw_key", "visible_key", "folded_key"])

    return map_batches(src, fn, f"id {kind}, raw_key binary, visible_key binary, folded_key binary")


def same_look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``(id, class_id, n_members, n_spellings)``.

    ``class_id`` is the least id with the same visible form, ``n_spellings``
    the number of different strings among the members.
    """
    keys = materialize(text_keys(df, id_col, text_col), "keys")
    # exact copies are counted before classes are: a hot text shrinks to one row per task
    by_text = keys.groupBy("visible_key", "raw_key").agg(F.min("id").alias("lo"), F.count("*").alias("n"))
    cls = by_text.groupBy("visible_key").agg(F.min("lo").alias("class_id"), F.sum("n").alias("n_members"), F.count("*").alias("n_spellings"))
    return keys.join(cls, "visible_key").select("id", "class_id", "n_members", "n_spellings")


def same_look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_a, id_b)`` with ``id_a < id_b`` whose texts differ as strings but read the same.

    Equal strings aren't pairs.  Repeated ids give each pair once; null texts
    pair with nothing.
    """
    keys = materialize(text_keys(df, id_col, text_col), "keys")
    # exact copies are one spelling: a hot text shrinks to one row per task before anything is joined
    spellings = keys.groupBy("folded_key", "visible_key", "raw_key").agg(F.count("*").alias("copies"))
    mixed = spellings.groupBy("folded_key").agg(F.count("*").alias("c")).where("c > 1").select("folded_key")
    spellings = materialize(spellings.join(maybe_broadcast(mixed), "folded_key"), "spellings")
    pairs = materialize(group_pairs(spellings, "visible_key", "raw_key", ["raw_key"]).select("raw_key_a", "raw_key_b"), "spelling_pairs")
    # only then are members put in: what is written is what is asked for
    wanted = pairs.select(F.explode(F.array("raw_key_a", "raw_key_b")).alias("raw_key")).distinct()
    members = keys.join(maybe_broadcast(wanted), "raw_key", "left_semi").select("raw_key", "id").distinct()
    members = materialize(members, "members")
    both = (
        members.select(F.col("raw_key").alias("raw_key_a"), F.col("id").alias("x"))
        .join(maybe_broadcast(pairs), "raw_key_a")
        .join(maybe_broadcast(members.select(F.col("raw_key").alias("raw_key_b"), F.col("id").alias("y"))), "raw_key_b")
    )
    return both.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
