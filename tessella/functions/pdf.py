"""Text of simple PDF files, as markup for the HTML parser.

There is no PDF library here.  This reader handles what generators of policies
usually write: uncompressed or deflated content streams with literal or
hexadecimal strings in a one-byte encoding.  Anything else gives ''.
"""

from __future__ import annotations

import html
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import reflowed

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_OP = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESC = {b"n": b"\n", b"r": b"\n", b"t": b" ", b"b": b"", b"f": b""}


def _literal(tok: bytes) -> str:
    if tok[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", tok[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", tok[1:-1])) % 2 else "")).decode("cp1252", "replace")
    body = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1).isdigit() else _ESC.get(m.group(1), m.group(1)), tok[1:-1], flags=re.S)
    return body.decode("cp1252", "replace")


def pdf_text(data: bytes | None) -> str:
    """Lines of the text operators of all content streams in file order; '' for null and other files."""
    if not data or not data.startswith(b"%PDF-"):
        return ""
    out: list[str] = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" not in body:
            continue
        line, strings, array, last = "", [], False, 0.0
        for m in _OP.finditer(body):
            t = m.group(0)
            if t[:1] in b"(<":
                strings.append(_literal(t))
            elif t == b"[":
                array, strings = True, []
            elif t == b"]":
                array = False
            elif t[:1] in b"-.0123456789":
                last = float(t)
                if array and last < -200:  # a wide gap inside an array is a blank
                    strings.append(" ")
            elif t in (b"Tj", b"TJ"):
                line += "".join(strings)
                strings = []
            elif t in (b"'", b'"', b"T*", b"Td", b"TD", b"Tm", b"ET"):
                moved = t in (b"'", b'"', b"T*", b"ET") or t == b"Tm" or last != 0
                if moved and line.strip():
                    out.append(line)
                    line = ""
                if t in (b"'", b'"'):
                    line, strings = "".join(strings), []
            else:
                strings = []
        if line.strip():
            out.append(line)
        out.append("")
    return "\n".join(out).strip()


def pdf_markup(data: bytes | None, title: str | None = None) -> str:
    """Page of one paragraph per reflowed segment; '' if there is no text."""
    segs = reflowed(pdf_text(data))
    if not segs:
        return ""
    return f"<html><head><title>{html.escape(title or '')}</title></head><body>" + "".join(f"<p>{html.escape(s)}</p>" for s in segs) + "</body></html>"


def pdf_to_html(data: Column, title: Column) -> Column:
    """Column function for ``pdf_markup``."""

    @F.pandas_udf("string")
    def run(d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([pdf_markup(bytes(x) if x is not None else None, y) for x, y in zip(d, t)], dtype=object)

    return run(data, title)
