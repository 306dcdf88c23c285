"""Page boilerplate and main content (problem 5): wrapper induction per host.

1. Every page is parsed to a tree of block elements.  Its *shape* is that tree
   without texts, with runs of equal leaves as one repeating leaf; a page is
   then a shape key and, per leaf, its place in the shape and a hash of its
   text with numbers, addresses and dates masked.  Nothing else of a page is shuffled.
2. The distinct shapes of a host are aligned by simple tree matching (Yang,
   "Identifying syntactic differences between two programs", 1991) and merged
   into one template tree, the host's wrapper.  Pages of equal shape are
   counted first, so a host's work depends on how its markup varies and not
   on how many pages it has.
3. For each template node, how often two of its texts coincide on different
   pages of the host separates constant nodes (template) from varying slots
   (content).  Hosts with few pages lean on all hosts with like markup.
4. The main body of a host is the deepest template node below which most of its
   varying prose lies.  The page title is a signal beside that: of nested
   nodes, the one that holds the title directly is the body.  On pages without
   that node, or where several blocks have its markup, the node that holds the page's
   title takes its place; where there is none, each slot goes by itself.  A block nested in the body stays only
   if its slot varies and reads like prose.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.util import maybe_broadcast, sliced_join, work_partitions
from tessella.operators.scratch import materialize

_TOKEN = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<", re.S)
_ATTR = re.compile(r"\b(class|id|role|data-[\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.I)
# Months as dates name them, in English, German, French and Spanish.
_MONTHS = frozenset(
    m + end
    for m in (
        "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
        "januar februar m\xe4rz mai juni juli oktober dezember janvier f\xe9vrier mars avril juin juillet ao\xfbt septembre octobre novembre d\xe9cembre "
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
    ).split()
    for end in ("", ",", ".")
)
_HEX = re.compile(r"[0-9a-f]*\d[0-9a-f]*")
# Kinds of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split()
)
_SKIP = frozenset("script style noscript template svg title iframe object textarea select".split())
_IN_HEAD = frozenset("html base link meta script style noscript template title".split())
_LISTS = frozenset("ul ol dl".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
}


class Node:
    """Block element: label, parent, children in page order; a leaf also has text."""

    __slots__ = ("label", "tag", "parent", "kids", "text", "link")

    def __init__(self, label: str, tag: str, parent: Node | None):
        self.label, self.tag, self.parent = label, tag, parent
        self.kids: list[Node] = []
        self.text: str | None = None
        self.link = False


def parse(raw: str) -> tuple[Node, list[Node], str]:
    """Tree of block elements, its text leaves in page order, and the page's title.

    Inline markup is part of its block's text, unclosed elements end where
    HTML closes them, scripts and styles are skipped.
    """
    root = Node("#", "#", None)
    cur, leaves, title = root, [], ""
    run: list[str] = []
    linked = False
    depth_skip = ""
    in_head = False

    def flush() -> None:
        nonlocal linked
        if run:
            t = _SPACE.sub(" ", html.unescape("".join(run)) if any("&" in r for r in run) else "".join(run)).strip()
            run.clear()
            if t:
                if cur.kids or cur.text is not None or cur is root:  # text beside blocks
                    leaf = Node("#text", "#text", cur)
                    cur.kids.append(leaf)
                else:
                    leaf = cur
                leaf.text, leaf.link = t, linked
                leaves.append(leaf)
        linked = False

    for m in _TOKEN.finditer(raw):
        close, tag, attrs, text = m.groups()
        if text is not None:
            if depth_skip == "title" and not title:
                title = _SPACE.sub(" ", html.unescape(text)).strip()
            if not depth_skip and in_head and not text.isspace():
                in_head = False
            if not depth_skip and not in_head:
                run.append(text)
            continue
        if tag is None:
            if not depth_skip and m.group(0) == "<":
                run.append("<")
            continue
        tag = tag.lower()
        if depth_skip:
            if close and tag == depth_skip:
                depth_skip = ""
            continue
        if tag == "head":
            in_head = not close
            continue
        # a head that is never closed ends with the first element that can't stand in one
        in_head = in_head and tag in _IN_HEAD
        if tag in _SKIP:
            if not close and not attrs.endswith("/"):
                depth_skip = tag
            continue
        if tag in _INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a" and not close:
                linked = True
            continue
        if tag in ("html", "body"):
            continue
        flush()
        if close:
            up = cur
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                cur = up.parent
        else:
            while cur is not root and tag in _CLOSED_BY.get(cur.tag, ()):
                cur = cur.parent
            label = tag
            if attrs:
                at = _ATTR.findall(attrs)
                if at:
                    label = _family(tag + "." + ".".join(sorted((a + "=" + (b or c or d)) if a != "class" else (b or c or d) for a, b, c, d in at)))
            if cur.text is not None and not cur.kids:  # the block's own text becomes its first child
                leaf = Node("#text", "#text", cur)
                leaf.text, leaf.link, cur.text = cur.text, cur.link, None
                leaves[-1] = leaf
                cur.kids.append(leaf)
            node = Node(label, tag, cur)
            cur.kids.append(node)
            if tag not in _VOID:
                cur = node
    flush()
    return root, leaves, title


def allow_depth() -> None:
    """Let functions over trees recur as deep as markup nests; they are plain Python calls, which take no stack of the process."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))


# A shape is a nested tuple (label, (shape, ...)); a template node adds what the alignment gathers.


def shape_of(root: Node, title: str) -> tuple[tuple, dict[int, int]]:
    """Collapsed shape of a page and, for each text leaf by ``id()``, its preorder place in the shape.

    Equal text leaves of one parent are one repeating leaf and equal lists one
    list; leaves come first, in the order of their labels, then lists, then
    containers in page order.  The leaf that repeats the page title counts as
    a heading whatever its tag.
    """
    place: dict[int, int] = {}
    count = 0

    def build(nodes: list[Node], label: str) -> tuple:
        nonlocal count
        count += 1
        groups: dict[str, list[Node]] = {}
        boxes: list[list[Node]] = []
        own: list[Node] = []
        for n in nodes:
            if n.text is not None and not n.kids:
                own.append(n)
            for k in n.kids:
                if k.kids:
                    if k.tag in _LISTS:
                        groups.setdefault("~" + k.label, []).append(k)
                    else:
                        boxes.append([k])
                elif k.text is not None:
                    groups.setdefault("h1" if k.text == title else k.label, []).append(k)
        for n in own:
            place[id(n)] = count - 1
        kids = []
        for lab in sorted(groups):
            if lab[0] == "~":
                kids.append(build(groups[lab], lab[1:]))
            else:
                count += 1
                for k in groups[lab]:
                    place[id(k)] = count - 1
                kids.append((lab, ()))
        for b in boxes:
            kids.append(build(b, b[0].label))
        return (label, tuple(kids))

    return build([root], "#"), place


class Slot:
    """Template node."""

    __slots__ = ("label", "kids", "weight", "no")

    def __init__(self, label: str):
        self.label, self.kids, self.weight, self.no = label, [], 0, -1


def _match(a: tuple, b: Slot, memo: dict) -> int:
    """Simple tree matching: number of node pairs in the best order-preserving mapping below equal labels."""
    if a[0] != b.label:
        return 0
    key = (id(a), id(b))
    got = memo.get(key)
    if got is None:
        ak, bk = a[1], b.kids
        row = [0] * (len(bk) + 1)
        for x in ak:
            diag = 0
            for j, y in enumerate(bk, 1):
                up = row[j]
                row[j] = max(up, row[j - 1], diag + (_match(x, y, memo) if x[0] == y.label else 0))
                diag = up
        got = memo[key] = row[-1] + 1
    return got


def _aligned(a: tuple, b: Slot, memo: dict) -> list[tuple[int, int]]:
    """Children of ``a`` and ``b`` mapped to each other by the best matching."""
    ak, bk = a[1], b.kids
    n, m = len(ak), len(bk)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            w = _match(ak[i - 1], bk[j - 1], memo)
            t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + w if w else 0)
    out, i, j = [], n, m
    while i and j:
        if t[i][j] == t[i - 1][j]:
            i -= 1
        elif t[i][j] == t[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: tuple, b: Slot, weight: int, memo: dict | None = None) -> None:
    """Merge shape ``a``, seen ``weight`` times, into template ``b``; unmatched nodes are inserted in order."""
    memo = {} if memo is None else memo
    b.weight += a[2] if len(a) > 2 else weight
    pairs = _aligned(a, b, memo)
    mate = {i: b.kids[j] for i, j in pairs}
    at = 0
    fresh = []
    for i, x in enumerate(a[1]):
        if i in mate:
            at = b.kids.index(mate[i]) + 1
        else:
            s = Slot(x[0])
            b.kids.insert(at, s)
            fresh.append((x, s))
            at += 1
    for i, s in mate.items():
        merge(a[1][i], s, weight, memo)
    for x, s in fresh:
        merge(x, s, weight, memo)


def dump_template(b: Slot) -> str:
    """Template as text; inverse of ``load_template``."""
    out: list[str] = []
    stack: list = [b]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("\x02")
        else:
            out.append(f"{x.label}\x03{x.weight}\x01")
            stack.append(None)
            stack.extend(reversed(x.kids))
    return "".join(out)


def load_template(s: str) -> tuple:
    """Template as a shape whose nodes carry their weights."""
    return load(s, True)


def places(a: tuple, b: Slot) -> list[int]:
    """Template node number for each node of shape ``a`` in preorder."""
    memo: dict = {}
    out: list[int] = []

    def walk(x: tuple, s: Slot | None) -> None:
        out.append(-1 if s is None else s.no)
        mate = {i: s.kids[j] for i, j in _aligned(x, s, memo)} if s is not None else {}
        for i, y in enumerate(x[1]):
            walk(y, mate.get(i))

    walk(a, b)
    return out


_CONTROL = {1: "", 2: "", 3: ""}


def dump(shape: tuple) -> str:
    """Shape as text; labels hold none of the three control characters."""
    out: list[str] = []
    stack: list = [shape]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("\x02")
        else:
            out.append(x[0].translate(_CONTROL) + "\x01")
            stack.append(None)
            stack.extend(reversed(x[1]))
    return "".join(out)


def load(s: str, weighted: bool = False) -> tuple:
    """Inverse of ``dump``, or of ``dump_template``."""
    stack: list[tuple[str, list]] = [("", [])]
    a = 0
    for j, c in enumerate(s):
        if c == "\x01":
            stack.append((s[a:j], []))
            a = j + 1
        elif c == "\x02":
            lab, kids = stack.pop()
            if weighted:
                lab, _, w = lab.partition("\x03")
                stack[-1][1].append((lab, tuple(kids), int(w)))
            else:
                stack[-1][1].append((lab, tuple(kids)))
            a = j + 1
    return stack[0][1][0]


def masked(text: str) -> str:
    """A text with numbers, addresses and dates masked, blanks and case evened out."""
    t = text.lower()
    if "@" in t or "://" in t or "www." in t:
        t = _ADDRESS.sub("@", t)
    t = _DIGITS.sub("#", t)
    words = t.split()
    if "#" in t and not _MONTHS.isdisjoint(words):
        # a month beside a number is a date, and so are the numbers around it
        out: list[str] = []
        for k, w in enumerate(words):
            near = words[max(0, k - 2) : k] + words[k + 1 : k + 3]
            if (w in _MONTHS and any(x[0] == "#" for x in words[max(0, k - 1) : k] + words[k + 1 : k + 2] + [x for x in near if "de" in near])) or (
                w[0] == "#" and len(w) <= 4 and not _MONTHS.isdisjoint(near)
            ):
                if not out or out[-1] != "#":
                    out.append("#")
            elif not (w == "de" and out and out[-1] == "#"):
                out.append(w)
        words = out
    return " ".join(words)


#: Flag of a leaf that is a heading or repeats the page title; other bits are the caller's.
HEADING = 1
_LEAF = {"place": pa.int32(), "text_key": pa.int64(), "size": pa.int32(), "link": pa.bool_(), "seg_pos": pa.int32(), "flags": pa.int32()}
PAGE_SCHEMA = "id {kind}, shape string, leaves array<struct<place int, text_key bigint, size int, link boolean, seg_pos int, flags int>>"


def _segment_positions(texts: list[str], segments: list[str]) -> list[int]:
    """Position among ``segments`` of each leaf text, in order; -1 where there is none."""
    if texts == segments:
        return list(range(len(texts)))
    out, j = [], 0
    for t in texts:
        k = j
        while k < len(segments) and _SPACE.sub(" ", segments[k] or "").strip() != t:
            k += 1
        if k < len(segments):
            out.append(k)
            j = k + 1
        else:
            out.append(-1)
    return out


def page_shapes(df: DataFrame, id_col: str, raw_col: str, segments_col: str, flagger=None) -> DataFrame:
    """Step 1: ``(id, shape, leaves)`` per page.

    ``flagger(text)`` may add bits above ``HEADING`` to each leaf's flags.  A page whose markup is
    null, or has no text, yields its segments as leaves of the root; segments
    that no leaf of the markup equals are appended in the same way.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw"), F.col(segments_col).alias("segments")).where("id IS NOT NULL")
    kind = dict(src.dtypes)["id"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_depth()
        for b in batches:
            shapes: list[str] = []
            ends = [0]
            cols: dict[str, list] = {c: [] for c in _LEAF}
            place_, key, size, link, seg_pos, flags = cols.values()
            for raw, segs in zip(b.column("raw").to_pylist(), b.column("segments").to_pylist()):
                root, ls, title = parse(raw or "")
                segs = segs or []
                pos = _segment_positions([x.text for x in ls], segs)
                missing = sorted(set(range(len(segs))) - set(pos)) if len(pos) != len(segs) or -1 in pos else []
                for k in missing:
                    if segs[k]:
                        x = Node("#text", "#text", root)
                        x.text = segs[k]
                        root.kids.append(x)
                        ls.append(x)
                        pos.append(k)
                shape, place = shape_of(root, title)
                shapes.append(dump(shape))
                for x in ls:
                    t = x.text
                    place_.append(place.get(id(x), 0))
                    key.append(xxhash.xxh3_64_intdigest(masked(t)) - (1 << 63))
                    size.append(len(t))
                    link.append(x.link)
                    flags.append((flagger(t) if flagger else 0) | (HEADING if x.tag in _HEADINGS or t == title else 0))
                seg_pos += pos
                ends.append(len(size))
            leaves = pa.StructArray.from_arrays([pa.array(cols[c], t) for c, t in _LEAF.items()], fields=[pa.field(c, t) for c, t in _LEAF.items()])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shapes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaves)], names=["id", "shape", "leaves"])

    return src.mapInArrow(fn, PAGE_SCHEMA.format(kind=kind))


def _family(label: str) -> str:
    """Label without generated parts, so that like markup of different hosts falls together."""
    return _HEX.sub("#", label)


def _nodes(shape: tuple) -> tuple[list[str], list[int]]:
    """Labels and parents of a shape's nodes in preorder."""
    labels: list[str] = []
    parents: list[int] = []
    stack: list[tuple[tuple, int]] = [(shape, -1)]
    while stack:
        x, up = stack.pop()
        k = len(labels)
        labels.append(x[0])
        parents.append(up)
        stack.extend((y, k) for y in reversed(x[1]))
    return labels, parents


def _slot(x: tuple) -> Slot:
    top = Slot(x[0])
    stack = [(x, top)]
    while stack:
        y, s = stack.pop()
        s.weight = y[2]
        for k in y[1]:
            s.kids.append(Slot(k[0]))
            stack.append((k, s.kids[-1]))
    return top


#: Shapes, or templates of parts, that one task merges into one template.
MERGE_BLOCK = 64
#: Shapes that are aligned with one copy of their host's template.
ALIGN_BLOCK = 256


def _merge_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Template of one block of a host's distinct shapes or partial templates, the most frequent first."""
    allow_depth()
    pdf = pdf.sort_values(["n", "tree"], ascending=[False, True])
    top = Slot("#")
    for tree, n in zip(pdf["tree"], pdf["n"]):
        merge(load_template(tree) if "\x03" in tree else load(tree), top, int(n))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "block": [int(pdf["block"].iloc[0]) // MERGE_BLOCK], "tree": [dump_template(top)], "n": [int(pdf["n"].sum())]})


def host_templates(kinds: DataFrame) -> DataFrame:
    """``(host, template)`` from ``(host, shape, n)``: a tree of merges of at most ``MERGE_BLOCK`` parts each."""
    # a set number of partitions: these rows are few bytes but long work, and would else be coalesced into one task
    parts = work_partitions(kinds)
    many = kinds.groupBy("host").agg(F.ceil(F.count("*") / MERGE_BLOCK).alias("blocks"))
    cur = kinds.join(many, "host").select("host", F.col("shape").alias("tree"), "n", F.expr("pmod(xxhash64(shape), blocks)").alias("block"))
    while True:
        cur = materialize(cur.repartition(parts, "host", "block").groupBy("host", "block").applyInPandas(_merge_part, "host string, block bigint, tree string, n bigint"), "templates")
        if cur.groupBy("host").count().where("count > 1").isEmpty():
            return cur.select("host", F.col("tree").alias("template"))


class Template:
    """Host's template with its nodes numbered in preorder: paths (64-bit hashes of the labels from the root), parents, lists, and title holders by pages."""

    def __init__(self, text: str):
        self.top = _slot(load_template(text))
        self.paths: list[int] = []
        self.parents: list[int] = []
        self.lists: list[bool] = []
        self.heads: dict[int, int] = {}
        stack: list[tuple[Slot, int, int]] = [(self.top, 0, -1)]
        while stack:
            s, path, up = stack.pop()
            s.no = len(self.paths)
            self.paths.append(path)
            self.parents.append(up)
            self.lists.append(s.label.partition(".")[0] in _LISTS)
            for k in reversed(s.kids):
                if k.label == "h1":
                    self.heads[s.no] = self.heads.get(s.no, 0) + k.weight
                stack.append((k, xxhash.xxh3_64_intdigest(f"{path}/{k.label}") - (1 << 63), s.no))


@lru_cache(maxsize=64)
def _template(text: str) -> Template:
    return Template(text)


#: Path of nodes that no template node is aligned with.
NOWHERE = -1
_ALIGNED = "kind string, host string, nos array<int>, paths array<bigint>, parents array<int>, lists array<boolean>, title int"


def align_shapes(kinds: DataFrame, templates: DataFrame) -> DataFrame:
    """Step 2: every distinct shape of every host aligned with the host's template.

    Per node of the shape in preorder: number and path of its template node
    (-1 for none), its parent, whether it is a list; and the node that
    directly holds the page title (-1 for none).
    """
    many = kinds.groupBy("host").agg(F.ceil(F.count("*") / ALIGN_BLOCK).alias("blocks"))
    left = kinds.join(many, "host").select("host", F.expr("pmod(xxhash64(kind), blocks)").alias("block"), "kind", "shape")
    right = templates.join(many, "host").select(F.col("host").alias("thost"), F.explode(F.expr("sequence(0, cast(blocks as bigint) - 1)")).alias("tblock"), "template")

    def fn(shapes: pa.Table, template: pa.Table) -> pa.Table:
        allow_depth()
        cols: dict[str, list] = {c: [] for c in ("nos", "paths", "parents", "lists", "title")}
        host = _template(template["template"][0].as_py())
        for text in shapes["shape"].to_pylist():
            shape = load(text)
            labels, parents = _nodes(shape)
            nos = places(shape, host.top)
            size = [1] * len(labels)
            for k in range(len(labels) - 1, 0, -1):
                size[parents[k]] += size[k]
            held = [parents[k] for k, lab in enumerate(labels) if lab == "h1"]
            cols["nos"].append(nos)
            cols["paths"].append([host.paths[j] if j >= 0 else NOWHERE for j in nos])
            cols["parents"].append(parents)
            cols["lists"].append([lab.partition(".")[0] in _LISTS for lab in labels])
            cols["title"].append(max(held, key=lambda k: (size[k], -k)) if held else -1)
        types = {"nos": pa.list_(pa.int32()), "paths": pa.list_(pa.int64()), "parents": pa.list_(pa.int32()), "lists": pa.list_(pa.bool_()), "title": pa.int32()}
        return pa.table([shapes["kind"], shapes["host"], *[pa.array(cols[c], types[c]) for c in types]], names=["kind", "host", *types])

    parts = work_partitions(kinds)
    return left.repartition(parts, "host", "block").groupBy("host", "block").cogroup(right.repartition(parts, "thost", "tblock").groupBy("thost", "tblock")).applyInArrow(fn, _ALIGNED)


#: Occurrences that the pooled rate of like markup counts for beside a host's own.
PRIOR = 50.0
#: Two texts of a slot coincide at this rate or more: template.
CONSTANT = 0.005
#: Mean characters of a text below which a slot isn't prose.
PROSE = 80
#: Share of a host's varying prose that lies below its main body.
MOST = 0.5


def slot_statistics(leaf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step 3 from leaves ``(host, no, path, text_key, size, link)``: ``(host, path, template)`` and ``(host, no, mass)``.

    ``template`` says that a slot is constant, links, or too short for prose;
    ``mass`` are the characters in a node that is a varying slot of prose.
    """
    text = materialize(
        leaf.groupBy("host", "no", "path", "text_key").agg(F.count("*").alias("n"), F.sum("size").alias("chars"), F.sum(F.col("link").cast("int")).alias("links")), "texts"
    )
    per = text.groupBy("host", "path", "text_key").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    own = per.groupBy("host", "path").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1)")).alias("hits"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    fam = (
        text.groupBy("path", "text_key").agg(F.sum("n").alias("n"))
        .groupBy("path").agg((F.sum(F.expr("n * (n - 1)")) / F.greatest(F.sum("n") * (F.sum("n") - 1), F.lit(1))).alias("rate"))
    )
    constant = f"(hits + {PRIOR} * rate) / (n * (n - 1) + {PRIOR}) >= {CONSTANT}"
    slots = materialize(
        own.join(fam, "path").select("host", "path", F.expr(f"{constant} OR links >= 0.5 * n OR chars < {PROSE} * n").alias("template")), "slots"
    )
    prose = slots.where("NOT template").select("host", "path")
    mass = text.groupBy("host", "no", "path").agg(F.sum("chars").alias("chars")).join(prose, ["host", "path"]).groupBy("host", "no").agg(F.sum("chars").alias("mass"))
    return slots, mass


def host_bodies(templates: DataFrame, mass: DataFrame) -> DataFrame:
    """Step 4 per host: ``(host, main)``, the number of the template node that is the main body, or -1."""
    per = mass.where("no >= 0").groupBy("host").agg(F.collect_list(F.struct("no", "mass")).alias("masses"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mains = []
            for text, masses in zip(b.column("template").to_pylist(), b.column("masses").to_pylist()):
                t = _template(text)
                parents, heads, n = t.parents, t.heads, len(t.parents)
                below = [0] * n
                for x in masses or ():
                    below[x["no"]] += x["mass"]
                leaf = [True] * n
                for k in range(n - 1, 0, -1):
                    below[parents[k]] += below[k]
                    leaf[parents[k]] = False
                # the deepest container below which most of the varying prose lies: numbers grow with depth along a chain
                deep = max((k for k in range(n) if not leaf[k] and below[k] >= MOST * below[0] and below[0]), default=-1)
                while deep > 0 and t.lists[deep]:
                    deep = parents[deep]
                up: set[int] = set()
                k = deep
                while k >= 0:
                    up.add(k)
                    k = parents[k]
                titled = max(heads, key=lambda k: (heads[k], -k)) if heads else -1
                k = titled
                nested = titled in up
                while k >= 0 and not nested:
                    nested = k == deep
                    k = parents[k]
                mains.append(titled if titled >= 0 and (nested or deep < 0) else deep)
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(mains, pa.int32())], names=["host", "main"])

    return templates.join(per, "host", "left").select("host", "template", "masses").mapInArrow(fn, "host string, main int")


#: What decided on a leaf: it lies in the host's main body or outside it, in a page's own title block or outside, or by its slot.
RULES = ("body", "outside", "title block", "outside title block", "nested slot", "slot")
_JUDGED = "kind string, body array<boolean>, rule array<int>"


def judge_shapes(aligned: DataFrame, mains: DataFrame, slots: DataFrame) -> DataFrame:
    """Step 4 per shape: whether each node is main body, and by which of ``RULES``."""
    per = slots.where("NOT template").groupBy("host").agg(F.collect_list("path").alias("varying"))
    many = aligned.groupBy("host").agg(F.ceil(F.count("*") / ALIGN_BLOCK).alias("blocks"))
    left = aligned.join(many, "host").withColumn("block", F.expr("pmod(xxhash64(kind), blocks)")).drop("blocks")
    right = mains.join(per, "host", "left").join(many, "host").select(
        F.col("host").alias("thost"), F.explode(F.expr("sequence(0, cast(blocks as bigint) - 1)")).alias("tblock"), "main", "varying"
    )

    def fn(shapes: pa.Table, host: pa.Table) -> pa.Table:
        main_no, varying = host["main"][0].as_py(), set(host["varying"][0].as_py() or ())
        bodies, rules = [], []
        for nos, paths, parents, lists, title in zip(*(shapes[c].to_pylist() for c in ("nos", "paths", "parents", "lists", "title"))):
            main = nos.index(main_no) if main_no >= 0 and main_no in nos else -1
            # without that node, or among blocks of like markup, the page's own title tells which is meant
            own = title >= 0 and (main < 0 or (title != main and paths[title] == paths[main]))
            main = title if own else main
            inside, lone, body, rule = [], [], [], []
            for k, up in enumerate(parents):
                is_in = k == main or (up >= 0 and inside[up])
                inside.append(is_in)
                # a block of its own within the main body: neither a text of it nor an entry of a list of it
                lone.append(is_in and k != main and ((up != main and not lists[up]) or lone[up]))
                if main < 0 or lone[k]:
                    body.append(paths[k] in varying)
                    rule.append(5 if main < 0 else 4)
                else:
                    body.append(is_in)
                    rule.append((0 if is_in else 1) + 2 * own)
            bodies.append(body)
            rules.append(rule)
        return pa.table([shapes["kind"], pa.array(bodies, pa.list_(pa.bool_())), pa.array(rules, pa.list_(pa.int32()))], names=["kind", "body", "rule"])

    return left.groupBy("host", "block").cogroup(right.groupBy("thost", "tblock")).applyInArrow(fn, _JUDGED)


def classify_leaves(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Steps 2 to 4: ``(id, host, seg_pos, text_key, size, flags, main_body, rule)`` for every leaf.

    ``pages`` is a result of ``page_shapes``; ``hosts`` is ``(id, host)`` with
    one row per id.  Pages without a host are hosts of their own.
    """
    at = pages.join(hosts, "id", "left").withColumn("host", F.coalesce(F.col("host"), F.concat(F.lit("?"), F.col("id").cast("string"))))
    at = materialize(at.withColumn("kind", F.md5(F.concat_ws("\x01", "host", "shape"))), "pages")
    kinds = materialize(at.groupBy("host", "kind").agg(F.first("shape").alias("shape"), F.count("*").alias("n")), "shapes")
    templates = host_templates(kinds)
    aligned = materialize(align_shapes(kinds, templates), "aligned")
    leaf = sliced_join(aligned.select("kind", "nos", "paths"), at.select("id", "host", "kind", "leaves"), "kind", "id").select(
        "host", "nos", "paths", F.explode("leaves").alias("x")
    ).select("host", F.expr("nos[x.place]").alias("no"), F.expr("paths[x.place]").alias("path"), "x.text_key", "x.size", "x.link")
    slots, mass = slot_statistics(leaf)
    judged = materialize(judge_shapes(aligned, host_bodies(templates, mass), slots), "judged")
    return sliced_join(judged, at.select("id", "host", "kind", "leaves"), "kind", "id").select("id", "host", "body", "rule", F.explode("leaves").alias("x")).select(
        "id", "host", "x.seg_pos", "x.text_key", "x.size", "x.flags", F.expr("body[x.place]").alias("main_body"), F.expr("rule[x.place]").alias("rule")
    )


def page_hosts(docs: DataFrame, id_col: str = "doc_id", url_col: str = "url") -> DataFrame:
    """``(id, host)``: the host of a document's address without ``www.``; the least of several."""
    host = F.regexp_replace(F.lower(F.expr(f"try_parse_url(`{url_col}`, 'HOST')")), "^www\\.", "")
    return docs.select(F.col(id_col).alias("id"), host.alias("host")).where("id IS NOT NULL").groupBy("id").agg(F.min("host").alias("host"))


def boilerplate_segments(
    pages: DataFrame, docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw", segments_col: str = "segments", url_col: str = "url"
) -> DataFrame:
    """``(doc_id, seg_pos)`` of every segment that isn't part of its page's main body.

    Pages without markup, without segments or with null in either column give
    no row of their own accord; a repeated id gives each position once.
    """
    shaped = page_shapes(pages, id_col, raw_col, segments_col)
    leaves = classify_leaves(shaped, page_hosts(docs, id_col, url_col))
    return leaves.where("seg_pos >= 0 AND NOT main_body").select(F.col("id").alias("doc_id"), "seg_pos").distinct()


def decisions(pages: DataFrame, docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw", segments_col: str = "segments", url_col: str = "url") -> DataFrame:
    """``(rule, main_body, n)``: number of leaves on which each of ``RULES`` decided, and how."""
    leaves = classify_leaves(page_shapes(pages, id_col, raw_col, segments_col), page_hosts(docs, id_col, url_col))
    name = F.get(F.array(*map(F.lit, RULES)), F.col("rule"))
    return leaves.groupBy(name.alias("rule"), "main_body").agg(F.count("*").alias("n"))


def main_bodies(
    pages: DataFrame, docs: DataFrame, id_col: str = "doc_id", raw_col: str = "raw", segments_col: str = "segments", url_col: str = "url"
) -> DataFrame:
    """``(doc_id, body)``: segments of the main body joined by line feeds; empty where nothing is left."""
    gone = (
        boilerplate_segments(pages, docs, id_col, raw_col, segments_col, url_col)
        .groupBy("doc_id").agg(F.collect_set("seg_pos").alias("gone"))
    )
    return (
        pages.select(F.col(id_col).alias("doc_id"), F.col(segments_col).alias("s"))
        .join(gone, "doc_id", "left")
        .select("doc_id", F.expr("array_join(filter(s, (x, i) -> NOT coalesce(array_contains(gone, cast(i as int)), false)), '\n')").alias("body"))
    )
