"""Near-duplicate records with small edits (problem 2): an LSH forest over word shingles.

Each text gets a label per tree: ``DEPTH`` MinHash values of 16 bits, written
one after the other in a long.  A tree is the table of labels in sorted order.
One pass over each sorted tree finds the longest prefix that neighbours have in
common; a maximal stretch of labels with a common prefix is a region, and its
members are candidates of one another.  Depth adapts to the region: a stretch of
few members is taken at the shortest prefix at which they are few, any other
is descended to ``DEPTH`` values, where all of it is taken however large it is.
So no pair that agrees in ``DEPTH`` values of a tree is ever lost.

Stretches of more than ``region`` members, and those at the ends of a sorted
partition, which may go on in the next, are paired in slices with size bound
and sketch applied at once.  Then the shingle sets themselves are compared, in
tiles of pairs, so that a text is sent once per tile and not once per pair.

Texts with equal shingle sets are one node of all this, with a membership
table beside it, so copies cost nothing and lose no link.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.util import digest, group_pairs, maybe_broadcast, work_partitions
from tessella.operators.components import connected_components
from tessella.operators.scratch import materialize

#: Trees and depth.  A pair of similarity s is missed with probability (1 - s ** 4) ** 40, however dense its regions:
#: 0.004 at 0.6, 0.0004 at 0.65, and less than 1e-9 at 0.8.
TREES, DEPTH = 40, 4
#: Members of a region above which it is paired in slices, sketches first, and up to which a region is taken at less than full depth.
REGION, FEW = 64, 4
#: Rows of one region of depth 1 that a task holds at a time; the rest of a larger one is paired in slices at full depth.
HELD = 200_000
#: Characters of text that a tile of the exact check holds on average, at most.
TILE_CHARS = 8_000_000
#: Bytes of the sketch that filters candidates, one MinHash value modulo 256 each.
SKETCH = 64
#: The sketch is packed in longs of seven bytes, so that sums on them don't overflow.
LONGS = -(-SKETCH // 7)
_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = np.uint64(29)
_rng = np.random.default_rng(20240601)
_MUL = (_rng.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_SPLIT = {c: " " for c in range(128) if not chr(c).isalnum()}


class _Ids(dict):
    """64-bit id of each word, hashed once per worker."""

    def __missing__(self, w: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        x = self[w] = xxhash.xxh3_64_intdigest(w)
        return x


_ids = _Ids()


def _words(text: str) -> list[str]:
    t = text.lower()
    return t.translate(_SPLIT).split() if t.isascii() else _WORD.findall(t)


def _shingles(words: list[str], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of ``k`` words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_ids.__getitem__, words)), np.uint64)
    n = len(words) - k + 1
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : j + n]) * _M1
        acc ^= acc >> _S
        acc *= _M2
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def _signature(sh: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values."""
    x = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    out = np.empty(len(_MUL), np.uint32)
    for a in range(0, len(_MUL), 80):
        v = x[None, :] * _MUL[a : a + 80, None]
        v ^= v >> np.uint32(15)
        v *= _ADD[a : a + 80, None] | np.uint32(1)
        out[a : a + 80] = v.min(axis=1)
    return out


def _labels(sig: np.ndarray) -> np.ndarray:
    """Labels of a signature, one long per tree: the first value of the tree in the highest 16 bits, and so on."""
    m = sig.reshape(TREES, DEPTH).astype(np.uint64)
    out = np.zeros(TREES, np.uint64)
    for d in range(DEPTH):
        # smallest hashes are alike in their high bits, so they are mixed before they are cut
        out = (out << np.uint64(16)) | (((m[:, d] + np.uint64(1)) * _M1) >> np.uint64(48))
    return out.view(np.int64)


def _packed(sig: np.ndarray) -> np.ndarray:
    """Sketch of a signature: its first SKETCH values modulo 256, seven in a long."""
    out = np.zeros(LONGS * 7, np.uint8)
    out[:SKETCH] = sig[:SKETCH] & np.uint32(255)
    return np.pad(out.reshape(LONGS, 7), ((0, 0), (0, 1))).view("<i8").ravel()


def _agree(a: str, b: str) -> str:
    """SQL for the number of bytes in which two packed sketches agree."""
    low, high = 0x7F7F7F7F7F7F7F, 0x80808080808080
    other = " + ".join(f"bit_count(((({a}[{i}] ^ {b}[{i}]) & {low}L) + {low}L | ({a}[{i}] ^ {b}[{i}])) & {high}L)" for i in range(LONGS))
    return f"{SKETCH} - ({other})"


def _signed(df: DataFrame, id_col: str, text_col: str, k: int, min_words: int) -> DataFrame:
    """``(id, set_key, n, keys, sketch)``; keys holds the label in each tree."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = dict(src.dtypes)["id"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets, ns, keys, sk = [], [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                w = _words(t)
                if len(w) < max(k, min_words):
                    continue
                sh = _shingles(w, k)
                sig = _signature(sh)
                ids.append(i)
                sets.append(digest(sh.tobytes()))
                ns.append(len(sh))
                keys.append(_labels(sig))
                sk.append(_packed(sig))
            lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, b.schema.field("id").type),
                    pa.array(sets, pa.binary()),
                    pa.array(ns, pa.int32()),
                    lists(keys, TREES),
                    lists(sk, LONGS),
                ],
                names=["id", "set_key", "n", "keys", "sketch"],
            )

    return src.mapInArrow(fn, f"id {kind}, set_key binary, n int, keys array<bigint>, sketch array<bigint>")


def _regions(tree: np.ndarray, label: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Region number of each row of a sorted stretch, and each region's size.

    The prefix that a row has in common with the row before it is the longest
    one; of the nested stretches that hold a row, the region is the longest
    with at most ``few`` members, or else the one of full depth.
    """
    bits = label.view(np.uint64)
    apart = np.empty(len(label), np.int64)  # values in common with the row before
    apart[0] = -1
    if len(label) > 1:
        x = bits[1:] ^ bits[:-1]
        lcp = np.full(len(x), DEPTH)
        for d in range(DEPTH, 0, -1):
            lcp[x >> np.uint64(64 - 16 * d) != 0] = d - 1
        apart[1:] = np.where(tree[1:] == tree[:-1], lcp, -1)
    start = np.zeros(len(label), bool)
    start[0] = True
    done = np.zeros(len(label), bool)
    for d in range(1, DEPTH + 1):
        edge = np.flatnonzero(apart < d)
        size = np.diff(np.append(edge, len(label)))
        mine = np.repeat(size, size)
        take = ~done & ((mine <= few) | (d == DEPTH))
        start[edge] |= take[edge]
        done |= take
    edge = np.flatnonzero(start)
    size = np.diff(np.append(edge, len(label)))
    return np.repeat(np.arange(len(edge)), size), size


def _scan(kind: str, region: int, few: int, threshold: float):
    """Pass over one partition of the sorted trees: pairs ``(x, y)`` of small regions, and rows ``(x, null, key)`` of those left to slices."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first = True
        cols = ["x", "y", "key"]

        def rest(t: pa.Table) -> pa.RecordBatch:
            key = (t["label"].to_numpy().view(np.uint64) ^ (t["tree"].to_numpy().astype(np.uint64) * _M3)) * _M2
            x = t["rep"].combine_chunks()
            return pa.RecordBatch.from_arrays([x, pa.nulls(len(x), x.type), pa.array((key ^ (key >> _S)).astype(np.int64))], names=cols)

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            tree, label, n = (t[c].to_numpy() for c in ("tree", "label", "n"))
            no, size = _regions(tree, label, few)
            mine = size[no]
            if (mine > region).any():
                yield rest(t.filter(pa.array(mine > region)))
                no = np.where(mine > region, -1 - np.arange(len(no)), no)  # never equal to a neighbour's
            rep = t["rep"].combine_chunks()
            for k in range(1, int(min(region, size.max()))):
                i = np.flatnonzero(no[k:] == no[:-k])
                if not len(i):
                    break
                i = i[np.minimum(n[i], n[i + k]) >= threshold * np.maximum(n[i], n[i + k])]
                if len(i):
                    yield pa.RecordBatch.from_arrays([rep.take(pa.array(i)), rep.take(pa.array(i + k)), pa.nulls(len(i), pa.int64())], names=cols)

        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            top = held["label"].to_numpy() >> 48
            tree = held["tree"].to_numpy()
            cut = np.flatnonzero((top[1:] != top[:-1]) | (tree[1:] != tree[:-1])) + 1
            if first and len(cut):  # what the partition begins with may belong to the one before
                yield rest(held.slice(0, int(cut[0])))
                held, cut, first = held.slice(int(cut[0])), cut[1:] - cut[0], False
            if len(cut):
                yield from work(held.slice(0, int(cut[-1])))
                held = held.slice(int(cut[-1]))
            elif len(held) > HELD:
                yield rest(held)
                # what follows of this region goes the same way
                held, first = None, True
        if held is not None and len(held):
            yield rest(held)

    return fn, f"x {kind}, y {kind}, key bigint"


def _candidates(reps: DataFrame, threshold: float, region: int, few: int, least: int) -> DataFrame:
    """Distinct candidate pairs ``(a, b)`` of representatives from all trees; those paired in slices agree in ``least`` bytes of the sketch."""
    trees = reps.select("rep", "n", F.posexplode("keys").alias("tree", "label"))
    fn, schema = _scan(dict(reps.dtypes)["rep"], region, few, threshold)
    forest = trees.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    seen = materialize(forest.mapInArrow(fn, schema), "forest")
    near = seen.where("y IS NOT NULL").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowd = seen.where("y IS NULL").select("key", F.col("x").alias("rep")).join(reps.select("rep", "n", "sketch"), "rep")
    many = group_pairs(crowd, "key", "rep", ["rep", "n", "sketch"]).where(
        f"least(n_a, n_b) >= {threshold} * greatest(n_a, n_b) AND {_agree('sketch_a', 'sketch_b')} >= {least}"
    )
    return near.unionByName(many.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))).distinct()


def _verified(df: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """Exact check on the shingle sets: ``(a, b, similarity)``.

    Ids fall into B buckets and pairs into B x B tiles; a tile gets its pairs
    and one copy of each text they name.  B grows with the number of pairs and
    the length of texts, so that a tile stays within ``TILE_CHARS`` on average.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = materialize(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(maybe_broadcast(wanted), "id", "left_semi")
        .dropDuplicates(["id"]),
        "texts",
    )
    mean = texts.agg(F.avg(F.length("text")).alias("m")).first()["m"] or 1.0
    per_tile = min(4096.0, max(16.0, TILE_CHARS / (2 * mean)))
    side = math.ceil(max(pairs.count() / per_tile, work_partitions(pairs)) ** 0.5)
    bucket = lambda c: F.expr(f"cast(pmod(xxhash64({c}), {side}) as int)")
    tiled = pairs.select("a", "b", bucket("a").alias("i"), bucket("b").alias("j"))
    where = tiled.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = where.join(texts, "id")
    kind = dict(pairs.dtypes)["a"]

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        text = dict(zip(right["id"].to_pylist(), right["text"].to_pylist()))
        sets: dict = {}
        out_a, out_b, sims = [], [], []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist()):
            for i in (a, b):
                if i not in sets:
                    sets[i] = _shingles(_words(text[i]), k)
            x, y = sets[a], sets[b]
            n = len(np.intersect1d(x, y, assume_unique=True))
            s = n / (len(x) + len(y) - n)
            if s >= threshold:
                out_a.append(a)
                out_b.append(b)
                sims.append(s)
        t = left.schema.field("a").type
        return pa.table([pa.array(out_a, t), pa.array(out_b, t), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return tiled.groupBy("i", "j").cogroup(sent.groupBy("ti", "tj")).applyInArrow(fn, f"a {kind}, b {kind}, similarity double")


class NearDuplicates:
    """Result of ``near_duplicates``: ``links`` between representatives and ``members`` of each."""

    def __init__(self, links: DataFrame, members: DataFrame):
        self.links, self.members = links, members

    def pairs(self) -> DataFrame:
        """Every pair of records ``(id_a, id_b)``, ``id_a < id_b``, copies expanded."""
        m = self.members
        twice = m.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep")
        same = group_pairs(m.join(maybe_broadcast(twice), "rep", "left_semi"), "rep", "id", ["id"])
        across = self.links.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(
            m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b"
        )
        return same.select("id_a", "id_b").unionByName(
            across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        )

    def classes(self) -> DataFrame:
        """One row per record that was long enough: ``(id, class_id, n_links)``.

        ``class_id`` is the least representative of the group; ``n_links``
        counts the links of the record's representative to other texts.
        """
        cc = connected_components(self.links, "a", "b")
        deg = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        return (
            self.members.join(cc.withColumnRenamed("node", "rep"), "rep", "left")
            .join(deg, "rep", "left")
            .select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    min_words: int = 0,
    region: int = REGION,
    few: int = FEW,
) -> NearDuplicates:
    """Records whose sets of ``shingle``-word sequences have a Jaccard similarity of at least ``threshold``.

    Words are the longest runs of letters and digits of the lower-cased text.
    Null texts and texts of fewer than ``shingle`` or ``min_words`` words are
    left out; an id that occurs more than once must have one text, of which
    one row is kept.
    """
    signed = materialize(_signed(df, id_col, text_col, shingle, min_words).dropDuplicates(["id"]), "signed")
    members = materialize(
        signed.select("id", "set_key").join(signed.groupBy("set_key").agg(F.min("id").alias("rep")), "set_key").select("id", "rep"), "members"
    )
    reps = materialize(signed.join(members.where("id = rep").select("id"), "id", "left_semi").select(F.col("id").alias("rep"), "n", "keys", "sketch"), "reps")
    sk = reps.select("rep", "sketch")
    # a sketch agrees at s + (1 - s) / 256 of its bytes; four standard deviations below the threshold are allowed
    least = int(SKETCH * threshold - 4 * (SKETCH * threshold * (1 - threshold)) ** 0.5)
    cand = _candidates(reps, threshold, region, few, least)
    close = (
        cand.join(sk.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sk.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(f"{_agree('sa', 'sb')} >= {least}")
        .select("a", "b")
    )
    close = materialize(close, "close")
    links = materialize(_verified(df, close, id_col, text_col, shingle, threshold), "links")
    return NearDuplicates(links, members)
