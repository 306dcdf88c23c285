"""Filling fixed-capacity containers with items (problem 6): hierarchical residual packing.

Round 0 packs each chunk of items best-fit, largest first, without any
shuffle.  Bins filled to the round's mark are emitted; the rest go up a tree
of groups, in which each underfull bin is one item of a repeated best-fit
round.  The mark falls with the rounds.  After best-fit no two bins of a group
fit together, so at most one of them is at most half full; as the last mark
before the root is one half, the root gets at most one bin from each group
below it.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scratch import materialize

CAPACITY = 2048
#: Vocabulary file of a public byte-level BPE, as ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed together in round 0.
CHUNK = 20_000
#: Fill at which a bin is emitted in rounds 0, 1, 2, ...; the root emits all.
MARKS = (0.98, 0.9, 0.75, 0.5)
#: Groups merged into one per round.
FAN_IN = 8
_encoders: dict = {}


def _here(path: str) -> str:
    """Where this worker finds a file that the driver has sent along, or the path itself."""
    from pyspark import SparkFiles

    try:
        sent = SparkFiles.get(os.path.basename(path))
    except Exception:  # no session here
        return path
    return sent if os.path.exists(sent) else path


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(_here(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, n_tokens)`` of every row; null texts have none."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["id"]
    # the file need only be where the driver runs
    df.sparkSession.sparkContext.addFile(tokenizer)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return src.mapInArrow(fn, f"id {kind}, n_tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions: largest first, each into the fullest bin that still takes it."""
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        j = bisect_left(free, (sizes[k], -1))
        if j < len(free):
            room, b = free.pop(j)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if room > sizes[k] or sizes[k] == 0:
            insort(free, (room - sizes[k], b))
    return bins


_ITEM = pa.struct([("id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64())])
_BIN = "bin string, used bigint, open boolean, items array<struct<id string, piece int, start bigint, tokens bigint>>"


def _first_round(counts: DataFrame, capacity: int, chunk: int) -> DataFrame:
    """Round 0: bins of each chunk of rows in the order in which a task reads them."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        items: list[tuple[str, int, int, int]] = []

        def packed() -> pa.RecordBatch:
            nonlocal no
            bins = best_fit([x[3] for x in items], capacity)
            used = [sum(items[k][3] for k in b) for b in bins]
            rows = [[dict(zip(("id", "piece", "start", "tokens"), items[k])) for k in b] for b in bins]
            names = [f"{part}.{no}.{j}" for j in range(len(bins))]
            no += 1
            items.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(used, pa.int64()), pa.array([u < MARKS[0] * capacity for u in used]), pa.array(rows, pa.list_(_ITEM))],
                names=["bin", "used", "open", "items"],
            )

        for b in batches:
            for i, n in zip(b.column("id").to_pylist(), b.column("n_tokens").to_pylist()):
                at = piece = 0
                while n - at > capacity:  # only an item beyond the capacity is cut, into full containers and a rest
                    items.append((i, piece, at, capacity))
                    at, piece = at + capacity, piece + 1
                items.append((i, piece, at, n - at))
                if len(items) >= chunk:
                    yield packed()
        if items:
            yield packed()

    return counts.select(F.col("id").cast("string").alias("id"), "n_tokens").mapInArrow(fn, _BIN)


def _merger(level: int, mark: float, capacity: int):
    """One best-fit round over the underfull bins of a group."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        grp, out = int(pdf["grp"][0]), []
        for j, b in enumerate(best_fit([int(u) for u in pdf["used"]], capacity)):
            used = int(sum(pdf["used"][k] for k in b))
            items = [x for k in b for x in pdf["items"][k]]
            out.append((grp, f"{grp}.r{level}.{j}", used, bool(used < mark * capacity), items))
        return pd.DataFrame(out, columns=["grp", "bin", "used", "open", "items"])

    return merge


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(container, id, piece, start, tokens, used)``: every row's text in containers of ``capacity`` tokens.

    A text of more tokens than ``capacity`` is cut into pieces of ``capacity``
    and a rest, counted from 0, ``start`` being the first token; no other text
    is cut.  Null and empty texts are items of 0 tokens.  Rows of a null id
    are left out; a repeated id is an item each time.
    """
    counts = token_counts(df.where(F.col(id_col).isNotNull()), id_col, text_col, tokenizer)
    kind = dict(df.dtypes)[id_col]
    bins = materialize(_first_round(counts, capacity, chunk), "bins")
    done = [bins.where("NOT open")]
    left = bins.where("open").withColumn("grp", F.expr(f"cast(floor(cast(split_part(bin, '.', 1) as int) / {FAN_IN}) as int)"))
    groups = (left.agg(F.max("grp").alias("g")).first()["g"] or 0) + 1
    level = 1
    while True:
        last = groups == 1 and level >= len(MARKS)
        mark = -1.0 if last else MARKS[min(level, len(MARKS) - 1)]

        packed = materialize(left.select("grp", "bin", "used", "open", "items").groupBy("grp").applyInPandas(_merger(level, mark, capacity), "grp int, " + _BIN), "bins")
        done.append(packed.where("NOT open").drop("grp"))
        if last:
            break
        left = packed.where("open").withColumn("grp", F.expr(f"cast(floor(grp / {FAN_IN}) as int)"))
        groups = -(-groups // FAN_IN)
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("bin").alias("container"), "used", F.explode("items").alias("x")).select(
        "container", F.expr(f"cast(x.id as {kind})").alias("id"), "x.piece", "x.start", "x.tokens", "used"
    )
