"""Evaluation passages leaking into training text (problem 7).

The held-out items are the indexed side: an inverted index with BM25 impacts,
each divided by the least score that any run of ``run`` consecutive words of
its item reaches.  In that scale every passage that holds such a run scores at
least 1, so retrieval at threshold 1 loses none.  Each training text is cut
into passages at words that no item has (no run can cross one), long ones into
overlapping chunks; every passage is a query to the index by block-max WAND
(Ding and Suel, "Faster top-k document retrieval using block-max indexes",
2011), and each item retrieved is verified: a run of its words stands in the
passage, and beside it the overlap of question and answer is measured.

Items are read in blocks of a bounded number of words, so the broadcast index
has a proven size whatever the number of items; texts are never shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.visual import folded
from tessella.operators.scratch import materialize

RUN = 12
#: Words of one block of items: its index takes about 200 bytes a word in each worker, with the lists it opens.
BLOCK_WORDS = 1_000_000
#: Words of a query passage beyond run; neighbours overlap by run - 1 words.  Short passages keep the sum of the
#: upper bounds of common words below the threshold, so that only lists of rare words drive the search.
EXTRA = 2
_WORD = re.compile(r"[^\W_]+")
_SPLIT = {c: " " for c in range(128) if not chr(c).isalnum()}
_K1, _B = 1.2, 0.75
#: Items of one block of a posting list, by their numbers, so that the blocks of all lists begin at the same items.
_BLOCK = 16
_END = 1 << 60


def words_of(text: str | None) -> list[str]:
    """Words for comparison: runs of letters and digits of the folded form."""
    if not text:
        return []
    f = folded(text)
    return f.translate(_SPLIT).split() if f.isascii() else _WORD.findall(f)


class PassageIndex:
    """BM25 index of items with block maxima, scaled so that 1 is the score of the weakest run."""

    def __init__(self, items: list[tuple], run: int = RUN):
        """``items`` are ids with the words of the text and, it may be, those of the answer."""
        items = [(i, w, *answer) for i, w, *answer in sorted(items) if len(w) >= run]
        self.run, self.extra = run, EXTRA
        self.ids = [x[0] for x in items]
        self.answers = [x[2] if len(x) > 2 else [] for x in items]
        items = [x[:2] for x in items]
        df = Counter(w for _, ws in items for w in set(ws))
        self.vocab = {w: k for k, w in enumerate(sorted(df))}
        self.seqs = [np.array([self.vocab[w] for w in ws], np.int32) for _, ws in items]
        n, avg = len(items), sum(map(len, self.seqs)) / max(1, len(items))
        idf = {self.vocab[w]: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        term: list[int] = []
        item: list[int] = []
        impact: list[float] = []
        for k, words in enumerate(self.seqs):
            seq = words.tolist()
            tf = Counter(seq)
            norm = _K1 * (1 - _B + _B * len(seq) / avg)
            w = {t: idf[t] * c * (_K1 + 1) / (c + norm) for t, c in tf.items()}
            least = min(sum(w[t] for t in set(seq[j : j + run])) for j in range(len(seq) - run + 1))
            term += w
            item += [k] * len(w)
            impact += [x / least for x in w.values()]
        # postings in order of term and item; over them, per term, the greatest impact in each block and in all
        t = np.array(term, np.int64)
        k = np.array(item, np.int64)
        order = np.lexsort((k, t))
        t, self.item, self.impact = t[order], k[order].astype(np.int32), np.array(impact, np.float32)[order]
        self.term_at = np.searchsorted(t, np.arange(len(self.vocab) + 1))
        self.top = np.maximum.reduceat(self.impact, self.term_at[:-1]).tolist() if len(t) else []
        self._lists: dict[int, tuple[list[int], list[float], dict[int, float]]] = {}
        self._grams: dict[int, set] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": {}, "_grams": {}}

    def _list(self, t: int) -> tuple[list[int], list[float], dict[int, float]]:
        """Posting list of a term as items (with an end mark), impacts, and greatest impact by block; made once per worker."""
        got = self._lists.get(t)
        if got is None:
            a, b = int(self.term_at[t]), int(self.term_at[t + 1])
            items, impacts = self.item[a:b].tolist(), self.impact[a:b].tolist()
            tops: dict[int, float] = {}
            for k, x in zip(items, impacts):
                if x > tops.get(k // _BLOCK, 0.0):
                    tops[k // _BLOCK] = x
            got = self._lists[t] = ([*items, _END], impacts, tops)
        return got

    def search(self, terms: list[int], theta: float = 1.0) -> list[int]:
        """Positions of all items whose score over the distinct ``terms`` reaches ``theta``, by block-max WAND.

        One cursor per term, in order of the item each stands at.  The pivot is
        the first item at which the greatest impacts of the lists up to it add
        up to the threshold; no item before it can reach that.  If the maxima
        of the blocks around the pivot don't, all cursors skip beyond the
        nearest block end; else they skip to the pivot, and it is scored once
        all stand there.
        """
        theta -= 1e-4  # impacts are single precision
        top = self.top
        if sum(top[t] for t in terms) < theta:
            return []
        cursors = []
        for t in terms:
            items, impacts, tops = self._list(t)
            cursors.append([items[0], 0, items, impacts, tops, top[t]])
        found: list[int] = []
        n = len(cursors)
        while True:
            cursors.sort(key=_where)
            acc, p = 0.0, 0
            for c in cursors:
                acc += c[5]
                if acc >= theta:
                    break
                p += 1
            if p == n:
                return found
            pivot = cursors[p][0]
            if pivot == _END:
                return found
            while p + 1 < n and cursors[p + 1][0] == pivot:
                p += 1
            block = pivot // _BLOCK
            bound = 0.0
            for c in cursors[: p + 1]:
                bound += c[4].get(block, 0.0)
            if bound < theta:
                # no item up to the end of the block, or up to where the next list sets in, can reach the threshold
                to = (block + 1) * _BLOCK
                if p + 1 < n and cursors[p + 1][0] < to:
                    to = cursors[p + 1][0]
                for c in cursors[: p + 1]:
                    c[1] = bisect_left(c[2], to, c[1])
                    c[0] = c[2][c[1]]
            elif cursors[0][0] == pivot:
                score = 0.0
                for c in cursors[: p + 1]:
                    score += c[3][c[1]]
                    c[1] += 1
                    c[0] = c[2][c[1]]
                if score >= theta:
                    found.append(pivot)
            else:
                for c in cursors[:p]:
                    if c[0] < pivot:
                        c[1] = bisect_left(c[2], pivot, c[1])
                        c[0] = c[2][c[1]]

    def shares_run(self, k: int, passage: list[int]) -> bool:
        """Exact check: a run of ``run`` words of item ``k`` stands in ``passage``."""
        g = self._grams.get(k)
        if g is None:
            s = self.seqs[k].tolist()
            g = self._grams[k] = {tuple(s[j : j + self.run]) for j in range(len(s) - self.run + 1)}
        return any(tuple(passage[j : j + self.run]) in g for j in range(len(passage) - self.run + 1))

    def passages(self, words: list[str]) -> Iterator[list[int]]:
        """Stretches of item words of at least ``run`` words, in passages of ``run`` + EXTRA words overlapping by ``run`` - 1.

        A run of ``run`` words covers exactly one position ``run`` - 1,
        2 ``run`` - 1, ...; only there is the vocabulary asked first.
        """
        run, get, n, done = self.run, self.vocab.get, len(words), 0
        for p in range(run - 1, n, run):
            if p < done or words[p] not in self.vocab:
                continue
            a, b = p, p + 1
            while a > done and words[a - 1] in self.vocab:
                a -= 1
            while b < n and words[b] in self.vocab:
                b += 1
            done = b
            if b - a >= run:
                ids = [get(w) for w in words[a:b]]
                for j in range(0, max(1, len(ids) - run + 1), self.extra + 1):
                    yield ids[j : j + run + self.extra]

    def leaked(self, words: list[str]) -> dict[int, None]:
        """Positions of the items of which a text of these words holds a run."""
        hit: dict[int, None] = {}
        for p in self.passages(words):
            for k in self.search(sorted(set(p))):
                if k not in hit and self.shares_run(k, p):
                    hit[k] = None
        return hit

    def overlaps(self, hit: Iterable[int], words: list[str]) -> Iterator[tuple[float, bool | None]]:
        """For each item of ``hit``: share of its runs that stand in a text of these words, and whether its answer does; None without an answer."""
        hit = list(hit)
        if not hit:
            return
        ids = [self.vocab.get(w, -1) for w in words]
        have = {tuple(ids[j : j + self.run]) for j in range(len(ids) - self.run + 1) if ids[j] >= 0}
        spaced = f" {' '.join(words)} "
        for k in hit:
            g, answer = self._grams[k], self.answers[k]
            yield len(g & have) / len(g), f" {' '.join(answer)} " in spaced if answer else None


_where = itemgetter(0)


def _folded_words(docs: DataFrame, kind: str) -> DataFrame:
    """``(d, w)``: words of each text in their folded form, joined by blanks."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("d"), pa.array([" ".join(words_of(t)) for t in rb.column("t").to_pylist()], pa.string())], names=["d", "w"])

    return docs.mapInArrow(fn, f"d {kind}, w string")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    answer: str | None = "answer",
    run: int = RUN,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(doc_id, item_id, question_overlap, answer_found)`` for each text holding ``run`` or more consecutive words of an item.

    ``question_overlap`` is the share of the item's distinct runs that stand in
    the text; ``answer_found`` says whether the answer's words stand there one
    after the other, null for items without an answer or where ``answer`` is
    None.  Case, punctuation, white space, invisible and look-alike characters
    don't count.  Null and empty texts, and items of fewer words, leak nothing.
    A repeated document or item id gives a row for each of its texts.
    """
    spark = docs.sparkSession
    reply = F.col(answer) if answer and answer in items.columns else F.lit(None).cast("string")
    it = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), reply.alias("r")).where("i IS NOT NULL AND t IS NOT NULL")
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    dk, ik = dict(src.dtypes)["d"], dict(it.dtypes)["i"]
    total = it.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / 4 / block_words))  # a word takes at least four characters on average
    split = blocks > 1
    if split:  # texts are folded once, not once per block of items
        src = materialize(_folded_words(src, dk), "words").withColumnRenamed("w", "t")
    out = None
    for b in range(blocks):
        part = it.where(F.expr(f"pmod(xxhash64(i), {blocks}) = {b}"))
        index = spark.sparkContext.broadcast(PassageIndex([(r["i"], words_of(r["t"]), words_of(r["r"])) for r in part.toLocalIterator()], run))

        def fn(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for rb in batches:
                d_out, i_out, shares, answers = [], [], [], []
                for d, t in zip(rb.column("d").to_pylist(), rb.column("t").to_pylist()):
                    words = t.split(" ") if split else words_of(t)
                    hit = ix.leaked(words)
                    for k, (share, replied) in zip(hit, ix.overlaps(hit, words)):
                        d_out.append(d)
                        i_out.append(ix.ids[k])
                        shares.append(share)
                        answers.append(replied)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d_out, rb.schema.field("d").type), pa.array(i_out, pa.int64() if ik == "bigint" else None),
                        pa.array(shares, pa.float64()), pa.array(answers, pa.bool_()),
                    ],
                    names=["doc_id", "item_id", "question_overlap", "answer_found"],
                )

        rows = src.mapInArrow(fn, f"doc_id {dk}, item_id {ik}, question_overlap double, answer_found boolean")
        out = rows if out is None else out.unionByName(rows)
    return out


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id)`` of ``leaks``, each pair once whatever the number of texts of an id."""
    return leaks(docs, items, **options).select("doc_id", "item_id").distinct()
