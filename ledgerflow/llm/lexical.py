"""Ranked lexical search by presence masks.

The index is a table of segments.  One row holds, for some MB of text, the
sorted terms, each term's postings (document and occurrences), and the
documents' ids and lengths.  It is built without a shuffle; segments are cut by
text size, so neither a frequent term nor a hot source makes one larger.

A search takes the items in blocks of about ``BLOCK_TERMS`` terms, one block
at a time: its result is written before the next block is sent.

1. One pass over the index counts the documents and terms of the collection
   and the documents that hold each term of the block.
2. In a second pass every task works off its segments one by one.  A segment's
   postings of the block's terms become a bitmap per term.  For an item the
   bitmaps of its terms, turned by document, give each document's presence
   mask; documents of the same mask are a group.  A mask's highest possible
   score is the sum of its terms' greatest contributions in the segment.
   Masks are taken by descending highest score, and their documents scored
   exactly, until the next mask cannot reach the item's ``k``-th best score.
   The best of all earlier segments of the task stay in force, so later
   segments leave after a few masks.  A mask that can only equal the k-th best
   score is still scored: a smaller id would win the tie.
3. Each task gives its ``k`` best documents of every item; a window over them
   per item and part of the tasks, and one over what is left, rank them.

Scores are whole numbers (the contract's formula), so results do not depend on
the order of segments.  A task holds one segment, the block and k rows an item.

Defined cases: a null or empty text has no terms and is never found; very long
texts are one segment each; equal scores go to the smaller document id, a null
id first; repeated document rows are documents of their own; a repeated item
row counts once, and different texts of one item id are searched together;
items without terms, and empty tables on either side, give no rows; other
columns of the tables are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .text import byte_class, word_slices

TOP = 20
SEGMENT_BYTES = 4 << 20
BLOCK_TERMS = 200_000  # terms of the items searched at a time
STEP = 64  # documents scored before the limit is looked at again
PARTS = 64  # of the tasks' results, ranked apart first
SEGMENT = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
                     ("terms", pa.binary()), ("lists", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())])
SEGMENT_DDL = ("n_docs long, n_terms long, ids array<long>, lengths binary, terms binary, lists binary, "
               "docs binary, times binary")


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned whole numbers in two or four bytes each, as the largest needs."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, one row per segment (write it, or ``cut`` it, to
    search it).  ``n_docs`` and ``n_terms`` count documents with a term and
    all terms with their repeats."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, w in word_slices(batch.column(1), byte_class("alnum"), limit=SEGMENT_BYTES):
                n = w.counts
                doc = np.repeat(np.arange(b - a), n)
                order = np.argsort(w.hash, kind="stable")  # by term, then by document
                h, d = w.hash[order], doc[order]
                term = np.ones(len(h), dtype=bool)
                term[1:] = h[1:] != h[:-1]
                lead = term.copy()
                lead[1:] |= d[1:] != d[:-1]
                at = np.flatnonzero(lead)
                times = np.diff(np.append(at, len(h)))
                lists = np.append(np.flatnonzero(term[at]), len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                     pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64()))]
                    + [pa.array([x], pa.binary()) for x in
                       (n.astype(np.int64).tobytes(), h[term].tobytes(), lists.astype(np.int64).tobytes(),
                        _narrow(d[at]), _narrow(times))], schema=SEGMENT)

    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SEGMENT_DDL))


class Postings:
    """A segment's postings of some terms (sorted hashes): ``term``, ``doc``
    and ``times`` of each, by term and document."""

    def __init__(self, row, vocab: np.ndarray):
        terms, lists = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["lists"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        none = np.zeros(0, np.int64)
        self.size, self.lengths = len(lengths), lengths
        self.term = self.doc = self.times = none
        self.found = self.begin = self.count = none
        if not len(terms) or not len(vocab):
            return
        at = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
        self.found = np.flatnonzero(terms[at] == vocab)  # terms of the block that the segment holds
        lo, hi = lists[at[self.found]], lists[at[self.found] + 1]
        self.count = hi - lo
        self.begin = np.cumsum(self.count) - self.count
        place = np.repeat(lo - self.begin, self.count) + np.arange(int(self.count.sum()))
        self.term = np.repeat(self.found, self.count)
        self.doc = _wide(row["docs"], int(lists[-1]))[place]
        self.times = _wide(row["times"], int(lists[-1]))[place]


class Items:
    """The terms of some items: ``vocab`` (sorted hashes), and of each item
    its name, the places of its terms in ``vocab``, and their repeats."""

    def __init__(self, rows):
        hashes = [np.frombuffer(r["words"], np.uint64) for r in rows]
        self.names = [r["item"] for r in rows]
        self.vocab = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.terms, self.repeats = [], []
        for h in hashes:
            own, n = np.unique(h, return_counts=True)
            self.terms.append(np.searchsorted(self.vocab, own))
            self.repeats.append(n.astype(np.int64))

    def weigh(self, n_docs: int, n_terms: int, held: dict):
        """Weights from the collection's counts; ``held``: documents by term."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1)))
                                for i in range(len(self.vocab))], dtype=np.int64)


class Best:
    """The best documents of an item so far: scores, null marks, ids."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.id = np.zeros(0, np.int64)
        self.named = np.zeros(0, bool)

    @property
    def limit(self) -> int:
        """A score that a further document needs at least."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score, named, id_):
        score, named, id_ = (np.concatenate(x) for x in
                             ((self.score, score), (self.named, named), (self.id, id_)))
        order = np.lexsort((id_, named, -score))
        order = order[score[order] > 0][: self.k]
        self.score, self.named, self.id = score[order], named[order], id_[order]


class Ranker:
    """Works segments off, one by one, for all items of a block."""

    def __init__(self, items: Items, k: int):
        self.items, self.best = items, [Best(k) for _ in items.names]

    def work(self, row):
        items = self.items
        p = Postings(row, items.vocab)
        if not len(p.found):
            return
        m = 75 + 25 * p.lengths * items.n_docs // items.n_terms
        gain = (1_000_000_000 * p.times) // (1000 * p.times + 12 * m[p.doc])
        top = np.zeros(len(items.vocab), np.int64)
        top[p.found] = np.maximum.reduceat(gain, p.begin)
        line = np.full(len(items.vocab), -1)
        line[p.found] = np.arange(len(p.found))
        present = np.zeros((len(p.found), p.size), dtype=bool)
        present[line[p.term], p.doc] = True
        bitmaps = np.packbits(present, axis=1, bitorder="little")
        by_doc = np.argsort(p.doc, kind="stable")
        term, gain = p.term[by_doc], gain[by_doc]
        bound = np.searchsorted(p.doc[by_doc], np.arange(p.size + 1))
        ids = pa.array(row["ids"], pa.int64())
        named, ids = ~np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
        coef = np.zeros(len(items.vocab), np.int64)
        for own, repeats, best in zip(items.terms, items.repeats, self.best):
            here = np.flatnonzero((line[own] >= 0) & (items.weight[own] > 0))
            worth = items.weight[own[here]] * repeats[here]
            most = worth * top[own[here]]
            if not len(here) or most.sum() < best.limit:
                continue
            docs, high = self.masks(bitmaps[line[own[here]]], most, p.size, best.limit)
            coef[own[here]] = worth
            a = 0
            while a < len(docs) and high[a] >= best.limit:
                d = docs[a: a + STEP]
                d = d[high[a: a + STEP] >= best.limit]
                size = bound[d + 1] - bound[d]
                start = np.cumsum(size) - size
                at = np.repeat(bound[d] - start, size) + np.arange(int(size.sum()))
                best.add(np.add.reduceat(coef[term[at]] * gain[at], start), named[d], ids[d])
                a += STEP
            coef[own[here]] = 0

    @staticmethod
    def masks(bitmaps: np.ndarray, most: np.ndarray, size: int, limit: int):
        """Documents by descending highest score of their presence mask, and
        those scores; masks below the limit are left out."""
        bits = np.unpackbits(bitmaps, axis=1, count=size, bitorder="little")
        packed = np.packbits(bits, axis=0, bitorder="little").T  # a mask per document
        pad = -packed.shape[1] % 8
        words = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64)
        order = np.lexsort(words.T)
        new = np.ones(size, dtype=bool)
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        lead = order[new]  # one document of each distinct mask
        high = most @ bits[:, lead].astype(np.int64)
        high = high[np.cumsum(new) - 1]
        keep = high >= limit
        order, high = order[keep], high[keep]
        by = np.argsort(-high, kind="stable")
        return order[by], high[by]


def _item_blocks(items: DataFrame, id_col: str, text_col: str):
    """Blocks of items with about ``BLOCK_TERMS`` terms; one at a time is on
    the driver (a larger item is a block by itself)."""
    schema = pa.schema([("item", pa.string()), ("n", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, b, w in word_slices(batch.column(1), byte_class("alnum")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(w.counts, pa.int64()),
                     pa.array([w.hash[w.first[i]: w.first[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    schema=schema)

    words = cut(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
                .distinct().mapInArrow(run, "item string, n long, words binary").where("n > 0"))
    total = words.agg(F.sum("n")).first()[0] or 0
    n = -(-total // BLOCK_TERMS)
    for k in range(n):
        part = words.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()
        pooled: dict = {}
        for r in part:
            pooled.setdefault(r["item"], []).append(bytes(r["words"]))
        if pooled:
            yield Items([{"item": i, "words": b"".join(w)} for i, w in pooled.items()])


def _count(index: DataFrame, items: Items):
    """Weigh the block's terms by the counts of the whole collection."""
    shared = index.sparkSession.sparkContext.broadcast(items.vocab)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches):
        vocab = shared.value
        held, n_docs, n_terms = np.zeros(len(vocab), np.int64), 0, 0
        for batch in batches:
            for row in batch.select(["n_docs", "n_terms", "terms", "lists"]).to_pylist():
                n_docs, n_terms = n_docs + row["n_docs"], n_terms + row["n_terms"]
                terms, lists = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["lists"], np.int64)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
                    hit = np.flatnonzero(terms[at] == vocab)
                    held[hit] += lists[at[hit] + 1] - lists[at[hit]]
        hit = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*hit.tolist(), None], pa.int64()), pa.array([*held[hit].tolist(), n_docs], pa.int64()),
             pa.array([*[0] * len(hit), n_terms], pa.int64())], schema=schema)

    # at most one row per term of the block, and one of totals
    rows = (index.mapInArrow(run, "term long, n long, m long").groupBy("term")
            .agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect())
    shared.destroy()
    held = {r["term"]: r["n"] for r in rows}
    n_docs = held.pop(None, 0)
    items.weigh(n_docs, next((r["m"] for r in rows if r["term"] is None), 0), held)


def _rank(index: DataFrame, items: Items, k: int) -> DataFrame:
    """The k best of every item and task."""
    shared = index.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("item", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() % PARTS
        ranker = Ranker(shared.value, k)
        for batch in batches:
            for i in range(batch.num_rows):
                ranker.work({c: batch.column(c)[i].as_py() for c in SEGMENT.names[2:]})
        for name, b in zip(shared.value.names, ranker.best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(b.score), pa.string()), pa.array([part] * len(b.score), pa.int32()),
                     pa.array(b.id, pa.int64(), mask=~b.named), pa.array(b.score, pa.int64())], schema=schema)

    return index.mapInArrow(run, "item string, part int, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    kind, found = items.schema[id_col].dataType, []
    for block in _item_blocks(items, id_col, text_col):
        _count(index, block)
        found.append(cut(_rank(index, block, k)))
    empty = "item string, part int, doc_id long, score long"
    rows = index.sparkSession.createDataFrame([], empty)
    for f in found:
        rows = rows.union(f)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    apart = Window.partitionBy("item", "part").orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    return (rows.withColumn("at", F.row_number().over(apart)).where(F.col("at") <= k)
            .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
            .select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
