"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, as a search engine keeps them: one row
holds the sorted terms of some MB of training text, each term's postings
(ascending word positions), and the documents' bounds.  Segments are cut by
text size, so neither a frequent word nor a hot source makes one larger, and
the index is built without a shuffle.

A search sends the test windows to every segment in blocks of at most
``BLOCK_WORDS`` words (one pass per block, so the broadcast is bounded
whatever the benchmark's size; a block's hits are written and its broadcast
given up before the next is sent).  In a segment a window with a term that has
no postings is out; the others start from their rarest term's postings,
shifted by the term's offset, and are intersected with the next rarest
term's shifted postings, and so on.

A proximity match is a window's terms in order, inside one document, with at
most ``SLOP`` other words among them.  It is sought from every place of the
rarest term: the terms after it at their first places, the terms before it at
their last, which is the tightest match that holds that place.

Defined cases: a null text has no words and is never hit; a test item without
words has no window; an item with fewer words than the window is one window;
a null item id marks words but is not listed; repeated items count once;
repeated documents are rows of their own; an empty index gives no rows, an
empty benchmark hits nothing; other columns, whatever their names, are ignored
(``drop_contaminated`` keeps them).  A text is indexed whole in one segment, in
some 60 bytes of memory a byte of text.
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, fresh, share
from .text import Words, byte_class, word_slices

WINDOW = 13
SLOP = 2
BLOCK_WORDS = 1_000_000
SEGMENT = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("first", pa.binary()),
                     ("terms", pa.binary()), ("lists", pa.binary()), ("positions", pa.binary())])
SEGMENT_DDL = ("segment long, doc_ids array<long>, first binary, terms binary, lists binary, "
               "positions binary")


class Segment:
    """Postings of some texts: ``positions[lists[t]:lists[t+1]]`` are the
    ascending places of ``terms[t]``; ``first`` bounds the documents."""

    def __init__(self, first, terms, lists, positions):
        self.first, self.terms, self.lists, self.positions = first, terms, lists, positions

    @cached_property
    def flat(self) -> np.ndarray:
        """All postings as one ascending array: term number * words + position."""
        number = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.lists))
        return number * int(self.first[-1]) + self.positions

    @classmethod
    def of(cls, w: Words) -> Segment:
        order = np.argsort(w.hash, kind="stable")
        h = w.hash[order]
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return cls(w.first.astype(np.int64), h[lead],
                   np.concatenate([lead, [len(h)]]).astype(np.int32), order.astype(np.int32))


class Block:
    """Windows of some test items, as rows of term numbers (-1: past the end)."""

    def __init__(self, items: list, words: list[np.ndarray], window: int):
        rows, owner = [], []
        for i, h in enumerate(words):
            k = min(window, len(h))
            for s in range(len(h) - k + 1 if k else 0):
                rows.append(np.pad(h[s: s + k], (0, window - k)))
                owner.append((i, k))
        self.items = items
        self.owner = np.array([o[0] for o in owner], dtype=np.int64)
        self.length = np.array([o[1] for o in owner], dtype=np.int64)
        hashes = np.array(rows, dtype=np.uint64).reshape(-1, window)
        used = np.arange(window)[None, :] < self.length[:, None]
        self.vocab = np.unique(hashes[used])
        self.term = np.where(used, np.searchsorted(self.vocab, hashes), -1)

    def starts(self, seg: Segment):
        """For the windows whose terms all have postings: their numbers, the
        segment's number of each term (-1: past the end) and the offsets from
        the rarest term to the commonest; then the rarest term's places, each
        with its window's row among these."""
        at = np.minimum(np.searchsorted(seg.terms, self.vocab), len(seg.terms) - 1)
        there = seg.terms[at] == self.vocab
        used = self.term >= 0
        alive = np.flatnonzero((there[self.term] | ~used).all(axis=1))
        term = np.where(used[alive], at[self.term[alive]], -1)
        size = np.where(term >= 0, np.diff(seg.lists)[term], np.iinfo(np.int32).max)
        by_rarity = np.argsort(size, axis=1, kind="stable")
        row = np.arange(len(alive))
        count = size[row, by_rarity[:, 0]]
        win = np.repeat(row, count)
        place = (np.arange(len(win)) - np.repeat(np.cumsum(count) - count, count)
                 + np.repeat(seg.lists[term[row, by_rarity[:, 0]]].astype(np.int64), count))
        return alive, term, by_rarity, win, seg.positions[place].astype(np.int64)

    def matches(self, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence in the segment."""
        n = int(seg.first[-1])
        if not n or not len(self.term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        alive, term, by_rarity, win, pos = self.starts(seg)
        doc = np.searchsorted(seg.first, pos, side="right") - 1
        start = pos - by_rarity[win, 0]
        ok = (start >= seg.first[doc]) & (start + self.length[alive][win] <= seg.first[doc + 1])
        win, start = win[ok], start[ok]
        for j in range(1, self.term.shape[1]):
            if not len(win):
                break
            off = by_rarity[win, j]
            t = term[win, off]
            want = t * n + start + off
            hit = seg.flat[np.minimum(np.searchsorted(seg.flat, want), len(seg.flat) - 1)] == want
            keep = hit | (t < 0)
            win, start = win[keep], start[keep]
        return alive[win], start

    def near(self, seg: Segment, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, end): the tightest proximity matches around the
        places of each window's rarest term."""
        n = int(seg.first[-1])
        if not n or not len(self.term):
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        alive, term, by_rarity, win, pos = self.starts(seg)
        flat, size = seg.flat, self.term.shape[1]
        lo, hi, left, right = pos, pos, by_rarity[win, 0], by_rarity[win, 0]
        for _ in range(size - 1):  # one term to the right, while the window has one
            on = np.flatnonzero(right + 1 < self.length[alive][win])
            if not len(on):
                break
            t = term[win[on], right[on] + 1]
            i = np.minimum(np.searchsorted(flat, t * n + hi[on], side="right"), len(flat) - 1)
            to = flat[i] - t * n
            hi, right = hi.copy(), right.copy()
            found = (to > hi[on]) & (to < n)
            hi[on], right[on] = np.where(found, to, hi[on] + n), right[on] + 1
            ok = hi - lo - (right - left) <= slop
            win, lo, hi, left, right = (x[ok] for x in (win, lo, hi, left, right))
        for _ in range(size - 1):  # then to the left
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            t = term[win[on], left[on] - 1]
            i = np.searchsorted(flat, t * n + lo[on]) - 1
            to = flat[np.maximum(i, 0)] - t * n
            lo, left = lo.copy(), left.copy()
            found = (i >= 0) & (to >= 0)
            lo[on], left[on] = np.where(found, to, lo[on] - n), left[on] - 1
            ok = hi - lo - (right - left) <= slop
            win, lo, hi, left, right = (x[ok] for x in (win, lo, hi, left, right))
        ok = hi < seg.first[np.searchsorted(seg.first, lo, side="right")]
        return alive[win[ok]], lo[ok], hi[ok] + 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``: one row per segment (write it or ``cut`` it to
    search it more than once).  Lower-cases A-Z; words are runs of digits,
    ASCII letters and non-ASCII characters."""
    table = byte_class("alnum")

    def run(batches):
        from pyspark import TaskContext
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for a, b, w in word_slices(batch.column(1), table):
                s = Segment.of(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial], pa.int64()),
                     pa.array([ids.slice(a, b - a).to_pylist()], pa.list_(pa.int64()))]
                    + [pa.array([x.tobytes()], pa.binary()) for x in (s.first, s.terms, s.lists, s.positions)],
                    schema=SEGMENT)
                serial += 1

    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
            .mapInArrow(run, SEGMENT_DDL))


def blocks(tests: DataFrame, id_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """The test items' windows in blocks of about ``block_words`` words; one
    block at a time is on the driver."""
    table = byte_class("alnum")
    schema = pa.schema([("item", pa.string()), ("n", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, b, w in word_slices(batch.column(1), table):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.string()), pa.array(w.counts),
                     pa.array([w.hash[w.first[i]: w.first[i + 1]].tobytes() for i in range(b - a)],
                              pa.binary())], schema=schema)

    words = tests.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")) \
        .mapInArrow(run, "item string, n long, words binary").where("n > 0").distinct()
    total = words.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        part = words.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).collect()
        part.sort(key=lambda r: (r.item is None, r.item or "", r.words))
        yield Block([r.item for r in part], [np.frombuffer(r.words, np.uint64) for r in part], window)


def covered(seg: Segment, block: Block):
    """Per document of the segment: runs of hit words (flat starts and ends,
    relative to the document, with bounds) and the sorted items."""
    win, start = block.matches(seg)
    n = int(seg.first[-1])
    delta = np.zeros(n + 1, dtype=np.int32)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + block.length[win], -1)
    on = np.cumsum(delta[:n]) > 0
    head, tail = on.copy(), on.copy()
    fence = np.zeros(n + 1, dtype=bool)
    fence[seg.first] = True
    head[1:] &= ~on[:-1] | fence[1:n]
    tail[:-1] &= ~on[1:] | fence[1:n]
    s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
    bounds = np.searchsorted(s, seg.first)
    base = seg.first[np.searchsorted(seg.first, s, side="right") - 1] if len(s) else s
    return s - base, e - base, bounds, listed(seg, block, win, start)


def listed(seg: Segment, block: Block, win, start) -> list[list[str]]:
    """Per document of the segment: the sorted items of the windows found."""
    doc = np.searchsorted(seg.first, start, side="right") - 1
    items: list[set] = [set() for _ in range(len(seg.first) - 1)]
    for d, i in zip(doc.tolist(), block.owner[win].tolist()):
        if block.items[i] is not None:
            items[d].add(block.items[i])
    return [sorted(x) for x in items]


def each_block(spark, parts, found) -> list[DataFrame]:
    """``found`` of every block (given as a function that returns it in a
    task).  Of several, each frame is written and the block's broadcast given
    up before the next block is sent."""
    block, after = next(parts), next(parts, None)
    if after is None:
        return [found(share(spark, block))]
    work, out = Scratch(spark), []
    while block is not None:
        get = share(spark, block)
        out.append(work.keep(found(get), f"block{len(out)}"))
        get.drop()
        block, after = after, next(parts, None)
    return out


RUNS = ("array<struct<s:long,e:long>>", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))


def _runs_array(s, e, bounds):
    return pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["s", "e"]))


def _searcher(shared, slop):
    names = pa.list_(pa.string())
    schema = pa.schema([("segment", pa.int64()), ("ord", pa.int64()), ("doc_id", pa.int64()),
                        ("n_words", pa.int64()), ("runs", RUNS[1]), ("items", names), ("near", names)])

    def run(batches):
        block = shared()
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(*[np.frombuffer(row[c], t) for c, t in
                                (("first", np.int64), ("terms", np.uint64), ("lists", np.int32),
                                 ("positions", np.int32))])
                n = len(row["doc_ids"])
                s, e, bounds, items = covered(seg, block)
                near = listed(seg, block, *block.near(seg, slop)[:2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["segment"])), pa.array(np.arange(n)),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(seg.first)),
                     _runs_array(s, e, bounds),
                     pa.array(items, names), pa.array(near, names)], schema=schema)
    return run


def _hit_words(runs: Column) -> Column:
    """Words in the union of runs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(runs), zero, lambda a, r: F.struct(
        (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["to"], r["s"]))).alias("n"),
        F.greatest(a["to"], r["e"]).alias("to")))["n"]


def _judged(found: DataFrame) -> DataFrame:
    items, near = F.array_sort("items"), F.array_sort("near")
    n_hit = _hit_words(F.col("runs"))
    return (found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                         items.alias("items"), near.alias("near"), "runs")
            .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")))


def search(index: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document of the index: n_words, n_hit (words inside an occurrence
    of a test window), n_items, items, near (items with a proximity match,
    those with an exact one too), runs (word spans hit), contaminated (at least
    one hit, and hits are 5 % of the words or more)."""
    ddl = ("segment long, ord long, doc_id long, n_words long, "
           f"runs {RUNS[0]}, items array<string>, near array<string>")
    found = each_block(index.sparkSession, blocks(tests, id_col, text_col, window),
                       lambda get: index.mapInArrow(_searcher(get, slop), ddl))
    if len(found) > 1:
        found = [reduce(DataFrame.union, found).groupBy("segment", "ord").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("runs")).alias("runs"),
            *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")])]
    return _judged(found[0])


def proximity(index: DataFrame, tests: DataFrame, slop: int, id_col: str = "item_id",
              text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Proximity matches (doc_id, item, start, end: word places in the
    document), the tightest around each place of a window's rarest term."""
    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def finder(shared):
        def run(batches):
            block = shared()
            for batch in batches:
                for row in batch.to_pylist():
                    seg = Segment(*[np.frombuffer(row[c], t) for c, t in
                                    (("first", np.int64), ("terms", np.uint64), ("lists", np.int32),
                                     ("positions", np.int32))])
                    win, start, end = block.near(seg, slop)
                    doc = np.searchsorted(seg.first, start, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["doc_ids"][d] for d in doc], pa.int64()),
                         pa.array([block.items[i] for i in block.owner[win]], pa.string()),
                         pa.array(start - seg.first[doc], pa.int64()), pa.array(end - seg.first[doc], pa.int64())],
                        schema=schema)
        return run

    return reduce(DataFrame.union, each_block(
        index.sparkSession, blocks(tests, id_col, text_col, window),
        lambda get: index.mapInArrow(finder(get), "doc_id long, item string, start long, end long"))).distinct()


def hit_runs(shared, text: Column) -> Column:
    """struct(n_words, runs) of a text column for one block, by segments that
    are built and searched in one step (no shuffle, no index written)."""
    table = byte_class("alnum")

    @F.arrow_udf(f"struct<n_words:long,runs:{RUNS[0]}>")
    def run(texts: pa.Array) -> pa.Array:
        counts, runs, block = [], [], shared()
        for _, _, w in word_slices(texts, table):
            s, e, bounds, _ = covered(Segment.of(w), block)
            counts.append(w.counts)
            runs.append(_runs_array(s, e, bounds))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts) if counts else [], pa.int64()),
             pa.concat_arrays(runs) if runs else pa.array([], RUNS[1])], names=["n_words", "runs"])
    return run(text.cast("string"))


def drop_contaminated(docs: DataFrame, tests: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; all columns as they were.  Each
    block adds its hit runs to the rows; of several blocks, each pass is
    written."""
    mark, runs = fresh(docs, "__hit", "__runs")
    spark, parts = docs.sparkSession, blocks(tests)
    block, after = next(parts), next(parts, None)
    work = Scratch(spark) if after is not None else None
    rows, turn = docs.withColumn(runs, F.array().cast(RUNS[0])), 0
    while block is not None:
        get = share(spark, block)
        rows = (rows.withColumn(mark, hit_runs(get, F.col(text_col)))
                .withColumn(runs, F.concat(runs, F.col(mark)["runs"])))
        if work:
            rows, turn = work.keep(rows, f"rows{turn % 2}"), turn + 1
            get.drop()
        block, after = after, next(parts, None)
    n_hit, n = _hit_words(F.col(runs)), F.col(mark)["n_words"]
    return rows.where(~((n_hit > 0) & (20 * n_hit >= n))).drop(mark, runs)


def digest(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The report of ``search`` over a stored index, with the items as digests."""
    found = search(cut(build_index(docs)), tests)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        "contaminated", F.size("near").cast("long").alias("n_near"),
                        F.sha2(F.array_join("near", ",").cast("binary"), 256).alias("near_sha256"))
