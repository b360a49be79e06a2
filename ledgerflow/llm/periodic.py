"""Periodic runs of words and their collapse.

A run is a maximal stretch of words with smallest period q (words q apart are
equal) that is long enough: ``least`` words and ``times`` periods.  Found by an
enhanced suffix array, without tree nodes:

1. Documents that cannot hold a run leave first: in a run the words of a
   stretch of ``least - least // times`` words at least equal those q further
   on, so some window of that many words stands twice in the document.
2. The suffix array of the words of all other documents of a slice by prefix
   doubling (only groups that are still tied are sorted again; a suffix ends
   with its document), its inverse ISA, and the LCP array by the irreducible
   values of the permuted LCP.
3. Every LCP interval of depth d comes from the nearest smaller values around
   its boundaries.  Of each interval all children but the largest are visited:
   suffix i and a suffix i + d (or i - d) that ISA puts into the interval, but
   not into the same child, make a branching tandem repeat: LCP(i, i + d) = d.
   That is n log n checks at most.
4. Each such square is rotated to the left while words d apart are equal; the
   stretch so found ends where the square ends, since it branches there.
   Stretches with the same bounds merge into one run of the smallest period.

A word is known by a 64-bit hash of its bytes.  One document is the unit of
work: memory is that of a slice of some MB of text or of one document,
whichever is longer, some 200 bytes a word.  No shuffle.

Defined cases: a null or empty text has no words, no runs and an empty
collapse; very long texts are worked off whole; a tie between runs that share
bounds goes to the smaller period; repeated rows are rows of their own; an
empty table gives none; other columns are kept, whatever their names (added
columns get names that none of them has).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, buffers, byte_class, mix64, slices

LEAST, TIMES = 24, 3
CELLS = 1 << 21  # words compared, or pairs made, at a time
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND_DDL = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def repeats_window(tokens: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Of each document, whether a window of ``width`` words stands in it twice."""
    n, docs = len(tokens), len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    whole = np.arange(n) + width <= first[doc + 1] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    h, span = tokens, 1
    while span < width:  # windows of span + step words from two that overlap
        step = min(span, width - span)
        h = mix64(h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + h[step:])
        span += step
    key = h[at] + mix64(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key, owner = key[order], doc[at][order]
    out = np.zeros(docs, dtype=bool)
    out[owner[1:][key[1:] == key[:-1]]] = True
    return out


def suffix_array(sym: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SA, ISA) of documents laid end to end; ``sym`` orders by document
    first, ``end`` is the end of each position's document."""
    n = len(sym)
    sa = np.argsort(sym, kind="stable")
    lead = np.ones(n, dtype=bool)
    lead[1:] = sym[sa[1:]] != sym[sa[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    alone = lead & np.append(lead[1:], True)
    open_ = np.flatnonzero(~alone)  # places of SA in groups of more than one
    h = 1
    while len(open_):
        at = sa[open_]
        nxt = np.where(at + h < end[at], rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[open_] = at
        lead = np.ones(len(at), dtype=bool)
        lead[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(lead, open_, 0))
        open_ = open_[~(lead & np.append(lead[1:], True))]
        h *= 2
    return sa, rank


def extension(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on are equal (``step`` 1: to the
    right; -1: to the left, from the words before), ``limit`` at most."""
    out = np.zeros(len(a), dtype=np.int64)
    live, width, last = np.flatnonzero(limit > 0), 8, len(tokens) - 1
    base = 0 if step > 0 else -1
    while len(live):
        left = []
        for s in range(0, len(live), max(1, CELLS // width)):
            x = live[s: s + max(1, CELLS // width)]
            off = out[x][:, None] + np.arange(width)
            same = (tokens[np.clip(a[x][:, None] + base + step * off, 0, last)]
                    == tokens[np.clip(b[x][:, None] + base + step * off, 0, last)]) & (off < limit[x][:, None])
            whole = same.all(axis=1)
            out[x] += np.where(whole, width, same.argmin(axis=1))
            left.append(x[whole])
        live, width = np.concatenate(left), min(2 * width, 1024)
    return out


def lcp_array(tokens: np.ndarray, sa: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """LCP[r] of the suffixes SA[r - 1] and SA[r] (0 across documents;
    LCP[0] = -1).  Only irreducible values (the words before differ) are
    compared; every other one is one less than its left neighbour's."""
    n = len(tokens)
    phi = np.full(n, -1, dtype=np.int64)
    near = np.flatnonzero(begin[sa[1:]] == begin[sa[:-1]])
    phi[sa[near + 1]] = sa[near]
    i = np.arange(n)
    reducible = (phi >= 0) & (i > begin) & (phi > begin)
    reducible[reducible] = tokens[i[reducible] - 1] == tokens[phi[reducible] - 1]
    plcp = np.zeros(n, dtype=np.int64)
    x = np.flatnonzero(~reducible & (phi >= 0))
    plcp[x] = extension(tokens, x, phi[x], end[x] - np.maximum(x, phi[x]), 1)
    source = np.maximum.accumulate(np.where(reducible, 0, i))
    lcp = (plcp[source] - (i - source))[sa]
    lcp[0] = -1
    return lcp


def smaller_neighbours(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and after ``at`` whose value is smaller
    (``len(values)`` if none follows; ``values[0]`` is the smallest of all),
    by a tree of minima."""
    size = 1 << (len(values)).bit_length()
    level = [np.append(values, np.full(size - len(values), -2))]
    while len(level[-1]) > 1:
        level.append(np.minimum(level[-1][0::2], level[-1][1::2]))
    want, found = values[at], []
    for side in (0, 1):  # 0: before, 1: after
        node, height = at.copy(), np.zeros(len(at), dtype=np.int64)
        live = np.arange(len(at))
        for k in range(len(level) - 1):
            up = node[live]
            beside = up ^ 1
            hit = (up % 2 == 1 - side) & (level[k][beside] < want[live])
            node[live] = np.where(hit, beside, up >> 1)
            height[live[hit]] = k
            live = live[~hit]
        for k in range(len(level) - 2, 0, -1):
            x = np.flatnonzero(height == k)
            close, far = 2 * node[x] + 1 - side, 2 * node[x] + side
            node[x] = np.where(level[k - 1][close] < want[x], close, far)
            height[x] = k - 1
        found.append(node)
    return found[0], found[1]


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, begin: np.ndarray, end: np.ndarray,
                      times: int):
    """(start, period) of branching tandem repeats with at most a document's
    length / ``times`` words, some more than once, in blocks."""
    r = np.flatnonzero((lcp >= 1) & (lcp * times <= (end - begin)[sa]))
    if not len(r):
        return
    lb, nxt = smaller_neighbours(lcp, r)
    order = np.lexsort((r, lcp[r], lb))
    r, lb, rb = r[order], lb[order], nxt[order] - 1
    depth = lcp[r]
    head = np.ones(len(r), dtype=bool)
    head[1:] = (lb[1:] != lb[:-1]) | (depth[1:] != depth[:-1])
    tail = np.append(head[1:], True)
    g = np.cumsum(head) - 1
    # children: the one that starts the interval, and one from every boundary on
    lo = np.concatenate([lb[head], r])
    hi = np.concatenate([r[head] - 1, np.where(tail, rb, np.append(r[1:], 0) - 1)])
    group = np.concatenate([g[head], g])
    order = np.lexsort((lo, lo - hi, group))  # the largest child first
    small = np.ones(len(order), dtype=bool)
    small[0] = False
    small[1:] = group[order][1:] == group[order][:-1]
    child = order[small]
    heads = np.flatnonzero(head)
    lo, hi, of = lo[child], hi[child], heads[group[child]]
    cut = np.concatenate([[0], np.cumsum(hi - lo + 1)])
    a = 0
    while a < len(child):
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + CELLS, side="right")) - 1)
        size = hi[a:b] - lo[a:b] + 1
        k = np.repeat(np.arange(a, b), size)
        i = sa[lo[k] + np.arange(len(k)) - np.repeat(cut[a:b] - cut[a], size)]
        d = depth[of[k]]
        for j, ok in ((i + d, i + d < end[i]), (i - d, i - d >= begin[i])):
            x = np.flatnonzero(ok)
            y = isa[j[x]]
            kx = k[x]
            hit = ((y >= lb[of[kx]]) & (y <= rb[of[kx]])) & ~((y >= lo[kx]) & (y <= hi[kx]))
            x = x[hit]
            yield np.minimum(i[x], j[x]), d[x]
        a = b


def find_runs(tokens: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES):
    """(document, start, length, period) of all runs, by document and start;
    ``first`` bounds the documents in ``tokens``."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    keep = np.flatnonzero(repeats_window(tokens, first, least - least // times))
    if not len(keep):
        return none
    size = np.diff(first)[keep]
    bound = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(keep)), size)
    tokens = tokens[np.arange(bound[-1]) - bound[doc] + first[keep][doc]]
    begin, end = bound[doc], bound[doc + 1]
    _, word = np.unique(tokens, return_inverse=True)
    word = word.astype(np.int64)
    sa, isa = suffix_array(doc * (int(word.max()) + 1) + word, end)
    lcp = lcp_array(word, sa, begin, end)
    starts, lengths, periods = [], [], []
    for i, d in branching_squares(sa, isa, lcp, begin, end, times):
        turns = np.maximum(least - 2 * d, (times - 2) * d)  # needed to be a run
        x = np.flatnonzero((turns <= 0) | (i - begin[i] >= turns))
        x = x[(turns[x] <= 0) | (word[i[x] - 1] == word[i[x] + d[x] - 1])]
        i, d = i[x], d[x]
        more = extension(word, i, i + d, i - begin[i], -1)
        length = more + 2 * d
        ok = (length >= least) & (length >= times * d)
        starts.append((i - more)[ok])
        lengths.append(length[ok])
        periods.append(d[ok])
    if not sum(map(len, starts)):
        return none
    s, n, d = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    order = np.lexsort((d, n, s))
    s, n, d = s[order], n[order], d[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    s, n, d = s[new], n[new], d[new]
    order = np.lexsort((d, s))
    s, n, d = s[order], n[order], d[order]
    return keep[doc[s]], s - begin[s], n, d


def collapse(data: np.ndarray, offsets: np.ndarray, w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    flag = np.zeros(len(data) + 1, dtype=np.int8)
    flag[w.starts[kept]] = 1
    np.add.at(flag, w.ends[kept], -1)
    at = np.flatnonzero(kept)
    doc = np.searchsorted(w.first, at, side="right") - 1
    gap = w.ends[at[:-1]][doc[1:] == doc[:-1]]  # the byte after a word that another kept one follows
    flag = np.cumsum(flag[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, dtype=bool)
    data = data.copy()
    data[gap] = 0x20
    flag[gap] = True
    ends = np.concatenate([[0], np.cumsum(flag)])[offsets].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.tobytes()),
                                            pa.py_buffer(data[flag].tobytes())).cast(pa.string())


def scan(texts: pa.Array, least: int = LEAST, times: int = TIMES) -> pa.StructArray:
    """(n_words, runs, collapsed) of each text."""
    table, off, data = byte_class("visible"), *buffers(texts)
    counts, runs, out = [], [], []
    for a, b in slices(off):
        own, bounds = data[off[a]: off[b]], off[a: b + 1] - off[a]
        w = Words(own, bounds, table, lower=False)
        doc, s, n, d = find_runs(w.hash, w.first, least, times)
        drop = np.zeros(len(w.hash) + 1, dtype=np.int64)
        np.add.at(drop, w.first[doc] + s + d, 1)
        np.add.at(drop, w.first[doc] + s + n, -1)
        out.append(collapse(own, bounds, w, np.cumsum(drop[:-1]) == 0))
        counts.append(w.counts)
        ends = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
        runs.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (s, n, d)], names=["start", "length", "period"])))
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(counts) if counts else [], pa.int64()),
         pa.concat_arrays(runs) if runs else pa.array([], pa.list_(RUN)),
         pa.concat_arrays(out) if out else pa.array([], pa.string())], names=["n_words", "runs", "collapsed"])


def runs_column(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """A column struct(n_words, runs, collapsed): the periodic runs of a text
    (by start, then period) and the text without a run's repeats: of every run
    the first period stays."""
    @F.arrow_udf(FOUND_DDL)
    def run(texts: pa.Array) -> pa.Array:
        return scan(texts, least, times)

    return run(text.cast("string"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; ties go to
    the smaller start, then the smaller period; null without runs."""
    def better(a: Column, b: Column) -> Column:
        x, y = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(a.isNull() | (x > y), b).otherwise(a)  # runs come by start, then period

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def listed(runs: Column) -> Column:
    """Every run as a line ``start,length,period``."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def looped(docs: DataFrame) -> DataFrame:
    """The contract's texts of ``docs`` (doc_id, text): of a tenth of the ids
    (by CRC-32) the words from one place on are a stretch that starts there,
    over and over.  The words are a column of their own, read several times."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(
        F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    n = F.size("words")
    a = F.pmod("g", F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod("g", F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's report of ``docs`` (doc_id, text)."""
    found = looped(docs).select("doc_id", runs_column(F.col("text")).alias("p"))
    runs = F.col("p.runs")
    return (found.select("doc_id", runs.alias("runs"), strongest(runs).alias("best"), "p.collapsed")
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
