"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad.  A line's features
describe its characters, its words and its repetition, together with those of
the lines before and after; transitions tie neighbouring labels.  Forward and
backward passes give each line's marginal of being good, and their mean,
weighted by line length, is the document's quality, passed through a logistic
curve fitted on the training documents.

The field is fitted by gradient ascent on the conditional likelihood of a
bounded sample of labelled documents (about ``FIT_DOCS``, chosen by a hash of
the text; a document's label is that of its lines).  Scoring reads every line
of every document.

Defined cases: a null or empty text, or one of blank lines only, has no line
and gets the share of good training documents; without labels of both classes
every score is that share (0.5 without any); conflicting labels of a document
count as good if one says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share
from .text import Words, buffers, byte_class, slices
from .toxicity import logistic

FIT_DOCS = 4_000
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3
SYMBOLS = b"!#$%&*|=<>{}[]\\^~@/+_"


class Lines:
    """Non-blank lines of a slice of texts: features, lengths in bytes, and
    ``first`` (of each text the index of its first line; one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        newline = data == 10
        cut[:n] |= newline
        cut[1:] |= newline
        edges = np.flatnonzero(cut)
        s, e = edges[:-1], edges[1:]

        def total(mask: np.ndarray) -> np.ndarray:
            run = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(mask, out=run[1:])
            return run

        w = Words(data, offsets, byte_class("visible"))
        letters = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
        sums = {k: total(m) for k, m in (
            ("ink", data > 32), ("upper", (data >= 65) & (data <= 90)), ("letter", letters),
            ("digit", (data >= 48) & (data <= 57)), ("symbol", np.isin(data, np.frombuffer(SYMBOLS, np.uint8))),
            ("bar", data == 124), ("stop", (data == 46) | (data == 44)))}
        if not n:
            s = e = np.zeros(0, np.int64)
        keep = np.flatnonzero(sums["ink"][e] > sums["ink"][s]) if n else s
        s, e = s[keep], e[keep]
        self.first = np.searchsorted(s, offsets)
        self.length = e - s
        c = {k: (run[e] - run[s]).astype(np.float64) for k, run in sums.items()}
        a, b = np.searchsorted(w.starts, s), np.searchsorted(w.starts, e)
        words = np.maximum(b - a, 1)
        m = len(w.hash)
        same = np.zeros(m + 1, np.int64)
        if m:
            eq = np.zeros(m, dtype=np.int64)
            eq[1:] = w.hash[1:] == w.hash[:-1]
            np.cumsum(eq, out=same[1:])
        # a word that occurred before in its document
        doc = np.repeat(np.arange(len(offsets) - 1), w.counts)
        order = np.lexsort((w.hash, doc))
        again = np.zeros(m + 1, np.int64)
        if m:
            rep = np.zeros(m, np.int64)
            rep[order[1:]] = (w.hash[order][1:] == w.hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            np.cumsum(rep, out=again[1:])
        # a line whose text occurs elsewhere in its document
        run = np.zeros(m + 1, np.uint64)
        np.cumsum(w.hash * (np.arange(m, dtype=np.uint64) | np.uint64(1)), out=run[1:])
        line_doc = np.searchsorted(offsets, s, side="right") - 1
        seal = np.zeros(m + 1, np.uint64)
        np.cumsum(w.hash, out=seal[1:])
        sign = (seal[b] - seal[a]) + words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        o = np.lexsort((sign, line_doc))
        dup = np.zeros(len(s))
        if len(s) > 1:
            eq = (sign[o][1:] == sign[o][:-1]) & (line_doc[o][1:] == line_doc[o][:-1])
            dup[o[1:]] += eq
            dup[o[:-1]] += eq
        ink = np.maximum(c["ink"], 1)
        self.x = np.stack([
            np.log1p(self.length), np.log1p(b - a), np.minimum(c["ink"] / words, 30) / 10,
            c["upper"] / ink, c["upper"] / ink > 0.5, c["letter"] / ink, c["digit"] / ink, c["symbol"] / ink,
            np.minimum(c["symbol"] / words, 3), c["bar"] > 2, c["stop"] / words,
            (same[b] - same[np.minimum(a + 1, b)]) / words, (again[b] - again[a]) / words, dup > 0,
            data[np.maximum(e - 1, 0)] == 46 if len(s) else np.zeros(0)], axis=1).astype(np.float64)

    def chained(self) -> np.ndarray:
        """Each line's features, its neighbours' and whether it has them."""
        n = len(self.x)
        if not n:
            return np.zeros((0, 3 * self.x.shape[1] + 3))
        has_prev = np.ones(n)
        has_prev[self.first[:-1][self.first[:-1] < n]] = 0
        has_next = np.ones(n)
        ends = self.first[1:] - 1
        has_next[ends[ends >= 0]] = 0
        prev = np.vstack([np.zeros(self.x.shape[1]), self.x[:-1]]) * has_prev[:, None]
        nxt = np.vstack([self.x[1:], np.zeros(self.x.shape[1])]) * has_next[:, None]
        return np.hstack([self.x, prev, nxt, has_prev[:, None], has_next[:, None], np.ones((n, 1))])


def lines_of(texts: pa.Array):
    off, data = buffers(texts)
    for a, b in slices(off):
        yield a, b, Lines(data[off[a]: off[b]], off[a: b + 1] - off[a])


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """P(good) of every line, the expected transitions and the log partition
    sum, by forward and backward passes over all documents at once (the t-th
    lines of all documents together).  ``unary``: score of good against bad."""
    n = len(unary)
    size = np.diff(first)
    score = np.stack([np.zeros(n), unary], axis=1)
    by = np.argsort(-size, kind="stable")
    start, size = first[:-1][by], size[by]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest + 1)]  # documents longer than t
    for t in range(longest):
        i = start[:live[t]] + t
        alpha[i] = score[i] if not t else score[i] + np.logaddexp(
            alpha[i - 1, :1] + trans[0], alpha[i - 1, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        i = start[:live[t + 1]] + t
        nxt = score[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    both = alpha + beta
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - log_z)
    inner = np.ones(n, dtype=bool)
    inner[start[size > 0]] = False
    j = np.flatnonzero(inner)
    pair = (alpha[j - 1][:, :, None] + trans[None] + (score[j] + beta[j])[:, None, :]
            - log_z[j][:, None, None]) if len(j) else np.zeros((0, 2, 2))
    return good, np.exp(pair).sum(axis=0), log_z[start[size > 0]].sum()


@dataclass
class Field:
    weight: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    level: float = 0.0
    prior: float = 0.5

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal per document (nan: no line)."""
        out = np.full(len(lines.first) - 1, np.nan)
        full = np.flatnonzero(np.diff(lines.first))
        if len(full):
            x = (lines.chained() - self.mean) / self.scale
            good, _, _ = marginals(x @ self.weight, self.trans, lines.first)
            at = lines.first[:-1][full]
            out[full] = (np.add.reduceat(good * lines.length, at)
                         / np.add.reduceat(lines.length, at))
        return out

    def score(self, lines: Lines) -> np.ndarray:
        q = self.quality(lines)
        p = np.clip(np.nan_to_num(q, nan=0.5), 1e-4, 1 - 1e-4)
        s = 1 / (1 + np.exp(-np.clip(self.slope * np.log(p / (1 - p)) + self.level, -40, 40)))
        return np.where(np.isnan(q), self.prior, s)


def train(texts: pa.Array, label: np.ndarray, steps: int = 200) -> Field:
    """Fit on labelled texts (1 good, 0 bad) by Adam with a small ridge."""
    parts = [(Lines_, label[a:b]) for a, b, Lines_ in lines_of(texts)]
    width = 3 * 15 + 3
    flat = Field(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), 0.0, 0.0)
    if not len(label) or label.min() == label.max():
        flat.prior = float(label.mean()) if len(label) else 0.5
        flat.level = float(np.log(max(flat.prior, 1e-9) / max(1 - flat.prior, 1e-9)))
        return flat
    x = np.vstack([p.chained() for p, _ in parts])
    y = np.concatenate([np.repeat(lab, np.diff(p.first)) for p, lab in parts]).astype(np.float64)
    sizes = np.concatenate([np.diff(p.first) for p, _ in parts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    x = (x - mean) / scale
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1][sizes > 0]] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[j - 1].astype(int), y[j].astype(int)), 1)
    w, tr = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    n = len(y)
    for k in range(1, steps + 1):
        good, pairs, _ = marginals(x @ w, tr, first)
        grads = x.T @ (y - good) / n - 1e-4 * w, (seen - pairs) / n - 1e-3 * tr
        for i, (value, g) in enumerate(zip((w, tr), grads)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            value += 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    field = Field(w, tr, mean, scale, prior=float(label.mean()))
    q = np.concatenate([field.quality(p) for p, _ in parts])
    ok = ~np.isnan(q)
    p = np.clip(q[ok], 1e-4, 1 - 1e-4)
    field.slope, field.level = logistic(np.log(p / (1 - p)), label[ok])
    return field


def fit(docs: DataFrame, labels: DataFrame, condition: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", fit_docs: int = FIT_DOCS) -> Field:
    """Fit on about ``fit_docs`` labelled documents; ``condition`` (on
    ``__id``) says whose labels may be used."""
    given = (labels.where("quality is not null and doc_id is not null")
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").cast("int").alias("label")))
    if condition is not None:
        given = given.where(condition)
    n = given.count()
    if not n:
        return train(pa.array([], pa.string()), np.zeros(0))
    picked = given.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, fit_docs / n)))
    # the sample is bounded by fit_docs, so it may be broadcast
    got = (docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).cast("string").alias("text"))
           .join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("text", "label").toArrow())
    order = np.argsort(np.array([hash_text(t) for t in got.column("text").to_pylist()]), kind="stable")
    got = got.take(pa.array(order))
    return train(got.column("text").combine_chunks(), got.column("label").to_numpy().astype(np.float64))


def hash_text(t: str | None) -> int:
    import zlib
    return zlib.crc32((t or "").encode("utf-8", "surrogatepass"))


def score_column(spark, field: Field, text_col: str = "text") -> Column:
    """The quality score of a text column."""
    shared = share(spark, field)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        field = shared()
        parts = [field.score(x) for _, _, x in lines_of(texts)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())
    return score(F.col(text_col).cast("string"))
