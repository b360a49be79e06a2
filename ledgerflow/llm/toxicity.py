"""Toxicity by class-conditional Kneser-Ney models over words and word pairs.

The class is the history: a class's counts are discounted absolutely, and the
discounted mass goes to one backoff distribution that both classes share,
    P(x | c) = max(n_c(x) - D_c, 0) / N_c + L_c * P_cont(x),
for expressions x of one order (words, or pairs of consecutive words).  Both
classes are modelled alike:

* d_c(x) is the number of the class's training documents that hold x, N_c their
  sum over all x.  n_c(x) is the smaller of d_c(x) and of the number of distinct
  words that x follows in the class: Kneser-Ney's type count, so a passage that
  is copied, exactly or nearly, counts about once.
* D_c is modified Kneser-Ney's absolute discount: one each for counts of 1, of 2
  and of 3 or more, from the class's counts of counts over all its expressions
  (d_c of 1 to 4; ``FALLBACK`` where they do not give discounts above 0).
* P_cont(x) is the continuation probability: the distinct words that x follows
  in all documents, labelled or not, by the distinct (word before, x) of all x.
* The models are pruned, as n-gram models of corpora are: x keeps its counts, in
  both classes, if it departs in one of them, that is if n_c(x) exceeds what the
  other class explains.  With up(k) = k + SIGMAS * sqrt(k + 1), what sampling
  may add to a count of k, that is up(LIFT * N_c / N_o * up(d_o(x))) for the
  other class o.  A pruned x has the probability L_c * P_cont(x) in both models.
* L_c, the class's own backoff weight, is what the discounts and the pruned
  counts leave: 1 less the discounted counts of the kept x by N_c, so that each
  model sums to 1.

A word counts by its pair with the word before, if that pair is kept, and backs
off to the word alone otherwise.  A document's evidence is the difference of the
two log-likelihoods of all its words (a word that is not kept adds
log(L_toxic / L_ordinary)) divided by their number; a logistic curve, fitted on
about ``FIT_ROWS`` labelled rows (each scored without its own counts), turns it
into a score.

``fit`` also has the discount "explained": D_c(x) is all that the other class
explains, and L, the discounted share of the pooled counts, serves both classes.

Nothing is capped or hashed into cells: keys are 64-bit hashes (words even,
pairs odd), counts, counts of counts and distinct neighbours exact sums over
partial aggregates.  Only the two normalisers of P_cont are estimated, from the
``SKETCH`` smallest hashes of their terms (exact up to that many, 3 % beyond).
The expressions that are kept form a table that stays distributed and grows with
the corpus; it is sent to the tasks in blocks of about ``BLOCK_ROWS`` rows, one
at a time.

Words: lower-cased A-Z, runs of digits, ASCII letters and non-ASCII
characters.  Defined cases: a null or wordless text has no evidence (the
curve's value at 0); a text of any length is scanned whole, alone in its slice;
repeated rows count as often as they occur; a document with conflicting labels
counts as toxic if one label says so, a null label or id is no label; without
labelled rows every score is about 0, with labels of one class about 0 or 1;
an empty table gives an empty result; other columns are kept, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, cut, fresh
from .text import byte_class, mix64, word_slices

BROADCAST_LABELS = 1_000_000
FIT_ROWS = 20_000  # labelled rows, about, that the logistic curve is fitted on
SIGMAS, LIFT = 2.0, 2.0
FALLBACK = (0.5, 1.0, 1.5)  # discounts of counts of 1, 2, 3 or more without usable counts of counts
THRESHOLD = 0.7
BLOCK_ROWS = 2_000_000
SKETCH = 1024
HELD = 1_000_000  # keys that a task holds before it passes their counts on

_TOP = np.uint64(0xFFFF << 48)  # a pair shares these bits, and so its block, with its second word
_ONE = np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def expressions(w) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a slice: the key of the word, the key of its pair with the
    word before (0 at a text's start), and the hashes of the words before
    either (0 where there is none)."""
    h = w.hash
    starts = w.first[:-1][np.diff(w.first) > 0]
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[starts] = 0
    earlier = np.zeros_like(h)
    earlier[1:] = before[:-1]
    earlier[starts] = 0
    pair = (h & _TOP) | (mix64(before * _STEP + h) & ~_TOP) | _ONE
    pair[starts] = 0
    return h & ~_ONE, pair, before, earlier


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _leads(*cols: np.ndarray) -> np.ndarray:
    """Places at which sorted columns change."""
    new = np.ones(len(cols[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _counter():
    """(text, label) -> documents of either class that hold an expression; under
    the keys 0 and 1 the sums over all words and all pairs."""
    table = byte_class("alnum")

    def run(batches):
        held, size = [], 0
        mass = np.zeros((2, 2), dtype=np.int64)

        def merged():
            key, t, o = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(key, kind="stable")
            key, t, o = key[order], t[order], o[order]
            at = _leads(key)
            return key[at], np.add.reduceat(t, at), np.add.reduceat(o, at)

        def rows(key, t, o):
            for s in range(0, len(key), 100_000):
                e = s + 100_000
                yield pa.RecordBatch.from_arrays([_long(key[s:e]), pa.array(t[s:e]), pa.array(o[s:e])],
                                                 names=["key", "t", "o"])

        for batch in batches:
            label = batch.column(1).to_numpy()
            for a, b, w in word_slices(batch.column(0), table):
                word, pair, _, _ = expressions(w)
                doc = np.repeat(np.arange(a, b), w.counts)
                key, doc = np.concatenate([word, pair]), np.concatenate([doc, doc])
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                once = _leads(key, doc)
                once = once[key[once] != 0]
                if not len(once):
                    continue
                toxic = label[doc[once]] == 1
                key, at = key[once], _leads(key[once])
                np.add.at(mass, ((key & _ONE).astype(np.int64), (~toxic).astype(np.int64)), 1)
                held.append((key[at], np.add.reduceat(toxic.astype(np.int64), at),
                             np.add.reduceat((~toxic).astype(np.int64), at)))
                size += len(at)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        held.append((np.arange(2, dtype=np.uint64), mass[:, 0], mass[:, 1]))
        yield from rows(*merged())
    return run


def _finder(keys: np.ndarray):
    """Place of each wanted key in ``keys`` (sorted), or -1."""
    seen = np.zeros(1 << 20, dtype=bool)
    seen[(keys >> np.uint64(1)) & np.uint64((1 << 20) - 1)] = True

    def find(wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, dtype=np.int64)
        maybe = np.flatnonzero(seen[(wanted >> np.uint64(1)) & np.uint64((1 << 20) - 1)])
        if len(maybe) and len(keys):
            at = np.minimum(np.searchsorted(keys, wanted[maybe]), len(keys) - 1)
            hit = keys[at] == wanted[maybe]
            out[maybe[hit]] = at[hit]
        return out
    return find


def _neighbours(keys, sketch: bool):
    """(text, label) -> the words that wanted expressions follow, as
    (key, word before, label); with ``sketch`` also the smallest hashes of all
    (word before, expression), labelled -2 for words and -3 for pairs."""
    table = byte_class("alnum")

    def run(batches):
        find = _finder(keys.value)
        low = {-2: np.zeros(0, np.uint64), -3: np.zeros(0, np.uint64)}
        for batch in batches:
            label = batch.column(1).to_numpy()
            for a, b, w in word_slices(batch.column(0), table):
                word, pair, before, earlier = expressions(w)
                doc = np.repeat(np.arange(a, b), w.counts)
                for kind, key, left in ((-2, word, before), (-3, pair, earlier)):
                    if sketch:
                        term = mix64(left + mix64(key) * _STEP)[key != 0]
                        if len(low[kind]) == SKETCH:
                            term = term[term < low[kind][-1]]
                        low[kind] = np.unique(np.concatenate([low[kind], term]))[:SKETCH]
                    hit = np.flatnonzero(find(key) >= 0)
                    k, l, c = key[hit], left[hit], label[doc[hit]]
                    order = np.lexsort((c, l, k))
                    k, l, c = k[order], l[order], c[order]
                    at = _leads(k, l, c)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [_long(k[at]), _long(l[at]), pa.array(c[at].astype(np.int32))],
                            names=["key", "left", "label"])
        for kind, terms in low.items():
            if len(terms):
                yield pa.RecordBatch.from_arrays(
                    [_long(terms), _long(np.zeros_like(terms)), pa.array(np.full(len(terms), kind, np.int32))],
                    names=["key", "left", "label"])
    return run


def _blocks(table: DataFrame, rows: int) -> list[DataFrame]:
    n = max(1, -(-rows // BLOCK_ROWS))
    if n == 1:
        return [table]
    return [table.where(F.pmod(F.shiftrightunsigned("key", 48), F.lit(n)) == k) for k in range(n)]


def _total(terms: DataFrame, kind: int) -> float:
    """Distinct terms, from the smallest ``SKETCH`` of their hashes."""
    got = np.sort(np.array([r.key for r in terms.where(F.col("label") == kind).select("key").distinct()
                            .orderBy(F.col("key") < 0, "key").limit(SKETCH).collect()], np.int64).view(np.uint64))
    if len(got) < SKETCH:
        return float(max(len(got), 1))
    return (SKETCH - 1) * 2.0 ** 64 / float(got[-1])


def _up(k: Column) -> Column:
    return k + SIGMAS * F.sqrt(k + 1)


def _discount(other: Column, mass: str, other_mass: str) -> Column:
    """The largest count that ``other``, the other class's count, explains."""
    return _up(LIFT * F.col(mass) / F.col(other_mass) * _up(other))


def _excesses(t: Column, tc: Column, o: Column, oc: Column) -> tuple[Column, Column]:
    return (F.greatest(F.least(t, tc) - _discount(o, "mass_t", "mass_o"), F.lit(0.0)),
            F.greatest(F.least(o, oc) - _discount(t, "mass_o", "mass_t"), F.lit(0.0)))


def discounts(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney's discounts of counts of 1, 2, 3 or more, from the
    numbers of expressions that are counted 1, 2, 3 and 4 times."""
    if not all(n):
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return found if min(found) > 0 else FALLBACK


def _discounted(n: Column, by_size: str) -> Column:
    """A count less the discount of its size, an item of the array ``by_size``."""
    less = F.get(F.col(by_size), (F.least(n, F.lit(3)) - 1).cast("int"))
    return F.greatest(n - F.coalesce(less, F.lit(0.0)), F.lit(0.0))


def _kept(t: Column, tc: Column, o: Column, oc: Column) -> tuple[Column, Column]:
    """Both classes' counts after the absolute discount, if one of them departs."""
    over = _excesses(t, tc, o, oc)
    departs = over[0] + over[1] > 0
    return (F.when(departs, _discounted(F.least(t, tc), "less_t")).otherwise(0.0),
            F.when(departs, _discounted(F.least(o, oc), "less_o")).otherwise(0.0))


def _ratio(excess: tuple[Column, Column]) -> Column:
    """log P(x | toxic) - log P(x | ordinary)."""
    back = F.col("cont") / F.col("terms")
    return F.log((excess[0] / F.col("mass_t") + F.col("back_t") * back)
                 / (excess[1] / F.col("mass_o") + F.col("back_o") * back))


@dataclass
class Model:
    """The expressions that depart in a class, as a table (key, r, rt, ro): the
    log ratio, and what it is without one toxic or one ordinary document.
    ``rest`` is the log ratio of every other word."""
    table: DataFrame | None = None
    rows: int = 0
    rest: float = 0.0
    slope: float = 0.0
    level: float = -40.0


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
              train: Column | None) -> DataFrame:
    """(text, label): label 1 or 0 for labelled training rows, else -1."""
    given = (labels.where("toxic is not null and doc_id is not null")
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.max("toxic") > 0).cast("int").alias("__toxic")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if train is not None:
        given = given.where(train)
    small = labels.count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(given) if small else given, F.col("doc_id") == F.col("__id"), "left").select(
        "text", F.coalesce("__toxic", F.lit(-1)).alias("label"))


def _counts_of_counts() -> list[Column]:
    """How many words (0) and pairs (1) 1 to 4 documents of a class hold."""
    return [F.count(F.when((F.col(c) == n) & (F.col("kind") == kind) & ~F.col("key").between(0, 1), 1))
            .alias(f"{c}{kind}{n}") for c in "to" for kind in (0, 1) for n in (1, 2, 3, 4)]


def departing(rows: DataFrame, discount: str = "explained") -> tuple[DataFrame | None, int, float]:
    """The model's table over (text, label) rows, its number of rows, and the
    log ratio of a word that is not in it."""
    if discount not in ("absolute", "explained"):
        raise ValueError(f"no such discount: {discount}")
    spark, work = rows.sparkSession, Scratch(rows.sparkSession)
    counts = (rows.where("label >= 0").mapInArrow(_counter(), "key long, t long, o long")
              .groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
              .withColumn("kind", F.col("key").bitwiseAND(1)))
    seen = Observation()
    counts = counts.observe(seen, *_counts_of_counts())
    # what no more than two documents of a class hold departs in none, whatever the masses
    counts = work.keep(counts.where((F.col("key").between(0, 1)) | (F.greatest("t", "o") > SIGMAS)), "counts")
    mass = {r.kind: r for r in counts.where(F.col("key").between(0, 1)).collect()}
    if not mass or min(mass[0].t, mass[0].o) == 0:
        work.free("counts")
        return None, 0, 0.0

    def by_kind(of) -> Column:
        return F.when(F.col("kind") == 0, F.lit(float(of(0)))).otherwise(F.lit(float(of(1))))

    def held(field):
        return by_kind(lambda k: getattr(mass[k], field) or 1 if k in mass else 1)

    weighed = counts.where(~F.col("key").between(0, 1)).withColumn("mass_t", held("t")).withColumn("mass_o", held("o"))
    t, o = F.col("t"), F.col("o")
    wanted = cut(weighed.where((t > _discount(o, "mass_t", "mass_o")) | (o > _discount(t, "mass_o", "mass_t"))))
    work.free("counts")
    n = wanted.count()
    if not n:
        return None, 0, 0.0
    parts, totals = [], {}
    for k, block in enumerate(_blocks(wanted, n)):
        keys = np.sort(block.select("key").toArrow().column("key").to_numpy().view(np.uint64))
        sent = spark.sparkContext.broadcast(keys)
        found = (rows.mapInArrow(_neighbours(sent, k == 0), "key long, left long, label int")
                 .groupBy("key", "left", F.when(F.col("label") < -1, F.col("label")).otherwise(0).alias("label"))
                 .agg(F.max((F.col("label") == 1).cast("long")).alias("tc"),
                      F.max((F.col("label") == 0).cast("long")).alias("oc")))
        found = work.keep(found, f"found{k}")
        if k == 0:
            totals = {0: _total(found, -2), 1: _total(found, -3)}
        parts.append(found.where("label = 0").groupBy("key").agg(
            F.count(F.lit(1)).alias("cont"), F.sum("tc").alias("tc"), F.sum("oc").alias("oc")))
        sent.unpersist()
    table = parts[0]
    for p in parts[1:]:
        table = table.union(p)
    tc, oc = F.col("tc"), F.col("oc")
    table = wanted.join(table, "key")
    if discount == "absolute":
        excesses = _kept
        for c in "to":
            less = [F.array(*[F.lit(d) for d in discounts([seen.get[f"{c}{kind}{k}"] for k in (1, 2, 3, 4)])])
                    for kind in (0, 1)]
            table = table.withColumn(f"less_{c}", F.when(F.col("kind") == 0, less[0]).otherwise(less[1]))
    else:
        excesses = _excesses
    both = excesses(t, tc, o, oc)
    table = table.withColumn("over_t", both[0]).withColumn("over_o", both[1]).where("over_t + over_o > 0")
    over = {r.kind: r for r in table.groupBy("kind").agg(
        F.sum("over_t").alias("t"), F.sum("over_o").alias("o")).collect()}

    def backoff(c: str, k: int) -> float:
        if k not in mass or k not in over:
            return 1.0
        if discount == "absolute":
            return 1 - getattr(over[k], c) / getattr(mass[k], c)
        return max(0.1, 1 - (over[k].t + over[k].o) / max(1, mass[k].t + mass[k].o))

    table = (table.withColumn("terms", by_kind(lambda k: totals[k]))
             .withColumn("back_t", by_kind(lambda k: backoff("t", k)))
             .withColumn("back_o", by_kind(lambda k: backoff("o", k)))
             .select("key", _ratio(both).alias("r"),
                     _ratio(excesses(t - (t > 0).cast("int"), tc - (tc > 0).cast("int"), o, oc)).alias("rt"),
                     _ratio(excesses(t, tc, o - (o > 0).cast("int"), oc - (oc > 0).cast("int"))).alias("ro")))
    table = cut(table)
    work.free(*[f"found{k}" for k in range(len(parts))])
    return table, table.count(), float(np.log(backoff("t", 0) / backoff("o", 0)))


def _block_evidence(spark, block: DataFrame, rest: float, first: bool):
    """A function of texts and labels (-1: score as they are): the evidence that
    one block of the model gives beyond ``rest``, the log ratio of a word outside
    the model (the first block adds it for all words), and the broadcast that it
    uses."""
    got = block.orderBy(F.col("key") < 0, "key").toArrow()
    model = {c: got.column(c).to_numpy() for c in ("key", "r", "rt", "ro")}
    model["key"] = model["key"].view(np.uint64)
    base = rest if first else 0.0
    sent, table = spark.sparkContext.broadcast(model), byte_class("alnum")

    @F.arrow_udf("double")
    def evidence(texts: pa.Array, labels: pa.Array) -> pa.Array:
        m = sent.value
        find, label = _finder(m["key"]), labels.to_numpy(zero_copy_only=False)
        by_label = np.stack([m["r"], m["ro"], m["rt"]]) - rest
        out = np.zeros(len(texts))
        for a, b, w in word_slices(texts, table):
            word, pair, _, _ = expressions(w)
            at, whole = find(word), find(pair)
            at = np.where(whole >= 0, whole, at)
            hit = np.flatnonzero(at >= 0)
            doc = a + np.searchsorted(w.first, hit, side="right") - 1
            np.add.at(out, doc, by_label[label[doc] + 1, at[hit]])
            out[a:b] = out[a:b] / np.maximum(w.counts, 1) + np.where(w.counts > 0, base, 0.0)
        return pa.array(out, pa.float64())
    return evidence, sent


def with_evidence(docs: DataFrame, model: Model, out: str, text: Column, label: Column) -> DataFrame:
    """``docs`` with the evidence of each text; a model of several blocks goes
    over the documents block by block, each block's sum written before the next."""
    df, name = docs.withColumn(out, F.lit(0.0)), out
    if model.table is None:
        return df
    blocks = _blocks(model.table, model.rows)
    for k, block in enumerate(blocks):
        evidence, sent = _block_evidence(docs.sparkSession, block, model.rest, k == 0)
        df = df.withColumn(name, F.col(name) + evidence(text, label))
        if k < len(blocks) - 1:
            df = cut(df)
            sent.unpersist()
    return df


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", fit_rows: int = FIT_ROWS, discount: str = "explained") -> Model:
    """Count over all rows of ``docs``; ``train`` (a condition on ``__id``)
    says whose labels may be used, ``discount`` ("absolute" or "explained")
    what the counts lose."""
    rows = _labelled(docs, labels, id_col, text_col, train)
    model = Model(*departing(rows, discount))
    known = rows.where("label >= 0")
    n = known.count()
    if not n:
        return model
    # the curve, on about fit_rows labelled rows chosen by a hash of their text
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, fit_rows / n))
    got = with_evidence(known.where(drawn), model, "z", F.col("text"), F.col("label")).select("z", "label").toArrow()
    model.slope, model.level = logistic(got.column("z").to_numpy(), got.column("label").to_numpy())
    return model


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and level of a one-variable logistic regression (Newton's
    method, a small ridge on the slope)."""
    if not len(y) or y.min() == y.max():
        return 0.0, 40.0 if len(y) and y[0] else -40.0
    scale = z.std() or 1.0
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    beta = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (y - p) - [1e-2 * beta[0], 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, g)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1])


def with_score(docs: DataFrame, model: Model, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the toxicity score of each text."""
    z, = fresh(docs, "__evidence")
    x = F.greatest(F.least(F.lit(model.slope) * F.col(z) + F.lit(model.level), F.lit(40.0)), F.lit(-40.0))
    found = with_evidence(docs, model, z, F.col(text_col).cast("string"), F.lit(-1))
    return found.withColumn(out, 1 / (1 + F.exp(-x))).drop(z)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score is below the threshold; all columns as they were."""
    name, = fresh(docs, "__toxicity")
    return with_score(docs, model, name, text_col).where(F.col(name) < threshold).drop(name)
