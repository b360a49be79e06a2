"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features: 1- to 3-grams of the lower-cased letters of a text (a run of other
characters is one space), hashed into ``CELLS`` cells; sub-linear term
frequency times inverse document frequency, scaled to unit length.  Document
frequencies are counted over every training document.  The weights come from
follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties on a
bounded sample (about ``PER_LANG`` documents of each language, chosen by a hash
of the id), and are then divided by a temperature that makes the held-back
fifth of the sample most likely.

Defined cases: a null text or one without a letter is ``und`` with score 0;
null languages teach nothing; without any labelled row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share

CELLS = 1 << 15
PER_LANG = 1_500
MAX_LANGS = 1_000  # the model holds CELLS weights for each
FEATURES = pa.list_(pa.struct([("cell", pa.int32()), ("tf", pa.float32())]))


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters one space."""
    low = text.lower()
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ascii_letter = (cp >= 97) & (cp <= 122)
    high = np.flatnonzero(cp >= 128)
    is_letter = ascii_letter
    if len(high):
        kinds, inverse = np.unique(cp[high], return_inverse=True)
        is_letter = ascii_letter.copy()
        is_letter[high] = np.array([chr(k).isalpha() for k in kinds.tolist()], dtype=bool)[inverse]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]  # the first of a run of others
    out = np.where(is_letter, cp, 32)[keep]
    return np.concatenate([[32], out, [32]]).astype(np.uint64)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, sub-linear term frequencies) of a text; none without letters."""
    c = letters(text) if text else np.zeros(0, np.uint64)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    grams, h = [], c
    for n in range(1, 4):
        if n > 1:
            h = (h[:-1] << np.uint64(21)) | c[n - 1:]
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)))
    count = np.bincount(np.concatenate(grams).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(count)
    return cells, (1 + np.log(count[cells])).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weight: np.ndarray  # CELLS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, cells: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v = tf * self.idf[cells]
        return v / max(float(np.sqrt((v * v).sum())), 1e-9)

    def predict(self, text: str | None) -> tuple[str, float]:
        cells, tf = terms(text)
        if not len(cells) or not self.langs:
            return "und", 0.0
        p = softmax((self.vector(cells, tf) @ self.weight[cells] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates; returns (weights, bias)."""
    z, n = np.zeros((CELLS + 1, k)), np.zeros((CELLS + 1, k))

    def weights(c):
        zc = z[c]
        return np.where(np.abs(zc) <= l1, 0.0, -(zc - np.sign(zc) * l1) / ((beta + np.sqrt(n[c])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            cells, v = rows[i]
            c, x = np.append(cells, CELLS), np.append(v, 1.0)
            w = weights(c)
            err = softmax(x @ w)
            err[y[i]] -= 1.0
            g = x[:, None] * err[None, :]
            sigma = (np.sqrt(n[c] + g * g) - np.sqrt(n[c])) / alpha
            z[c] += g - sigma * w
            n[c] += g * g
    w = weights(np.arange(CELLS + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least negative log-likelihood (a search on a log grid)."""
    def loss(t):
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    return float(min(grid, key=loss)) if len(y) else 1.0


def _features():
    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("pick", pa.int64()), ("features", FEATURES)])
        for batch in batches:
            lang, pick = batch.column(0), batch.column(1)
            for i, t in enumerate(batch.column(2)):
                cells, tf = terms(t.as_py())
                if len(cells):
                    f = pa.StructArray.from_arrays([pa.array(cells.astype(np.int32)), pa.array(tf)],
                                                   names=["cell", "tf"])
                    yield pa.RecordBatch.from_arrays(
                        [lang.slice(i, 1), pick.slice(i, 1),
                         pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), f)], schema=schema)
    return run


def _document_frequencies():
    schema = pa.schema([("cell", pa.int32()), ("docs", pa.int64())])

    def run(batches):
        df = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                cells, _ = terms(t.as_py())
                df[cells] += 1
                df[CELLS] += len(cells) > 0
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], schema=schema)
    return run


def fit(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learn from the rows of ``docs`` for which ``train`` holds."""
    rows = docs.where(F.col(lang_col).isNotNull())
    if train is not None:
        rows = rows.where(train)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("pick"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
              .limit(MAX_LANGS + 1).collect()}
    if not counts:
        return Model([], np.ones(CELLS), np.zeros((CELLS, 0)), np.zeros(0))
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    df = np.zeros(CELLS + 1)
    for r in (rows.select("text").mapInArrow(_document_frequencies(), "cell int, docs long")
              .groupBy("cell").agg(F.sum("docs").alias("docs")).collect()):  # at most CELLS + 1 rows
        df[r.cell] = r.docs
    idf = (np.log((1 + df[CELLS]) / (1 + df[:CELLS])) + 1).astype(np.float32)
    bound = F.lit(0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, per_lang / n))).otherwise(bound)
    got = (rows.where(F.col("pick") < bound).select("lang", "pick", "text")
           .mapInArrow(_features(), "lang string, pick long, features array<struct<cell:int,tf:float>>").toArrow())
    langs = sorted(counts)
    lists = got.column("features").combine_chunks()
    if not len(lists):
        return Model([], idf, np.zeros((CELLS, 0)), np.zeros(0))
    off = lists.offsets.to_numpy()
    cell, tf = lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
    y = np.array([langs.index(x) for x in got.column("lang").to_pylist()])
    pick = got.column("pick").to_numpy()
    model = Model(langs, idf, np.zeros((CELLS, len(langs))), np.zeros(len(langs)))
    order = np.lexsort((off[:-1], y, pick))
    rows_ = [(cell[off[i]: off[i + 1]], model.vector(cell[off[i]: off[i + 1]], tf[off[i]: off[i + 1]]))
             for i in order]
    y, part = y[order], pick[order] % 5 == 4
    learn = [i for i in range(len(y)) if not part[i]]
    if learn:
        model.weight, model.bias = ftrl([rows_[i] for i in learn], y[learn], len(langs))
    held = np.flatnonzero(part)
    if len(held):
        logits = np.array([v @ model.weight[c] + model.bias for c, v in (rows_[i] for i in held)])
        model.temperature = best_temperature(logits, y[held])
    model.weight = model.weight.astype(np.float32)
    return model


def predict_column(spark, model: Model, text_col: str = "text") -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = share(spark, model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = shared()
        got = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()),
                                           pa.array([g[1] for g in got], pa.float64())],
                                          names=["lang_pred", "score"])
    return predict(F.col(text_col).cast("string"))
