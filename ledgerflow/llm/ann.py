"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less the centroid and scaled to unit length, is rotated at random
and coded by the signs of its coordinates (packed bits), its distance to the
centroid and the inner product of the code with the vector (the correction).
From the bits a query gets an unbiased estimate of its inner product with
every vector, whose error is, but for a probability that falls like
exp(-c * EPSILON^2), within EPSILON * sqrt((1 - ip^2) / ip^2 / (dim - 1)).
A vector is reranked, with its original components in double precision, only
where the estimate's lower distance bound is not above the k-th smallest of
the least upper bounds of the block's distinct ids.

Vectors are dealt into blocks by a hash and queries into blocks of their own;
a task compares one vector block with one query block and returns the best k
of each query, and the best of all blocks are merged.  Nothing is collected;
the centroid is the mean of all vectors.

Defined cases: null, all-zero, empty and non-finite vectors, and rows without
an id, take no part; vectors of different length are never compared; rows
that repeat an id count once, at their smallest distance (exact repeats are
dropped before coding); a query without candidates has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

VECTORS, QUERIES = 2048, 4096  # rows of a block, about
EPSILON = 4.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vec: Column) -> Column:
    return (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists(vec, lambda x: x != 0)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def encode(x: np.ndarray, centre: np.ndarray, rot: np.ndarray):
    """(packed bits, distance to the centroid, correction) of vectors."""
    d = x - centre
    norm = np.sqrt((d * d).sum(axis=1))
    unit = (d / np.where(norm > 0, norm, 1)[:, None]) @ rot
    sign = unit >= 0
    ip = np.where(sign, unit, -unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(sign, axis=1), norm, np.where(norm > 0, ip, 1.0)


def bounds(bits, norm, ip, q: np.ndarray, centre, rot, epsilon: float):
    """(lower, upper) bounds of the squared distances, query by vector."""
    dim = q.shape[1]
    sign = np.unpackbits(bits, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    d = q - centre
    qn = np.sqrt((d * d).sum(axis=1))
    unit = ((d / np.where(qn > 0, qn, 1)[:, None]) @ rot).astype(np.float32)
    est = (unit @ sign.T) / np.sqrt(dim) / ip[None, :]
    err = epsilon * np.sqrt(np.maximum(1 - ip * ip, 0) / (ip * ip) / max(dim - 1, 1))[None, :] + 1e-5
    base = (qn * qn)[:, None] + (norm * norm)[None, :]
    span = 2 * qn[:, None] * norm[None, :]
    return base - span * np.minimum(est + err, 1), base - span * np.maximum(est - err, -1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of one query to vectors, summed in component order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        diff = x[:, j] - q[j]
        total += diff * diff
    return np.sqrt(total)


def _searcher(dim: int, centre: np.ndarray, k: int, epsilon: float):
    rot = rotation(dim)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            ids, x = left.column("vec_id").to_numpy(), matrix(left.column("vec"), dim)
            bits = np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
            norm, ip = left.column("norm").to_numpy(), left.column("ip").to_numpy()
            own, starts = np.unique(ids, return_index=True)
            qids, q = right.column("query_id").to_numpy(), matrix(right.column("vec"), dim)
            for s in range(0, len(qids), 256):
                low, high = bounds(bits, norm, ip, q[s: s + 256], centre, rot, epsilon)
                high = np.minimum.reduceat(high, starts, axis=1)  # an id's rows count once
                for i in range(len(low)):
                    other, ends = ids != qids[s + i], high[i][own != qids[s + i]]
                    limit = np.inf
                    if len(ends) > k:
                        limit = np.partition(ends, k - 1)[k - 1]
                    pick = np.flatnonzero(other & (low[i] <= limit))
                    dist = exact(q[s + i], x[pick])
                    best = np.lexsort((ids[pick], dist))
                    best = best[np.sort(np.unique(ids[pick][best], return_index=True)[1])][:k]
                    out_q.append(np.full(len(best), qids[s + i]))
                    out_v.append(ids[pick][best])
                    out_s.append(dist[best])
        cols = [np.concatenate(c) if c else [] for c in (out_q, out_v, out_s)]
        return pa.table([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other
    vectors by Euclidean distance, ties to the smaller id.  ``is_query`` is a
    condition on vec_id."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
            .groupBy("vec_id", "vec").agg(F.size("vec").alias("dim")))
    rows = cut(rows)
    shapes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(is_query.cast("long")).alias("q")).orderBy("dim").collect()
    parts = [_of_dim(rows.where(F.col("dim") == s.dim).drop("dim"), s.dim, s.n, s.q, is_query, k, epsilon)
             for s in shapes if s.q]
    found = None
    for p in parts:
        found = p if found is None else found.union(p)
    if found is None:
        found = rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def index(rows: DataFrame, dim: int, centre: np.ndarray) -> DataFrame:
    """(vec_id, vec, bits, norm, ip) of every vector."""
    rot = rotation(dim)
    schema = None

    def run(batches):
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(1)]), dim)
            bits, norm, ip = encode(x, centre, rot)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary()),
                 pa.array(norm), pa.array(ip)], names=["vec_id", "vec", "bits", "norm", "ip"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("vec_id", "vec").mapInArrow(
        run, f"vec_id long, vec {kind}, bits binary, norm double, ip double")


def centroid(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    """The mean vector: partial sums in tasks, ``dim`` numbers per task."""
    def run(batches):
        total = np.zeros(dim)
        for batch in batches:
            total += matrix(pa.chunked_array([batch.column(0)]), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total)], names=["j", "s"])

    got = rows.select("vec").mapInArrow(run, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(dim)
    for r in got:
        out[r.j] = r.s / n
    return out


def _of_dim(rows: DataFrame, dim: int, n: int, n_queries: int, is_query: Column, k: int, epsilon: float) -> DataFrame:
    centre = centroid(rows, dim, n)
    v_blocks, q_blocks = -(-n // VECTORS), -(-n_queries // QUERIES)
    coded = cut(index(rows, dim, centre))
    block = lambda width, salt: F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(width)).cast("int")
    every = lambda width: F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    left = coded.withColumn("vb", block(v_blocks, 1)).withColumn("qb", every(q_blocks))
    right = (rows.where(is_query).withColumn("qb", block(q_blocks, 2)).withColumn("vb", every(v_blocks))
             .withColumnRenamed("vec_id", "query_id"))
    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(
        _searcher(dim, centre, k, epsilon), "query_id long, vec_id long, score double")
