"""Joins: enrichment of facts from dimensions, pair lookup, and the
null-safe join-back used by the skew-safe window operators.

No join here hard-codes a broadcast of data that grows with the input: the
dimension sides are aggregates whose size depends on the number of keys, so
the strategy is left to the optimizer and AQE (which turns a sort-merge join
into a broadcast join when the runtime size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits skewed
partitions of the fact side otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .aggregate import build_dimension


def join_back(left: DataFrame, right: DataFrame, keys: list[str],
              how: str = "left") -> DataFrame:
    """Join ``right`` (unique on ``keys``) to ``left`` with NULL-safe key
    equality and keep one copy of the keys.  NULL keys match NULL keys, the
    way a window partition groups NULLs together."""
    tmp = {k: f"__jk{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(tmp)
    cond = None
    for k, t in tmp.items():
        c = left[k].eqNullSafe(r[t])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*tmp.values())


def enrich(facts: DataFrame, dim: DataFrame, fact_key: str,
           dim_key: str = "dim_account", keep_key: bool = False) -> DataFrame:
    """Left equi-join of facts to a dimension; every fact row is kept once
    (the dimension is unique on its key), unmatched rows get NULLs."""
    out = facts.join(dim, facts[fact_key] == dim[dim_key], "left")
    return out if keep_key else out.drop(dim[dim_key])


def network_dimension(edges: DataFrame, key: str = "Source", weight: str = "Weight",
                      label: str = "fraud") -> DataFrame:
    """Per edge endpoint (``Source`` or ``Target``): edge count, weight sum and
    mean, fraudulent-edge count."""
    return build_dimension(edges, key, weight, label)


def latest_edge_per_pair(edges: DataFrame, src: str, dst: str, order: list[str],
                         values: list[str]) -> DataFrame:
    """One edge per (src, dst): the greatest by ``order`` (lexicographic,
    descending = "last read wins" made deterministic).

    ``max_by`` over a struct is an ordinary aggregate, so it is computed
    partially before the shuffle: a pair with a third of all edges reduces
    to one row per map task.
    """
    ordkey = F.struct(*[col(c) for c in order])
    payload = F.struct(*[col(c) for c in values])
    picked = (edges.groupBy(col(src).alias(src), col(dst).alias(dst))
              .agg(F.max_by(payload, ordkey).alias("__v")))
    return picked.select(src, dst, *[F.col(f"__v.{v}").alias(v) for v in values])


EDGE_VALUES = {"dim_type": ("typeTrans", "NONE"), "dim_weight": ("Weight", 0.0)}


def enrich_pair(facts: DataFrame, edges: DataFrame, fact_src: str, fact_dst: str,
                order: list[str], edge_src: str = "Source", edge_dst: str = "Target",
                values: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """Pair lookup: attach the edge matching (fact_src, fact_dst) that is the
    greatest by ``order`` (a total order of a pair's edges, else the pick
    among ties depends on the layout).

    ``values`` maps output column -> (edge column, default on miss).  Facts
    without an edge keep their row with the defaults; edges without facts
    are dropped.
    """
    values = values or EDGE_VALUES
    edge_cols = [v[0] for v in values.values()]
    latest = latest_edge_per_pair(edges, edge_src, edge_dst, order, edge_cols)
    latest = latest.select(F.col(edge_src).alias("__ps"), F.col(edge_dst).alias("__pd"),
                           *[F.col(c).alias(f"__pv_{c}") for c in edge_cols])
    j = facts.join(latest, (facts[fact_src] == latest["__ps"]) &
                   (facts[fact_dst] == latest["__pd"]), "left")
    outs = [F.coalesce(F.col(f"__pv_{c}"), F.lit(default)).alias(name)
            for name, (c, default) in values.items()]
    keep = [F.col(c) for c in facts.columns]
    return j.select(*keep, *outs)


def lookup_by_account(facts: DataFrame, edges: DataFrame, fact_src: str, fact_dst: str,
                      order: list[str], edge_src: str = "Source", edge_dst: str = "Target",
                      values: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """``enrich_pair`` for keys of equal types, with facts and edges dealt
    together by ``fact_src`` in one exchange, which a window over that column
    shares.  An account's facts and edges lie in one task, so the caller makes
    sure that no account has too many."""
    values = values or EDGE_VALUES
    one = facts.select(F.col(fact_src).alias("__ps"), F.col(fact_dst).alias("__pd"), F.struct(
        *[F.col(c) for c in facts.columns if c not in (fact_src, fact_dst)]).alias("__f"))
    # a NULL key matches nothing
    two = edges.filter(F.col(edge_src).isNotNull() & F.col(edge_dst).isNotNull()).select(
        F.col(edge_src).alias("__ps"), F.col(edge_dst).alias("__pd"),
        F.struct(F.struct(*[col(c) for c in order]).alias("o"),
                 F.struct(*[F.col(c) for c, _ in values.values()]).alias("v")).alias("__e"))
    both = one.unionByName(two, allowMissingColumns=True).repartition("__ps")
    latest = F.max_by("__e.v", "__e.o").over(Window.partitionBy("__ps", "__pd"))
    found = both.withColumn("__v", latest).filter(F.col("__f").isNotNull())
    names = {fact_src: "__ps", fact_dst: "__pd"}
    return found.select(*[F.col(names.get(c, f"__f.{c}")).alias(c) for c in facts.columns],
                        *[F.coalesce(F.col(f"__v.{c}"), F.lit(default)).alias(name)
                          for name, (c, default) in values.items()])
