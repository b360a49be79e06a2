"""Sharding by a hierarchical weighted hash tree.

A tree lists its shards as (region, rack, shard, weight).  A row descends it:
at each level every child draws ``-ln(u) / weight`` from a hash of the row's
key and the child's path, and the smallest draw wins, so a child gets rows in
proportion to the weight below it.  A draw depends on the child alone:
changing a weight moves rows only into or out of subtrees whose weight
changed, and a new region takes rows only into itself.

Law ``key``: doc_id and the tree decide.  Defined cases: a null id is the key
"null"; repeated rows share their shard and get a slot each; a null text has
size 1 and the CRC-32 of the empty text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, gapless, unit_draw


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def uniform_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """Equal shards 0, 1, ... under equal racks and regions."""
    return [Leaf(f"r{a}", f"k{b}", (a * racks + b) * shards + c)
            for a in range(regions) for b in range(racks) for c in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``tree`` with one more shard, in a region of its own: no other
    subtree's weight changes, so rows move only into the new shard."""
    number = max(x.shard for x in tree) + 1
    return [*tree, Leaf(f"new{number}", "k0", number, weight)]


def _children(tree: list[Leaf]):
    """The tree as nested (path, weight, children or shard)."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for x in tree:
        if x.weight > 0:
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    return [(r, sum(x.weight for k in racks.values() for x in k),
             [(f"{r}/{k}", sum(x.weight for x in leaves),
               [(f"{r}/{k}/{x.shard}", x.weight, x.shard) for x in leaves])
              for k, leaves in racks.items()]) for r, racks in regions.items()]


def place(key: Column, tree: list[Leaf], seed: int = 0) -> Column:
    """The shard of a key."""
    def descend(children):
        if not isinstance(children, list):
            return F.lit(children).cast("int")
        if len(children) == 1:
            return descend(children[0][2])
        draws = F.array_min(F.array(*[
            F.struct((-F.ln(unit_draw(F.lit(seed), key, F.lit(path))) / F.lit(float(weight))).alias("draw"),
                     F.lit(i).alias("child")) for i, (path, weight, _) in enumerate(children)]))["child"]
        if all(not isinstance(c[2], list) for c in children):
            return F.element_at(F.array(*[descend(c[2]) for c in children]), draws + 1)
        out = F.when(draws == 0, descend(children[0][2]))
        for i, c in enumerate(children[1:], 1):
            out = out.when(draws == i, descend(c[2]))
        return out
    return descend(_children(tree))


def place_sql(key: str, tree: list[Leaf], seed: int = 0) -> str:
    """``place`` as DuckDB SQL; ``key`` is a text expression without nulls."""
    def descend(children):
        if not isinstance(children, list):
            return str(children)
        if len(children) == 1:
            return descend(children[0][2])
        draws = ", ".join(
            f"{{'draw': -ln((('0x' || substr(md5('{seed}:' || {key} || ':{path}'), 1, 12))::bigint + 0.5)"
            f" / 281474976710656.0) / {float(weight)}, 'child': {i}}}" for i, (path, weight, _) in enumerate(children))
        cases = " ".join(f"when {i} then {descend(c[2])}" for i, c in enumerate(children))
        return f"case (list_sort([{draws}]))[1].child {cases} end"
    return descend(_children(tree))


def shard_documents(docs: DataFrame, tree: list[Leaf] | None = None, id_col: str = "doc_id",
                    text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per
    row.  ``slot`` counts the shard's rows by doc_id without a gap;
    ``grown_shard`` is the shard in ``grown(tree)``."""
    tree = tree or uniform_tree()
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        place(F.col(id_col), tree, seed).alias("shard"),
        place(F.col(id_col), grown(tree), seed).alias("grown_shard"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return gapless(placed, order, "slot", by=["shard"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_shard(docs: DataFrame, tree: list[Leaf] | None = None, id_col: str = "doc_id",
               seed: int = 0) -> tuple[DataFrame, str]:
    """``docs`` with its shard as one more column, and that column's name
    (``shard``, or a longer one where ``docs`` has such a column)."""
    name, = fresh(docs, "shard")
    return docs.withColumn(name, place(F.col(id_col), tree or uniform_tree(), seed)), name
