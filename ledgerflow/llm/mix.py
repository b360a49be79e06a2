"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate: target share times output size over the
source's documents.  A document's copies are the inverse of the Poisson
distribution with that mean at a draw hashed from the seed and its id, so the
expected mix is the target and a rerun makes the same copies.  Copies are
exploded and shuffled globally by a hash of (seed, id, copy).

DataFrame functions only.  Sources are counted with partial aggregation and
their small rate table is broadcast behind a check of its rows (beyond it: a
shuffle join), so a hot source is never gathered.

Defined cases: null is a source of its own; a source that ``weights`` does
not list has share 0; a null id draws as "null"; repeated rows draw alike and
are replicated each; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, gapless, unit_draw

BROADCAST_SOURCES = 100_000


def hash_key(*parts: Column) -> Column:
    """60 bits of an MD5 of the parts, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None,
          temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate, cdf): the mean repetitions of each source and
    its Poisson distribution function from 0 on.  Target shares are
    ``weights`` (normalised), or in proportion to n_docs ** temperature; the
    expected output is ``epochs`` times the documents."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        wanted = counts.withColumn("want", F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature))))
    else:
        want = F.lit(0.0)
        for name, weight in weights.items():
            want = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(want)
        wanted = counts.withColumn("want", want)
    total = wanted.agg(F.sum("n_docs").alias("all_docs"), F.sum("want").alias("all_want"))
    rated = wanted.crossJoin(F.broadcast(total)).select(  # one row
        "source", "n_docs",
        F.when(F.col("all_want") > 0, F.lit(float(epochs)) * F.col("all_docs") * F.col("want")
               / F.col("all_want") / F.col("n_docs")).otherwise(0.0).alias("rate"))
    # terms until the tail is below 2^-48; logs, so that no rate underflows
    last = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 20).cast("int")
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = (rated.select("*", F.explode(F.sequence(F.lit(0), last)).alias("k"))
             .withColumn("log_k", F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(up_to))
             .withColumn("p", F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate")
                                                              - F.col("log_k")))
                         .otherwise((F.col("k") == 0).cast("double")))
             .withColumn("c", F.sum("p").over(up_to)))
    return (terms.groupBy("source", "n_docs", "rate")
            .agg(F.sort_array(F.collect_list("c")).alias("cdf")))


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
           weights: dict | None = None, temperature: float = 0.5, epochs: float = 1.0,
           seed: int = 0, names: tuple[str, str, str, str] = ("copy", "n_copies", "rate", "shuffle_key")) -> DataFrame:
    """``docs`` once per copy, with copy (0, 1, ...), n_copies, rate and
    shuffle_key as further columns under ``names``."""
    copy, n_copies, rate, key = names
    table = cut(rates(docs, source_col, weights, temperature, epochs)
                .select(F.col("source").alias("__src"), F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf")))
    small = table.count() <= BROADCAST_SOURCES
    draw = unit_draw(F.lit(seed), F.col(id_col))
    drawn = (docs.join(F.broadcast(table) if small else table, docs[source_col].eqNullSafe(table["__src"]))
             .withColumn(n_copies, F.size(F.filter("__cdf", lambda c: c <= draw)))
             .where(F.col(n_copies) > 0)
             .withColumn(rate, F.col("__rate")).drop("__src", "__rate", "__cdf")
             .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1))))
    return drawn.withColumn(key, hash_key(F.lit(f"shuffle{seed}"), F.col(id_col), F.col(copy)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None,
        temperature: float = 0.5, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row per copy, in globally
    shuffled order (range partitions of the shuffle key, sorted)."""
    names = tuple(fresh(docs, "__copy", "__n", "__rate_of", "__key"))
    out = copies(docs, id_col, source_col, weights, temperature, epochs, seed, names)
    keys = [F.col(names[3]), F.col(id_col), F.col(names[0])]
    return out.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*names)


def mix_plan(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, source, copy, n_copies, rate, position): every copy and its
    place in the global shuffle, counted from 0 without a gap."""
    narrow = docs.select(F.col(kw.pop("id_col", "doc_id")).alias("doc_id"),
                         F.col(kw.pop("source_col", "source")).alias("source"))
    out = copies(narrow, **kw)
    placed = gapless(out, [F.col("shuffle_key"), F.col("doc_id"), F.col("copy")], "position")
    return placed.select("doc_id", "source", "copy", "n_copies", F.round("rate", 6).alias("rate"), "position")
