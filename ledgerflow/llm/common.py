"""Shared helpers: checkpoints, gapless numbering, hash draws."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder (a URI) that all executors share: ``spark.checkpoint.dir``
    of the session.  A local folder is made only where none is set and the
    session is local (tests)."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="llm-ckpt-"))
        return sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 1_000_000  # narrow rows of numbers, counted before they are broadcast


class Scratch:
    """Tables that a job writes to the shared folder: ``keep`` writes a table
    and reads it again (its lineage is cut), over the table that the same name
    held before; ``free`` leaves nothing but an empty file of it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def free(self, *names: str) -> None:
        for name in names:
            self.keep(self.spark.createDataFrame([], "freed int"), name)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n_rows: int, how: str = "inner",
              salts: int = 8) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key, ``n_rows`` in all) on
    columns of the same names.  A table of ``BROADCAST_ROWS`` at most is
    broadcast, so ``rows`` stay where they are; a larger one is dealt
    ``salts`` times, so that one key's rows lie in several tasks."""
    if n_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    salt, = fresh(rows.join(table.limit(0), keys, how), "__salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, salt], how).drop(salt)


def share(spark: SparkSession, model):
    """Broadcast a model's fields; returns a function that rebuilds it in a
    task (the class travels by value, its fields as plain data).  Its ``drop``
    gives the broadcast up, once nothing reads it any more."""
    fields, kind = spark.sparkContext.broadcast(model.__dict__), type(model)

    def get():
        out = object.__new__(kind)
        out.__dict__.update(fields.value)
        return out
    return Shared(get, fields)


class Shared:
    """A shared model: called, it is rebuilt."""

    def __init__(self, get, fields):
        self.get, self.fields = get, fields

    def __call__(self):
        return self.get()

    def drop(self) -> None:
        self.fields.destroy()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def crc_text(c: str | Column) -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(F.col(c).cast("string").cast("binary") if isinstance(c, str)
                   else c.cast("string").cast("binary"))


def unit_draw(*parts: Column) -> Column:
    """A draw in (0, 1) that depends on nothing but ``parts`` (as text): the
    first 48 bits of an MD5, centred so that neither end is reached."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
            + 0.5) / float(2 ** 48)


def gapless(df: DataFrame, order: list[Column], out: str, by: list[str] | None = None) -> DataFrame:
    """Number the rows of each ``by`` group 0, 1, 2, ... in ``order``.

    Rows are range-partitioned and sorted on (by, order), written once to the
    checkpoint folder, and numbered by their place in the partition plus the
    rows of the group in earlier partitions (one count per partition and
    group).  A hot group spreads over many partitions, and equal keys too:
    the row's place in the input breaks ties, so no key is indivisible.
    """
    by = by or []
    tie, place, pid, pos, cnt, first, before = fresh(
        df, "__tie", "__place", "__pid", "__pos", "__cnt", "__first", "__before")
    ranged = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [F.col(b) for b in by] + order + [F.col(tie)]
    ranged = cut(ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
                 .withColumn(place, F.monotonically_increasing_id()))
    here = (ranged.withColumn(pid, F.shiftright(place, 33))
            .withColumn(pos, F.col(place).bitwiseAND((1 << 33) - 1)))
    parts = here.groupBy(*by, pid).agg(F.count(F.lit(1)).alias(cnt), F.min(pos).alias(first))
    # one row per partition and group that meets it: at most partitions + groups rows
    a, b = parts.alias("a"), parts.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by],
                  F.col(f"b.{pid}") < F.col(f"a.{pid}"))
    if by:
        from pyspark.sql import Window
        w = Window.partitionBy(*by).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
        offs = parts.withColumn(before, F.coalesce(F.sum(cnt).over(w), F.lit(0)))
    else:
        offs = (a.join(F.broadcast(b), same, "left").groupBy(F.col(f"a.{pid}").alias(pid),
                                                            F.col(f"a.{first}").alias(first))
                .agg(F.coalesce(F.sum(f"b.{cnt}"), F.lit(0)).alias(before)))
    offs = offs.select(*[F.col(c).alias("__by_" + c) for c in by],
                       F.col(pid).alias("__opid"), first, before)
    cond = reduce(lambda x, y: x & y, [here[c].eqNullSafe(offs["__by_" + c]) for c in by],
                  here[pid] == offs["__opid"])
    return (here.join(F.broadcast(offs), cond)
            .select(*[here[c] for c in df.columns if c != out],
                    (here[pos] - offs[first] + offs[before]).alias(out)))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an edge list: (node, comp) with comp the
    smallest node of the component, for every node that has an edge.

    Alternating large-star / small-star rounds: every round re-hangs edges on
    smaller nodes by a group minimum (partially aggregated), looked up without
    moving the edges while the minima are few, else dealt so that a node of
    many edges lies in several tasks.  Each round's edges are written and the
    round before freed.  Only one checksum row reaches the driver.
    """
    work = Scratch(edges.sparkSession)
    cur = work.keep(edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v"))
                    .where("u <> v").distinct(), "edges0")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                     .first())

    before, turn = mark(cur), 0
    while before[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = work.keep(looked_up(both, low, ["u"], 2 * before[0]).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small = looked_up(large, large.groupBy("u").agg(F.min("v").alias("m")), ["u"], before[0])
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v")))
        turn += 1
        cur = work.keep(hung.where("u <> v").distinct(), f"edges{turn % 2}")
        now = mark(cur)
        if now == before:
            break
        before = now
    if turn:
        work.free("large")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
