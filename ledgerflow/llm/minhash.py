"""Near-duplicate documents: one-permutation MinHash with optimal
densification, banded buckets, star-shaped candidate edges, and an exact
check on the full shingle sets.

1. ``sketch``: one hash per shingle; its top bits choose a bin, the bin keeps
   its minimum.  An empty bin takes the value of a bin drawn by a hash chain
   that depends on the bin and the attempt only (optimal densification), so
   equal bins stay equal with probability J.  Bands of ``ROWS`` bins, as many
   as the threshold needs (``banding``): a pair at the threshold or above
   shares no bucket with probability ``MISS`` at most.
2. Equal sets collapse to one representative (128-bit fingerprint).
3. Every bucket links its members to two centres (the smallest node and a
   pseudo-random one) instead of to each other: at most two edges per member.
4. Candidates are confirmed on their full sets, sent to the centre's groups;
   a large star is dealt over several groups, each with its own copy of the
   centre's set, so that no group holds more than about ``GROUP`` shingles.
5. Buckets whose members are not yet in one component get other centres, and
   only members outside the centre's component are compared, until a round
   finds no link.  Settled buckets leave; components are merged, not found
   again from all links.
6. Buckets that still hold several components are compared in full
   (``rest``): buckets that overlap form a family, and a family's texts are
   compared with each other once, dealt into blocks, every two blocks in a
   task.  Where buckets overlap so little that the family as a whole would
   cost more sets sent than its buckets one by one, the buckets are taken.
   Either way every two texts that share a bucket are compared or in one
   component.
7. Components by star contraction; nothing is collected to the driver.

Tables between steps are written to the shared folder and freed when the next
step is written.

Defined cases: null or wordless text - no shingles, linked with nothing, its
own component; null doc_id - linked with nothing, component null, kept;
very long texts - their whole sets, in memory one slice of texts or one text at
a time; repeated rows - the same component, each kept if its id is the
smallest; rows that share an id but not a text stand for one document; an empty
table gives none; other columns are not read by ``near_duplicates`` and kept by
``keep_first``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, looked_up
from .text import Words, buffers, byte_class, mix64, slices, word_slices

ROWS, MISS = 6, 6e-9
GROUP = 400_000  # shingles of one comparison group
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000  # texts and shingles of a family's block, about
SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()),
                    ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SKETCH_DDL = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def banding(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """The fewest bands in which a pair of J = ``percent`` / 100 shares no
    bucket with probability ``miss`` at most (85: 40, 80: 63)."""
    none = math.log1p(-min(percent / 100, 1 - 1e-9) ** rows)
    return math.ceil(math.log(miss) / none)


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash), sorted and distinct, of all shingles of a slice; a text of
    fewer than ``size`` words has its whole sequence as the one shingle."""
    counts = w.counts
    k = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), k)
    if not len(doc):
        return doc, np.zeros(0, dtype=np.uint64)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(w.first[:-1], k)
    length = np.minimum(counts, size)[doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    last = len(w.hash) - 1
    for j in range(size):
        use = length > j
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(use, w.hash[np.minimum(at + j, last)], np.uint64(0))
    h = mix64(h + length.astype(np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def densified(doc: np.ndarray, h: np.ndarray, n_docs: int, bins: int) -> np.ndarray:
    """One-permutation MinHash rows with optimal densification."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((n_docs, bins), empty, dtype=np.uint64)
    bin_ = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = doc * bins + bin_
    order = np.lexsort((h, cell))
    cell, hv = cell[order], h[order]
    lead = np.ones(len(cell), dtype=bool)
    lead[1:] = cell[1:] != cell[:-1]
    sig.reshape(-1)[cell[lead]] = hv[lead]
    r, c = np.nonzero((sig == empty) & (sig != empty).any(axis=1)[:, None])
    full = sig != empty
    attempt = 1
    while len(r):
        src = (mix64(c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                     + np.uint64(attempt * 0xC2B2AE3D27D4EB4F % (1 << 64))) % np.uint64(bins)).astype(np.int64)
        hit = full[r, src]
        sig[r[hit], c[hit]] = sig[r[hit], src[hit]]
        r, c = r[~hit], c[~hit]
        attempt += 1
    return sig


def sketcher(size: int, bands: int, rows: int):
    table = byte_class("visible")

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, w in word_slices(batch.column(1), table):
                doc, h = shingle_hashes(w, size)
                n = np.bincount(doc, minlength=b - a)
                has = n > 0
                sig = densified(doc, h, b - a, bands * rows)
                key = np.zeros((b - a, bands), dtype=np.uint64)
                part = sig.reshape(b - a, bands, rows)
                for j in range(rows):
                    key = key * np.uint64(0x9FB21C651E98DF25) + part[:, :, j]
                key = mix64(key + np.arange(1, bands + 1, dtype=np.uint64)[None, :]
                            * np.uint64(0x9E3779B97F4A7C15))
                f1, f2 = np.zeros(b - a, dtype=np.uint64), np.zeros(b - a, dtype=np.uint64)
                at = np.flatnonzero(has)
                if len(at):
                    starts = (np.cumsum(n) - n)[at]
                    f1[at] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    f2[at] = np.add.reduceat(mix64(h + np.uint64(0x14057B7EF767814F)), starts)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)),
                    pa.array(f2.view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)),
                        pa.array(key[has].reshape(-1).view(np.int64)))], schema=SKETCH)
    return run


def set_sender(size: int):
    """Rows (node, groups) with text -> one row per group with the text's set."""
    table = byte_class("visible")
    schema = pa.schema([("centre", pa.int64()), ("salt", pa.int64()), ("side", pa.int32()), ("node", pa.int64()),
                        ("hashes", pa.binary())])

    def run(batches):
        for batch in batches:
            node, groups = batch.column(0), batch.column(2)
            off, data = buffers(batch.column(1))
            for a, b in slices(off):
                doc, h = shingle_hashes(Words(data[off[a]: off[b]], off[a: b + 1] - off[a], table), size)
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                out, held = [], 0
                for i in range(b - a):
                    blob = h[ends[i]: ends[i + 1]].tobytes()
                    for g in groups[a + i].as_py():
                        out.append((g["centre"], g["salt"], g["side"], node[a + i].as_py(), blob))
                        held += len(blob)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
    return run


def confirmer(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(key, table):
        centre = key[0].as_py()
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        middle = [sets[i] for i in np.flatnonzero(nodes == centre)]
        u, v = [], []
        for i in np.flatnonzero(nodes != centre):
            for m in middle:
                both = int(np.isin(sets[i], m, assume_unique=True).sum()) if len(m) else 0
                if both and 100 * both >= percent * (len(sets[i]) + len(m) - both):
                    u.append(centre)
                    v.append(int(nodes[i]))
                    break
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)
    return run


def all_pairs(percent: int):
    """The linked texts of a group: those of side 0 compared with those of
    side 1, or with each other where there is one side only.  One edge per text
    to the first of those that links reach."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(key, table):
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        side = table.column("side").to_numpy()
        m, n = len(sets), np.array([len(x) for x in sets])
        top = np.flatnonzero(side == 0) if (side == 0).any() else np.arange(m)
        left = np.flatnonzero(side == 1) if (side == 0).any() and (side == 1).any() else top
        _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, col = np.repeat(np.arange(m), n), (np.cumsum(often > 1) - 1)[at]
        shared = often[at] > 1  # a shingle of one text is in no intersection
        order = np.argsort(col[shared], kind="stable")
        row, col = row[shared][order], col[shared][order]
        both = np.zeros((len(top), len(left)), np.float32)
        width = 2048
        for s in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, [s, s + width])
            part = np.zeros((m, width), np.float32)
            part[row[a:b], col[a:b] - s] = 1
            both += part[top] @ part[left].T
        linked = np.zeros((m, m), bool)
        for i, r in enumerate(top):
            one = both[i].astype(np.int64)
            ok = left[(one > 0) & (100 * one >= percent * (n[r] + n[left] - one))]
            linked[r, ok] = linked[ok, r] = True
        u, v, seen = [], [], np.zeros(m, bool)
        for i in range(m):
            todo = [] if seen[i] else [i]
            seen[i] = True
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & ~seen)
                seen[new] = True
                todo.extend(new.tolist())
                u += [int(nodes[i])] * len(new)
                v += nodes[new].tolist()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)
    return run


def hubs_of(members: DataFrame, turn: int) -> DataFrame:
    """Two centres of every bucket that holds more than one component."""
    def least(salt):
        mask = F.xxhash64("key", F.lit(turn), F.lit(salt)).bitwiseAND((1 << 62) - 1) if salt else F.lit(0).cast("long")
        return F.min(F.struct(F.col("node").bitwiseXOR(mask).alias("order"), "node", "comp", "low", "high"))

    return (members.groupBy("key")
            .agg(least(1 if turn else 0).alias("c1"), least(2).alias("c2"),
                 F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "c1", "c2"))


def star_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's centre and a member, a < b, that
    lie in different components and whose set sizes allow the threshold."""
    c = F.explode(F.array("c1", "c2")).alias("c")
    first = F.col("node") < F.col("c.node")
    return (stars.select("node", "comp", "low", "high", c).where(f"""node <> c.node and comp <> c.comp
                and 100L * high >= {percent}L * c.low and 100L * c.high >= {percent}L * low""")
            .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"),
                    F.when(first, F.col("high")).otherwise(F.col("c.high")).alias("n_a"),
                    F.when(first, F.col("c.high")).otherwise(F.col("high")).alias("n_b")).distinct())


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be a ``node`` of ``wanted``, by a bit map
    of hashed ids: only their texts are shuffled by the join that follows.
    Eight bits an id; the map, which is broadcast, stays under 32 MiB (from
    32 million ids on it lets more texts pass)."""
    bits = 1 << min(28, max(16, (8 * wanted.count()).bit_length()))
    h = F.pmod(F.xxhash64(F.col("node")), F.lit(bits))
    marks = (wanted.select(F.shiftright(h, 6).cast("int").alias("slot"),
                           F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {bits}) & 63 as int))").alias("bit"))
             .groupBy("slot").agg(F.bit_or("bit").alias("mask")))
    own = docs.withColumn("at", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(bits)))
    return (own.join(F.broadcast(marks), F.shiftright("at", 6).cast("int") == F.col("slot"))
            .where("(shiftrightunsigned(mask, cast(at & 63 as int)) & 1) = 1").select("doc_id", "text"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, work: Scratch) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose full shingle sets are similar enough,
    as (u, v).  The smaller node of a pair is the centre."""
    sized = pairs.withColumnsRenamed({"a": "centre", "b": "node"})
    width = work.keep(sized.groupBy("centre").agg(
        F.ceil((F.sum("n_b") + F.max("n_a")) / GROUP).cast("long").alias("salts")), "width")
    # only large stars are looked up: fewer than the shingles compared / GROUP
    large = width.where("salts > 1")
    dealt = looked_up(sized, large, ["centre"], large.count(), "left").select(
        "centre", "node", F.expr("pmod(xxhash64(node), coalesce(salts, 1L))").alias("salt"))
    own = width.select("centre", F.col("centre").alias("node"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    to = (dealt.unionByName(own).groupBy("node")
          .agg(F.collect_list(F.struct("centre", "salt", F.lit(0).alias("side"))).alias("groups")))
    return sent(work.keep(to, "to"), docs, size).applyInArrow(confirmer(percent), "u long, v long").distinct()


def sent(to: DataFrame, docs: DataFrame, size: int):
    """The sets of the texts, by the groups (centre, salt) that ``to`` sends them to."""
    texts = likely(docs, to).join(to, F.col("doc_id") == F.col("node")).select("node", "text", "groups")
    sets = texts.mapInArrow(set_sender(size), "centre long, salt long, side int, node long, hashes binary")
    return sets.groupBy("centre", "salt")


def rest_groups(members: DataFrame, work: Scratch) -> DataFrame:
    """Which groups (``groups`` of centre, salt, side) the texts of buckets
    that hold several components are sent to, so that every two texts of a
    bucket meet: (node, groups)."""
    def blocks(count, shingles):
        return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("long")

    own = work.keep(members.groupBy("key", "node").agg(F.max("high").alias("n")), "rest-members")
    buckets = (own.groupBy("key")
               .agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.min("node").alias("hub"),
                    F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"))
               .where("c > 2")  # a pair is a star
               .groupBy("c", "s", "x1", "x2").agg(F.min("key").alias("key"), F.min("hub").alias("hub"))  # the same members
               .select("key", "hub", blocks("c", "s").alias("blocks"), (F.col("c") * blocks("c", "s")).alias("sends")))
    buckets = work.keep(buckets, "rest-buckets")
    n_buckets = buckets.count()
    own = looked_up(own, buckets, ["key"], n_buckets)
    family = components(own.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    family = work.keep(family.select("node", F.col("comp").alias("family")), "rest-family")
    by_bucket = (buckets.join(family.withColumnRenamed("node", "hub"), "hub").groupBy("family")
                 .agg(F.sum("sends").alias("sends")))
    sizes = own.groupBy("node").agg(F.max("n").alias("n")).join(family, "node")
    whole = (sizes.groupBy("family").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
             .select("family", blocks("c", "s").alias("all_blocks"), (F.col("c") * blocks("c", "s")).alias("all_sends"))
             .join(by_bucket, "family")
             .select("family", F.when(F.col("all_sends") <= F.col("sends"), F.col("all_blocks")).alias("all_blocks")))
    whole = work.keep(whole, "rest-whole")
    n_whole = whole.count()
    placed = looked_up(family, whole, ["family"], n_whole)
    one = placed.where("all_blocks is not null").select(
        "node", F.col("family").alias("centre"), F.col("all_blocks").alias("blocks"), F.lit(0).alias("kind"))
    several = own.join(placed.where("all_blocks is null").select("node"), "node").select(
        "node", F.col("key").alias("centre"), "blocks", F.lit(1).alias("kind"))
    groups = F.expr("transform(sequence(0L, blocks - 1), j -> struct(centre as centre, "
                    "2 * (least(own, j) * blocks + greatest(own, j)) + kind as salt, int(own > j) as side))")
    return (one.unionByName(several).withColumn("own", F.expr("pmod(xxhash64(node, centre), blocks)"))
            .select("node", groups.alias("g")).groupBy("node").agg(F.flatten(F.collect_list("g")).alias("groups")))


def rest(members: DataFrame, docs: DataFrame, size: int, percent: int, work: Scratch) -> DataFrame:
    """Links (u, v) inside the buckets that hold several components after the
    stars, every two texts compared."""
    to = work.keep(rest_groups(members, work), "rest-to")
    return sent(to, docs, size).applyInArrow(all_pairs(percent), "u long, v long").distinct()


def merged(comps: DataFrame | None, links: DataFrame, work: Scratch, name: str) -> tuple[DataFrame, int]:
    """Components (node, comp) after further links between nodes, and their
    number of rows."""
    if comps is None:
        comps = work.keep(components(links), name)
        return comps, comps.count()
    n = comps.count()
    for end in ("u", "v"):
        at = comps.withColumnsRenamed({"node": end, "comp": "at"})
        links = (looked_up(links, at, [end], n, "left").withColumn(end, F.coalesce("at", end)).drop("at"))
    new = work.keep(components(links).select(F.col("node").alias("comp"), F.col("comp").alias("now")), "merged")
    old = looked_up(comps, new, ["comp"], new.count(), "left").select("node", F.coalesce("now", "comp").alias("comp"))
    others = new.withColumnRenamed("comp", "node").join(comps, "node", "left_anti").select("node", F.col("now").alias("comp"))
    comps = work.keep(old.unionByName(others), name)
    return comps, comps.count()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 5, percent: int = 85, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.
    Links: 100 * intersection >= ``percent`` * union of the shingle sets."""
    bands, work = banding(percent, rows), Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = work.keep(docs.mapInArrow(sketcher(size, bands, rows), SKETCH_DDL)
                       .withColumn("row", F.monotonically_increasing_id()), "sketch")
    linkable = sketch.where("n_shingles > 0 and doc_id is not null")
    copies = work.keep(linkable.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("c"),
                                                        F.min(F.struct("doc_id", "row")).alias("r"))
                       .where("c > 1").select("f1", "f2", F.col("r.doc_id").alias("rep"), F.col("r.row").alias("lead")),
                       "copies")
    n_copies = copies.count()

    def tagged(*cols: str) -> DataFrame:
        """Rows with their set's representative; one row of each set is in the lead."""
        return looked_up(linkable.select(*cols, "f1", "f2", "row"), copies, ["f1", "f2"], n_copies, "left").select(
            *cols, F.coalesce("rep", "doc_id").alias("rep"), F.expr("coalesce(lead, row) = row").alias("leads"))

    # one document whose rows differ in text ties their classes together
    same_id = (tagged("doc_id").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
               .where("lo <> hi").select("doc_id"))
    ties = work.keep(tagged("doc_id").join(same_id, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
                     .distinct(), "ties")
    entries = tagged("doc_id", "n_shingles", "bands").where("leads").select(
        F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowded = work.keep(entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                        .where("lo <> hi").select("key"), "crowded")
    # an id whose rows differ in text has sets of several sizes
    members = work.keep(looked_up(entries, crowded, ["key"], crowded.count()).groupBy("node", "key")
                        .agg(F.min("n").alias("low"), F.max("n").alias("high"))
                        .withColumn("comp", F.col("node")), "members")
    mixed = (members.groupBy("node").agg(F.min("low").alias("all_low"), F.max("high").alias("all_high"))
             .where("all_low <> all_high"))
    mixed = work.keep(mixed, "mixed")
    n_mixed = mixed.count()
    if n_mixed:
        members = looked_up(members, mixed, ["node"], n_mixed, "left").select(
            "node", "key", "comp", F.coalesce("all_low", "low").alias("low"), F.coalesce("all_high", "high").alias("high"))
    comps, tested, turn, stars = None, None, 0, None
    while True:
        hubs = work.keep(hubs_of(members, turn), "hubs")
        n_hubs = hubs.count()
        if not n_hubs:
            stars = None
            break
        stars = work.keep(looked_up(members, hubs, ["key"], n_hubs), f"stars{turn % 2}")
        pairs = star_pairs(stars, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = work.keep(pairs, f"pairs{turn}")
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        found = work.keep(confirmed(pairs, docs, size, percent, work), "found")
        if turn and found.isEmpty():
            break
        comps, n_comps = merged(comps, found if turn else found.union(ties), work, f"comps{turn % 2}")
        members = looked_up(stars.drop("comp", "c1", "c2"), comps, ["node"], n_comps, "left").withColumn(
            "comp", F.coalesce("comp", "node"))
        turn += 1
    if stars is not None:
        members = stars.drop("c1", "c2")
        comps, _ = merged(comps, work.keep(rest(members, docs, size, percent, work), "found"), work, "comps-last")
    elif comps is None:
        comps, _ = merged(None, ties, work, "comps-last")
    work.free("members", "crowded", "stars0", "stars1", "to", *(("rest-members", "rest-to") if stars is not None else ()))
    via = looked_up(tagged("doc_id", "n_shingles").drop("leads"),
                    comps.select(F.col("node").alias("rep"), F.col("comp").alias("via")), ["rep"], comps.count(), "left")
    one = F.coalesce("via", "rep")
    other = sketch.where("not (n_shingles > 0 and doc_id is not null)").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = via.select("doc_id", "n_shingles", one.alias("component_id"))
    return (linked.unionByName(other)
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group of near duplicates (J of ``percent``
    / 100 or more): of the row(s) with the group's smallest id, the one that
    comes first as JSON.  Rows with a null id stay."""
    keep, row, rows = fresh(docs, "__keep", "__row", "__rows")
    found = near_duplicates(docs, id_col, text_col, percent=percent).where("kept and doc_id is not null")
    work = Scratch(docs.sparkSession)
    wanted = work.keep(found.groupBy(F.col("doc_id").alias(keep)).agg(F.count(F.lit(1)).alias(rows)), "wanted")
    named = docs.join(wanted, docs[id_col].cast("long") == F.col(keep))
    once = named.where(F.col(rows) == 1).select(*docs.columns)
    again = (named.where(F.col(rows) > 1).select(keep, F.struct(*docs.columns).alias(row)).groupBy(keep)
             .agg(F.min_by(row, F.to_json(row)).alias(row)).select(f"{row}.*"))
    out = once if wanted.where(F.col(rows) > 1).isEmpty() else once.unionByName(again)
    return out.unionByName(docs.where(F.col(id_col).isNull()))
