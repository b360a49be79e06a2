"""Personal data by bootstrapped contextual extraction (DataFrame functions
only).

1. Seeds: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
   numbers found by patterns in the whole text; their spans always stay.
2. Slots: every token that holds a digit or ``@`` after a word that holds
   neither.  A slot's lexical patterns are the word before it, the word after
   it (if that holds neither, too) and both; the token (or the seed that it
   belongs to) is its instance.
3. The pattern-instance graph is scored in rounds.  A pattern is induced for a
   kind by at least ``SUPPORT`` distinct instances that are seeds of the kind
   or that the rounds before accepted; its confidence is the mean score of its
   distinct instances for the kind (seeds have score 1), and it counts above
   ``TRUST``.  An unknown instance scores the noisy-or of its patterns.
4. Unknown instances whose score for a kind reaches ``ACCEPT`` and that look
   like an identifier are accepted: they induce further patterns in the next
   round, and after the last become spans of their best kind.

Edges are aggregated per (pattern, instance) before they are joined, so a
common word or a repeated passage counts each of its instances once and no
text or document list is gathered.

The patterns are written with possessive quantifiers and look-behinds that
keep matches the same but make matching linear in the text.

Defined cases: a null text is empty; repeated rows are reported each; a null
doc_id is reported like any other; without seeds nothing is induced; an empty
table gives no rows; kinds may overlap, and a slot that any seed overlaps gets
no further span; equal scores go to the kind listed first; other columns,
whatever their names, are ignored.  A text is scanned whole in one task; its
matches are put in place in runs of ``RUN``, so time grows with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    # a match begins where a run of local characters does, or where the last match ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of 14 to 19 digits with single separators
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SLOT = r"(?<!\S)[^\s0-9@]++\s++(?=[^\s0-9@]*+[0-9@])\S++"
SUPPORT, TRUST, ACCEPT, ROUNDS = 20, 0.5, 0.9, 3
RUN = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, next>> of all matches, in code points;
    ``next`` is what follows up to the end of the next match."""
    kind = "array<struct<start:int,end:int,match:string,next:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["m"].alias("match"),
            F.concat_ws("", x["after"], x["then"]).alias("next")))).alias("out")))

    def run(pairs: Column, i: Column) -> Column:
        """A run's matches, counted from the end of the run before."""
        return F.aggregate(F.slice(pairs, i * RUN + 1, F.lit(RUN)), zero, step)

    def join(acc: Column, one: Column) -> Column:
        moved = F.transform(one["out"], lambda x: F.struct(
            (x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["match"].alias("match"),
            x["next"].alias("next")))
        return F.struct((acc["at"] + one["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    def placed(hits: Column, between: Column) -> Column:
        pairs = F.arrays_zip(hits.alias("m"), between.alias("b"), F.slice(between, F.lit(2), F.size(between)).alias("after"),
                             F.slice(hits, F.lit(2), F.size(hits)).alias("then"))
        return let(pairs, lambda z: F.aggregate(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(z) - 1) / RUN).cast("int")), lambda i: run(z, i)), zero, join)["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(
        F.size(hits) > 0, let(F.split(text, pattern, -1), lambda between: placed(hits, between)))
        .otherwise(F.array().cast(kind)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """The Luhn check of a digit string."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0), lambda acc, i: acc + (
        lambda d: F.when((F.length(c) - i) % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))(
            F.substring(c, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":  # a part's value, whatever its leading zeros
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(
            "^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def seeds(text: Column) -> Column:
    """array<struct<start, rank, end, match>> of the base spans, sorted by
    start, then kind."""
    def of(rank: int, kind: str) -> Column:
        good = F.filter(found(text, PATTERNS[kind]), lambda x: valid(kind, x["match"]))
        return F.transform(good, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["match"].alias("match")))

    parts = [of(i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def slots(text: Column) -> Column:
    """array<struct<start, end, word, after, token>> of the slots."""
    return F.transform(found(text, SLOT), lambda x: F.struct(
        (x["end"] - F.length(F.regexp_extract(x["match"], r"(\S+)$", 1))).alias("start"), x["end"].alias("end"),
        F.lower(F.regexp_extract(x["match"], r"^(\S+)", 1)).alias("word"),
        F.lower(F.regexp_extract(x["next"], r"^\s++([^\s0-9@]++)(?!\S)", 1)).alias("after"),
        F.regexp_extract(x["match"], r"(\S+)$", 1).alias("token")))


def spell(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1), s["start"], s["end"])), ",")


def identifier(c: Column) -> Column:
    """The token looks like one: six digits or more, or a name at a host."""
    return (F.length(digits(c)) >= 6) | c.rlike(r"^[^@]+@[^@]+$")


def induce(edges: DataFrame, support: int = SUPPORT, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """(instance, rank): unknown instances accepted as a kind.  ``edges``:
    distinct (pattern, instance, rank), rank null for unknown instances."""
    size = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    seeded = cut(edges.where("rank is not null").groupBy("pattern", "rank").agg(F.count(F.lit(1)).alias("sure"))
                 .withColumn("mass", F.col("sure").cast("double")))
    unknown = cut(edges.where("rank is null").select("pattern", "instance").join(size.select("pattern"), "pattern"))
    scores = None
    for _ in range(rounds):
        patterns = seeded
        if scores is not None:
            more = unknown.join(scores, "instance").groupBy("pattern", "rank").agg(
                F.sum(F.col("taken").cast("long")).alias("sure"), F.sum("score").alias("mass"))
            patterns = seeded.unionByName(more).groupBy("pattern", "rank").agg(
                F.sum("sure").alias("sure"), F.sum("mass").alias("mass"))
        trust = (patterns.where(F.col("sure") >= support).join(size, "pattern")
                 .select("pattern", "rank", (F.col("mass") / F.col("n")).alias("trust")).where(F.col("trust") > TRUST))
        score = 1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))
        scores = cut(unknown.join(trust, "pattern").groupBy("instance", "rank").agg(score.alias("score"))
                     .withColumn("taken", (F.col("score") >= accept) & identifier(F.col("instance"))))
    return (scores.where("taken")
            .groupBy("instance").agg(F.max(F.struct("score", (-F.col("rank")).alias("rank"))).alias("best"))
            .select("instance", (-F.col("best.rank")).alias("rank")))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
            accept: float = ACCEPT) -> DataFrame:
    """(doc_id, seeds, spans): per row the base spans and all spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = rows.select("doc_id", seeds(F.col("text")).alias("seeds"), slots(F.col("text")).alias("slots"))
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    at = base.select("row", "seeds", F.explode("slots").alias("s"))
    owner = F.filter("seeds", lambda x: (x["start"] < F.col("s.end")) & (x["end"] > F.col("s.start")))
    at = at.withColumn("owner", F.get(owner, F.lit(0))).select(
        "row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.word", "s.after",
        F.coalesce("owner.match", "s.token").alias("instance"), F.col("owner.rank").alias("rank"))
    word, after = F.col("word"), F.when(F.col("after") != "", F.col("after"))
    contexts = F.array(F.concat(word, F.lit(" _")), F.concat(F.lit("_ "), after), F.concat(word, F.lit(" _ "), after))
    edges = cut(at.select(F.explode(F.array_compact(contexts)).alias("pattern"), "instance", "rank")
                .groupBy("pattern", "instance").agg(F.max("rank").alias("rank")))
    new = induce(edges, support, accept).withColumnRenamed("rank", "new_rank")
    more = (at.where("rank is null").select("row", "start", "end", "instance").join(new, "instance")
            .groupBy("row").agg(F.collect_list(F.struct(
                "start", F.col("new_rank").alias("rank"), "end", F.col("instance").alias("match"))).alias("more")))
    more = more.withColumnRenamed("row", "of_row")
    return (base.join(more, F.col("row") == F.col("of_row"), "left")
            .select("doc_id", "seeds", F.when(F.col("more").isNull(), F.col("seeds")).otherwise(
                F.array_sort(F.concat("seeds", "more"))).alias("spans")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, per row."""
    out = extract(docs, id_col, text_col)

    def number(rank: int) -> Column:
        return F.size(F.filter("seeds", lambda s: s["rank"] == rank)).cast("long")

    count = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *count, F.sha2(spell(F.col("seeds")).cast("binary"), 256).alias("base_sha256"),
                      spell(F.col("spans")).alias("spans"))
