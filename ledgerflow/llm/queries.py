"""Registered queries of the corpus operators (whole tables, production
parameters) and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, lexical, licenses, minhash, mix, periodic, pii, quality, shard, toxicity, warc
from .common import crc_text, cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco



UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32_sql(hexed: str) -> str:
    """CRC-32 of bytes given as hex digits, four bits at a time (DuckDB has
    no such function)."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform("
            f"regexp_extract_all({hexed}, '..'), lambda x: [('0x' || x[2])::bigint, ('0x' || x[1])::bigint]))), "
            f"lambda a, b: xor(a >> 4, {table}[(xor(a, b) & 15) + 1])))")


OP1_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, coalesce(doc_id::varchar, 'null') as k from documents),
s as (select doc_id, (length(h) // 2 + 1)::bigint as size, {crc32_sql('h')} as text_crc32,
             'key' as law, {shard.place_sql('k', shard.uniform_tree())} as shard,
             {shard.place_sql('k', shard.grown(shard.uniform_tree()))} as grown_shard from d)
select *, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot from s
"""


@query("op1_hash_tree_sharding", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


OP2_SQL = """
with n as (select source, count(*) as n from documents group by source),
r as (select source, sum(n) over () * sqrt(n) / sum(sqrt(n)) over () / n as rate from n),
k as (select source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 20)::bigint + 1)) as k from r),
l as (select *, sum(case when k > 0 then ln(k) else 0 end) over (partition by source order by k) as lk from k),
c as (select source, rate, sum(exp(k * ln(rate) - rate - lk)) over (partition by source order by k) as c from l),
d as (select doc_id, source, (('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint + 0.5)
             / 281474976710656.0 as u from documents),
m as (select d.doc_id, d.source, c.rate, count(*) as n_copies from
        (select *, row_number() over () as row_no from d) d join c on d.source is not distinct from c.source and c.c <= d.u
      group by d.row_no, d.doc_id, d.source, c.rate),
e as (select *, unnest(range(0, n_copies)) as copy from m),
h as (select *, ('0x' || substr(md5('shuffle0:' || coalesce(doc_id::varchar, 'null') || ':' || copy), 1, 15))::bigint as key from e)
select doc_id, source, copy::integer as copy, n_copies::integer as n_copies, round(rate, 6) as rate,
       row_number() over (order by key, doc_id nulls first, copy) - 1 as position from h
"""


@query("op2_poisson_mixing", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source shares in proportion to the square root of their documents."""
    return mix.mix_plan(table(spark, sf_dir, "documents", "doc_id", "source"))


@query("op3_crf_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"),
                        F.pmod(crc_text("__id"), F.lit(5)) != 0)
    return (docs.select("doc_id", (F.pmod(crc_text("doc_id"), F.lit(5)) == 0).alias("held_out"),
                        quality.score_column(spark, field).alias("score"))
            .withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int")))


OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, v.vec_id, min(sqrt(list_reduce(list_prepend(0::double,
        list_transform(range(1, len(q.e) + 1), lambda i: (v.e[i] - q.e[i]) * (v.e[i] - q.e[i]))),
        lambda a, b: a + b))) as score
      from v as q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 100 = 0 group by all)
select query_id, row_number() over (partition by query_id order by score, vec_id)::integer as rank, vec_id, score
from p qualify rank <= 10
"""


@query("op4_rotated_bit_neighbours", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"),
                       F.pmod("vec_id", F.lit(100)) == 0)


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the rows whose labels op5 may use."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"),
                        train=F.pmod(crc_text("__id"), F.lit(3)) != 1, discount="absolute")


@query("op5_kneser_ney_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return (toxicity.with_score(docs, toxicity_model(docs, spark, sf_dir))
            .select("doc_id", (F.pmod(crc_text("doc_id"), F.lit(3)) == 1).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int")))


OP6_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                      '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
reach(a, b) as (select doc_id, doc_id from d union select r.a, e.b from reach r join e on r.b = e.a),
c as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d join c on c.a = d.doc_id left join n on n.doc_id = d.doc_id
"""


@query("op6_minhash_neardup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


OP7_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
                  sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as body from pages),
t as (select *, max(page_id) over (partition by body) as top from p),
r as (select *, payload_bytes >= 1000 and top is not null and page_id is distinct from top as again from t)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
       case when again then top end as refers_to from r
"""


@query("op7_warc_normaliser", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op8_bootstrapped_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def words_sql(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


OP9_SQL = f"""
with recursive d as (select row_number() over () as row_no, doc_id, {words_sql('text')} as w from documents),
b as (select item_id, w, least(13, len(w)) as l from
        (select distinct item_id, {words_sql('text')} as w from benchmark) where len(w) > 0),
win as (select distinct item_id, l, unnest(list_transform(range(1, len(w) - l + 2),
               lambda s: array_to_string(w[s:s + l - 1], ' '))) as g from b),
grams as (select row_no, w, l, unnest(range(1, len(w) - l + 2)) as s from d, (select distinct l from win)),
hit as (select a.row_no, a.s, a.l, win.item_id from grams a join win
          on a.l = win.l and array_to_string(a.w[a.s:a.s + a.l - 1], ' ') = win.g),
pos as (select row_no, count(distinct p) as n_hit from
          (select row_no, unnest(range(s, s + l)) as p from hit) group by row_no),
items as (select row_no, list_sort(list(distinct item_id::varchar)) as ids from hit where item_id is not null group by row_no),
word as materialized (select row_no, unnest(w) as t, unnest(range(1, len(w) + 1)) as p from d),
term as materialized (select g, l, unnest(string_split(g, ' ')) as t, unnest(range(1, l + 1)) as k
                        from (select distinct g, l from win where item_id is not null)),
part as (select row_no, g, l, 1::bigint as k, p, 0::bigint as others from term join word using (t) where k = 1
         union
         select part.row_no, part.g, part.l, term.k, word.p, others + gap
           from part cross join range(0, 3) as gaps(gap) join term on term.g = part.g and term.k = part.k + 1
           join word on word.row_no = part.row_no and word.p = part.p + 1 + gap and word.t = term.t
          where others + gap <= 2),
near as (select row_no, list_sort(list(distinct item_id::varchar)) as near_ids
           from part join win using (g, l) where k = l and item_id is not null group by row_no)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(len(ids), 0)::bigint as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated,
       coalesce(len(near_ids), 0)::bigint as n_near, sha256(coalesce(array_to_string(near_ids, ','), '')) as near_sha256
from d left join pos using (row_no) left join items using (row_no) left join near using (row_no)
"""


@query("op9_positional_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents", "doc_id", "text"),
                           table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op10_ftrl_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs, F.pmod(crc_text("doc_id"), F.lit(4)) != 2)
    return (docs.select("doc_id", (F.pmod(crc_text("doc_id"), F.lit(4)) == 2).alias("held_out"),
                        langid.predict_column(spark, model).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def places_sql(phrase: str) -> str:
    """The starts (from 1) of a phrase in the word list ``w``."""
    test = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {test})"


BASE = [t for t in licenses.TEMPLATES if t.base]
HIT_SQL = [f"case when regexp_matches(joined, ' {licenses.pattern(t)}') then {{'l': '{t.label}', 's': {licenses.weight(t)!r}::double}} end"
           for t in licenses.TEMPLATES]

OP11_SQL = f"""
with d as (select doc_id, {words_sql('text')} as w from documents),
p as (select *, ' ' || array_to_string(w, ' ') || ' ' as joined,
             [{', '.join(places_sql(t.markup) for t in BASE)}] as places from d),
m as (select *, flatten(places) as starts, list_filter([{', '.join(HIT_SQL)}], lambda x: x is not null) as hits from p)
select doc_id, len(w)::bigint as n_words, len(starts)::bigint as n_base,
       (list_min(starts) - 1)::bigint as first_word, (list_max(starts) - 1)::bigint as last_word,
       array_to_string(list_sort(list_distinct(list_filter(
         [{', '.join(f"case when len(places[{k}]) > 0 then '{t.label}' end" for k, t in enumerate(BASE, 1))}],
         lambda x: x is not null))), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.l))), ',') as labels,
       coalesce(list_max(list_transform(hits, lambda x: x.s)), 0.0)::double as score
from m
"""


@query("op11_license_templates", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


OP12_SQL = f"""
with d as (select row_number() over () as row_no, doc_id, {words_sql('text')} as w from documents),
c as (select count(*) filter (len(w) > 0) as n_docs, sum(len(w)) as n_terms from d),
t as (select row_no, term, count(*) as tf from (select row_no, unnest(w) as term from d) group by all),
q as (select item_id, term, count(*) as repeats from
        (select item_id, unnest({words_sql('text')}) as term from (select distinct item_id, text from benchmark)) group by all),
k as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as weight
      from (select term, count(*) as df from t where term in (select term from q) group by term), c),
m as (select row_no, doc_id, (75 + (25 * len(w) * n_docs) // n_terms)::bigint as m from d, c where len(w) > 0),
s as (select item_id, row_no, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
      from q join k using (term) join t using (term) join m using (row_no) group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::integer as rank, doc_id, score
from s where score > 0 qualify rank <= 20
"""


@query("op12_presence_mask_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(lexical.build_index(table(spark, sf_dir, "documents", "doc_id", "text")))
    return lexical.search(index, table(spark, sf_dir, "benchmark", "item_id", "text"))


VISIBLE_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP13_SQL = f"""
with h as (select row_number() over () as row_no, doc_id, {VISIBLE_SQL} as w,
                  {crc32_sql("hex(encode(coalesce(doc_id::varchar, '0')))")} as h from documents),
g as (select *, len(w)::bigint as n, h // 10 as g, doc_id is not null and h % 10 = 0 and len(w) > 0 as again from h),
a as (select *, g % n as a, 1 + (n - g % n) // (3 + g % 8) as p from g where again),
d as (select row_no, doc_id, n, w from g where not again union all
      select row_no, doc_id, n, list_transform(range(0, n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) from a),
win as (select row_no, n, unnest(range(0, n - 15)) as i, w from d where n >= 24),
x as (select row_no, n, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) as x from win),
e as (select a.row_no, a.i, b.i - a.i as q from x a join x b on a.row_no = b.row_no and a.x = b.x and a.i < b.i
      where 3 * (b.i - a.i) <= a.n),
o as (select *, i - row_number() over (partition by row_no, q order by i) as island from e),
r as (select row_no, min(i) as s, count(*) + 15 + q as l, q from o group by row_no, q, island having count(*) + 15 + q >= greatest(24, 3 * q)),
u as (select row_no, s, l, min(q) as q from r group by row_no, s, l),
runs as (select row_no, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed from u group by row_no),
best as (select * from u qualify row_number() over (partition by row_no order by l::decimal(38, 0) / q desc, s, q) = 1),
gone as (select distinct row_no, unnest(range(s + q, s + l)) as i from u),
words as (select row_no, unnest(range(0, n)) as i, unnest(w) as word from d where row_no in (select row_no from u)),
kept as (select row_no, string_agg(word, ' ' order by i) as text from words anti join gone using (row_no, i) group by row_no)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.l::bigint as length,
       best.q::bigint as period, (1000 * best.l // best.q)::bigint as exponent_milli,
       sha256(coalesce(listed, '')) as runs_sha256,
       sha256(coalesce(kept.text, array_to_string(d.w, ' '))) as collapsed_sha256
from d left join runs using (row_no) left join best using (row_no) left join kept using (row_no)
"""


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents", "doc_id", "text"))
