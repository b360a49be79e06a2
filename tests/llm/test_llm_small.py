"""Edge cases of the corpus operators on small tables: nulls, empty and long
texts, ties, repeated rows, empty tables, clashing column names."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerflow.llm import (ann, common, decontam, langid, minhash, mix, pii, quality, queries, shard, text,
                            toxicity, warc)

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"


def docs(spark, texts, **cols):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


AWKWARD = [None, "", "   \n\t ", "word", PROSE, PROSE, PROSE + " extra", "é" * 50, "x" * 300_000,
           "Mixed CASE words " * 2000, "\x00odd \x85 bytes   here", "!!!"]


def awkward(spark):
    base = docs(spark, AWKWARD)
    again = base.where("doc_id in (4, 8)")
    null_id = base.where("doc_id in (0, 4)").withColumn("doc_id", F.lit(None).cast("long"))
    return base.union(again).union(null_id)


# ------------------------------------------------------------ words

def words_of(t, pattern):
    low = t.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(pattern, low)


@pytest.mark.parametrize("kind, pattern", [("visible", r"[^\x20\x09-\x0D]+"),
                                           ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_match_the_pattern(kind, pattern):
    texts = ["", "A b", "b A", "x\ty\x0bz  w", "né, Né!", "end", "begin-end 12a", None, "日本 語"]
    arr = pa.array(texts)
    got, hashes = [], {}
    for a, b, w in text.word_slices(arr, text.byte_class(kind)):
        _, data = text.buffers(arr.slice(a, b - a))
        data = text.lower_table()[data].tobytes()
        for i in range(b - a):
            rows = [data[w.starts[k]: w.ends[k]].decode() for k in range(w.first[i], w.first[i + 1])]
            got.append(rows)
            for k, x in zip(range(w.first[i], w.first[i + 1]), rows):
                assert hashes.setdefault(x, w.hash[k]) == w.hash[k]
    assert got == [words_of(t or "", pattern) for t in texts]
    assert len(set(int(h) for h in hashes.values())) == len(hashes)


# ------------------------------------------------------------ op1

def test_sharding_edge_cases(spark):
    got = shard.shard_documents(awkward(spark)).collect()
    assert len(got) == len(AWKWARD) + 4
    for r in got:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    first = {r.doc_id: r for r in got}
    assert first[0].size == 1 and first[0].text_crc32 == 0
    assert first[4].text_crc32 == zlib.crc32(PROSE.encode()) and first[7].size == 101
    assert shard.shard_documents(docs(spark, [])).collect() == []


def test_tree_follows_weights_and_moves_little(spark):
    tree = [shard.Leaf("a", "x", 0, 3.0), shard.Leaf("a", "y", 1, 1.0), shard.Leaf("b", "z", 2, 4.0)]
    heavier = [shard.Leaf("a", "x", 0, 3.0), shard.Leaf("a", "y", 1, 1.0), shard.Leaf("b", "z", 2, 8.0)]
    df = spark.range(8000).select("id", shard.place(F.col("id"), tree).alias("p"),
                                  shard.place(F.col("id"), heavier).alias("q"),
                                  shard.place(F.col("id"), shard.grown(tree)).alias("g")).toPandas()
    share = df.p.value_counts(normalize=True)
    assert abs(share[0] - 3 / 8) < 0.03 and abs(share[1] - 1 / 8) < 0.02
    moved = df[df.p != df.q]
    assert len(moved) and (moved.q == 2).all()
    assert (df[df.p != df.g].g == 3).all()


# ------------------------------------------------------------ op2

def test_mixing(spark):
    rows = [(i, "hot" if i % 3 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, copy long")
    out = mix.mix(df, weights={"hot": 1.0, None: 1.0})
    assert out.columns == df.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] - 1500) < 150 and abs(n[None] - 1500) < 150
    plan = mix.mix_plan(df, weights={"hot": 1.0}).collect()
    assert {r.source for r in plan} == {"hot"}
    assert sorted(r.position for r in plan) == list(range(len(plan)))
    assert plan and max(r.n_copies for r in plan) > 1
    assert mix.mix_plan(df.limit(0)).collect() == []
    assert mix.mix(awkward(spark)).columns == DOC.replace(" long", "").replace(" string", "").split(", ")


def test_high_rates_do_not_underflow(spark):
    df = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, source string")
    n = mix.mix_plan(df, epochs=900.0).count()
    assert abs(n - 18000) < 900


# ------------------------------------------------------------ op3

def test_quality_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    unary, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 3, 3, 7])
    good, pairs, log_z = quality.marginals(unary, trans, first)
    want, want_pairs, want_z = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, b in ((0, 3), (3, 7)):
        n, weights = b - a, []
        for m in range(2 ** n):
            y = [(m >> i) & 1 for i in range(n)]
            s = sum(unary[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))
            weights.append((np.exp(s), y))
        z = sum(w for w, _ in weights)
        want_z += np.log(z)
        for w, y in weights:
            for i in range(n):
                want[a + i] += w * y[i] / z
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += w / z
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_quality_scores(spark):
    good = [PROSE + f". line {i}\n{PROSE} more" for i in range(30)]
    bad = ["BUY!! NOW!! " * 10 + f"{i}\n%%% $$$ ###" for i in range(30)]
    df = docs(spark, good + bad + AWKWARD).withColumn("score", F.lit(7))
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(0, None), (None, 1)],
                                   "doc_id long, quality int")
    field = quality.fit(df, labels)
    got = [r.s for r in df.select(quality.score_column(spark, field).alias("s"), "doc_id").orderBy("doc_id").collect()]
    assert min(got[:30]) > 0.7 and max(got[30:60]) < 0.3
    assert all(0 <= s <= 1 for s in got) and got[60] == got[61] == got[62] == field.prior
    flat = quality.fit(df, labels.limit(0))
    assert df.select(quality.score_column(spark, flat).alias("s")).distinct().count() <= 2


# ------------------------------------------------------------ op4

def brute_neighbours(vectors, is_query, k=10):
    ok = {}
    for i, v in vectors:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, []).append(np.array(v, np.float64))
    out = []
    for q in ok:
        if is_query(q):
            best = {}
            for v, xs in ok.items():
                if v != q:
                    d = [np.sqrt(((x - y) ** 2).sum()) for x in xs for y in ok[q] if len(x) == len(y)]
                    if d:
                        best[v] = min(d)
            for r, (d, v) in enumerate(sorted((d, v) for v, d in best.items())[:k], 1):
                out.append((q, r, v, d))
    return sorted(out)


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(700, None), (800, [0.0] * 16), (900, [1.0, None] + [0.0] * 14), (1000, [float("nan")] * 16),
             (None, [1.0] * 16), (1100, []), (1200, [1.0, 2.0]), (1300, [1.0, 3.0]), (3, rows[3][1]), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect())
    want = brute_neighbours(rows, lambda i: i % 100 == 0)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.mean([g[2] == w[2] for g, w in zip(got, want)]) > 0.97
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want) if g[2] == w[2])
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_repeats_of_a_near_vector_hide_no_other(spark):
    rng = np.random.default_rng(23)
    x = rng.standard_normal((300, 64))
    near = x[0] + 0.01 * rng.standard_normal(64)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(500, [float(a) for a in near])] * 20
    rows += [(501, [float(a) for a in near + 0.001 * rng.standard_normal(64)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).collect())
    assert got == [w[:3] for w in brute_neighbours(rows, lambda i: i == 0)]
    assert len(got) == 10


def test_most_vectors_are_not_reranked():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 128))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:5] + 0.02 * rng.standard_normal((5, 128))
    rot, centre = ann.rotation(128), x.mean(axis=0)
    low, high = ann.bounds(*ann.encode(x, centre, rot), q, centre, rot, ann.EPSILON)
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.999
    assert all((low[i] <= high[i].min()).mean() < 0.2 for i in range(5))


# ------------------------------------------------------------ op5

def test_toxicity(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    plain = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    foul = [" ".join([*rng.choice(words, 58), *rng.choice(["vile", "scumbag"], 2)]) for _ in range(60)]
    df = docs(spark, plain + foul + AWKWARD).withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)] + [(0, None), (None, 1), (1, 0)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(df, labels, train=F.col("__id") % 3 != 1)
    got = [r.s for r in toxicity.with_score(df, model, "s").orderBy("doc_id").collect()]
    assert max(got[:300]) < 0.7 and np.mean(np.array(got[300:360]) >= 0.7) > 0.95
    assert got[360] == got[361] == got[362] < 0.5
    assert toxicity.drop_toxic(df, model).columns == df.columns
    none = toxicity.fit(df, labels.limit(0))
    assert toxicity.with_score(df, none, "s").agg(F.max("s")).first()[0] < 0.01
    assert toxicity.with_score(df.limit(0), model).count() == 0


def toxic_evidence(texts, label, train):
    """Both log-likelihoods of every text, in plain Python."""
    def up(k):
        return k + toxicity.SIGMAS * math.sqrt(k + 1)

    token = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
             for t in texts]
    ratio = {}
    for order in (1, 2):
        held, ctx = [Counter(), Counter()], [defaultdict(set), defaultdict(set)]
        everywhere = defaultdict(set)
        for i, w in enumerate(token):
            c = label.get(i) if i in train else None
            grams = [(tuple(w[j: j + order]), w[j - 1] if j else None) for j in range(len(w) - order + 1)]
            for x, left in grams:
                everywhere[x].add(left)
                if c is not None:
                    ctx[c][x].add(left)
            if c is not None:
                held[c].update({x for x, _ in grams})
        mass = [sum(held[0].values()), sum(held[1].values())]
        over = [{}, {}]
        for x in held[0] | held[1]:
            for c in (0, 1):
                explained = up(toxicity.LIFT * mass[c] / mass[1 - c] * up(held[1 - c][x]))
                over[c][x] = max(min(held[c][x], len(ctx[c][x])) - explained, 0)
        shared = max(0.1, 1 - sum(sum(o.values()) for o in over) / sum(mass))
        terms = sum(map(len, everywhere.values()))
        for x in over[0]:
            if over[0][x] + over[1][x] > 0:
                back = shared * len(everywhere[x]) / terms
                ratio[x] = math.log(over[1][x] / mass[1] + back) - math.log(over[0][x] / mass[0] + back)
    out = []
    for w in token:
        z = sum(ratio[tuple(w[j - 1: j + 1])] if j and tuple(w[j - 1: j + 1]) in ratio else ratio.get((w[j],), 0.0)
                for j in range(len(w)))
        out.append(z / max(len(w), 1))
    return out, ratio


def test_toxicity_matches_both_likelihoods_in_plain_python(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts, label = [], {}
    for i in range(300):
        w = list(rng.choice(words, 30))
        if i % 3 == 0:
            w[7:7] = ["Vile", "w1"]
        elif i % 2 == 0:
            w[3:3] = ["kind", "w2", "w3"]
        texts.append(" ".join(w))
        label[i] = int(i % 3 == 0)
    copies = ["copied passage " + texts[0]] * 30  # repeats of one passage are no evidence
    label |= {300 + i: 1 for i in range(30)}
    texts += copies + ["", None, "kind vile w1 w2 w3"]
    df = docs(spark, texts)
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    train = {i for i in label if i % 5}
    want, ratio = toxic_evidence(texts, label, train)
    assert any(r > 0 for r in ratio.values()) and any(r < 0 for r in ratio.values())  # both classes speak
    assert {len(x) for x in ratio} == {1, 2}
    monkeypatch.setattr(toxicity, "SKETCH", 1 << 16)  # exact normalisers
    for block_rows in (2_000_000, max(1, len(ratio) // 3)):
        monkeypatch.setattr(toxicity, "BLOCK_ROWS", block_rows)
        model = toxicity.fit(df, labels, train=F.col("__id") % 5 != 0)
        assert model.rows == len(ratio)
        rows = toxicity.with_evidence(df, model, "z", F.col("text"), F.lit(-1)).orderBy("doc_id").collect()
        assert np.allclose([r.z for r in rows], want, rtol=1e-9, atol=1e-12)


def kneser_ney_evidence(texts, label, train):
    """Both log-likelihoods of every text after the absolute discount, in plain
    Python, and the discounts used."""
    def up(k):
        return k + toxicity.SIGMAS * math.sqrt(k + 1)

    token = [words_of(t or "", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for t in texts]
    p, rest, used = [{}, {}], [], []
    for order in (1, 2):
        held, ctx = [Counter(), Counter()], [defaultdict(set), defaultdict(set)]
        everywhere = defaultdict(set)
        for i, w in enumerate(token):
            c = label.get(i) if i in train else None
            grams = [(tuple(w[j: j + order]), w[j - 1] if j else None) for j in range(len(w) - order + 1)]
            for x, left in grams:
                everywhere[x].add(left)
                if c is not None:
                    ctx[c][x].add(left)
            if c is not None:
                held[c].update({x for x, _ in grams})
        mass = [sum(h.values()) for h in held]
        count = [{x: min(held[c][x], len(ctx[c][x])) for x in held[0] | held[1]} for c in (0, 1)]
        kept = [x for x in held[0] | held[1] if any(
            count[c][x] > up(toxicity.LIFT * mass[c] / mass[1 - c] * up(held[1 - c][x])) for c in (0, 1))]
        terms = sum(map(len, everywhere.values()))
        for c in (0, 1):
            n = [0] + [sum(v == k for v in held[c].values()) for k in (1, 2, 3, 4)]
            cut = [0, 0.5, 1.0, 1.5]
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                found = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
                cut = found if min(found[1:]) > 0 else cut
            used.append(cut[1:])
            left = {x: max(count[c][x] - cut[min(count[c][x], 3)], 0) for x in kept}
            back = 1 - sum(left.values()) / mass[c]
            p[c] |= {x: left[x] / mass[c] + back * len(everywhere[x]) / terms for x in kept}
            if order == 1:
                rest.append(math.log(back))
    out = []
    for w in token:
        z = 0.0
        for j in range(len(w)):
            x = next((x for x in (tuple(w[max(j - 1, 0): j + 1]), (w[j],)) if x in p[0]), None)
            z += math.log(p[1][x] / p[0][x]) if x else rest[1] - rest[0]
        out.append(z / max(len(w), 1))
    return out, p[0], used


def test_op5_discounts_absolutely_from_the_counts_of_counts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    words, rare = [f"w{i}" for i in range(40)], [f"r{i}" for i in range(300)]
    texts, label = [], {}
    for i in range(300):
        w = [*rng.choice(words, 20), *rng.choice(rare, 6)]
        w[7:7] = ["Vile", "w1"] if i % 3 == 0 else ["kind", "w2", "w3"] if i % 2 == 0 else []
        texts.append(" ".join(w))
        label[i] = int(i % 3 == 0)
    texts += ["", None, "kind vile w1 w2 w3", "nothing known"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(label.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    train = {i for i in label if zlib.crc32(str(i).encode()) % 3 != 1}
    want, kept, used = kneser_ney_evidence(texts, label, train)
    assert {len(x) for x in kept} == {1, 2} and [0.5, 1.0, 1.5] not in used[:2]  # words: discounts from the counts
    monkeypatch.setattr(toxicity, "SKETCH", 1 << 16)  # exact normalisers
    for block_rows in (2_000_000, max(1, len(kept) // 3)):
        monkeypatch.setattr(toxicity, "BLOCK_ROWS", block_rows)
        model = queries.toxicity_model(df, spark, str(tmp_path))
        assert model.rows == len(kept) and model.rest != 0
        rows = toxicity.with_evidence(df, model, "z", F.col("text"), F.lit(-1)).orderBy("doc_id").collect()
        assert np.allclose([r.z for r in rows], want, rtol=1e-9, atol=1e-12)


def test_absolute_discounts_without_usable_counts_of_counts():
    assert np.allclose(toxicity.discounts([40, 10, 5, 2]), (2 / 3, 1.0, 3 - 4 * (2 / 3) * 2 / 5))
    assert toxicity.discounts([0, 10, 5, 2]) == toxicity.FALLBACK  # rows that all come twice
    assert toxicity.discounts([9, 1, 9, 9]) == toxicity.FALLBACK  # a discount below 0


def test_toxicity_finds_a_fixed_phrase_of_common_words(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    texts = [list(rng.choice(words, 50)) for _ in range(600)]
    for i in range(0, 600, 6):
        texts[i][20:20] = ["w1", "w2", "w3", "w4"]
    df = docs(spark, [" ".join(t) for t in texts])
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, train=F.col("__id") % 5 != 0)
    held = toxicity.with_score(df, model).where("doc_id % 5 = 0").collect()
    assert np.mean([r.score >= 0.7 for r in held if r.doc_id % 6 == 0]) > 0.9
    assert np.mean([r.score < 0.7 for r in held if r.doc_id % 6]) > 0.95


# ------------------------------------------------------------ op6

def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = words_of(t or "", r"[^\x20\x09-\x0D]+")
        s = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if i is not None:
            sets.setdefault(i, []).append(s)
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(2)
    words = np.array([f"t{i}" for i in range(500)])
    texts = list(AWKWARD)
    for _ in range(12):
        base = rng.choice(words, int(rng.integers(6, 120)))
        for _ in range(int(rng.integers(1, 9))):
            copy = base.copy()
            for _ in range(int(rng.integers(0, 4))):
                copy[rng.integers(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    df = docs(spark, texts).union(awkward(spark).where("doc_id is null")).union(docs(spark, texts).where("doc_id < 20"))
    got = minhash.near_duplicates(df.withColumn("component_id", F.lit("x"))).collect()
    want = brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_large_star_is_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 500)
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join([*base[:-1], f"end{k}"]) for k in range(150)]
    got = minhash.near_duplicates(docs(spark, texts)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("block", [1024, 40])
def test_planted_pairs_in_a_family_below_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(22)
    base = [f"f{i}" for i in range(1004)]
    texts = []
    for k in range(200):  # any two near 0.82, each fifth beside a copy at 0.85 or more
        copy = list(base)
        for j in rng.choice(np.arange(5, 1000), 10, replace=False):
            copy[j] = f"own{k}x{j}"
        texts.append(" ".join(copy))
        if k % 5 == 0:
            for j in range(4):
                copy[100 + 200 * j] = f"more{k}x{j}"
            texts.append(" ".join(copy))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    want = brute_components(list(enumerate(texts)))
    assert 100 < len(set(want.values())) < len(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == want


@pytest.mark.parametrize("m, block", [(60, 2048), (240, 2048), (240, 100)])
def test_a_family_is_sent_once_a_block(spark, monkeypatch, m, block):
    """Sets sent per text in the full comparison of a family: one for every
    block, however many buckets its texts share."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    members = spark.range(m).selectExpr("id as node", "explode(sequence(0L, 62L)) as key").where(
        "pmod(xxhash64(node, key), 3) = 0").selectExpr("node", "key", "300L as high")
    work = common.Scratch(spark)
    sent = {r.node: len(r.groups) for r in minhash.rest_groups(members, work).collect()}
    assert sent == dict.fromkeys(range(m), -(-m // block))
    # buckets in a chain meet in their own groups, not all together
    chain = spark.range(3000).selectExpr("id as node", "explode(array(id div 3, 1000 + (id + 1) div 3)) as key", "3000L as high")
    got = minhash.rest_groups(chain, work).selectExpr("node", "explode(groups) as g").selectExpr("node", "g.centre", "g.salt")
    meet = got.join(got.withColumnRenamed("node", "other"), ["centre", "salt"]).where("node < other").distinct()
    whole = chain.groupBy("key").count().where("count > 2").select("key")
    want = chain.join(whole, "key").join(chain.selectExpr("node as other", "key"), "key").where("node < other")
    assert want.select("node", "other").subtract(meet.select("node", "other")).isEmpty()
    assert meet.count() < 20_000


def test_one_row_of_an_id_is_kept_whatever_the_order(spark):
    rows = [(7, f"words {k} of one id", "en", "s", k) for k in range(6)] + [(8, None, "en", "s", 1)] * 2
    got = [minhash.keep_first(spark.createDataFrame(x, DOC).repartition(3)).collect() for x in (rows, rows[::-1])]
    assert got[0] and sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == 2


def test_pipeline_drops_copies_between_80_and_85(spark):
    rng = np.random.default_rng(21)
    words = np.array([f"p{i}" for i in range(3000)])
    texts = []
    for k in range(40):
        base = rng.choice(words, 54, replace=False)
        copy = base.copy()
        copy[8 + k % 38] = f"new{k}"  # 5 of 50 shingles: J = 45 / 55
        texts += [" ".join(base), " ".join(copy)]
    df = docs(spark, texts)
    want = brute_components(list(enumerate(texts)), 80)
    assert len(set(want.values())) == 40 and len(set(brute_components(list(enumerate(texts))).values())) == 80
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == set(want.values())
    assert (minhash.banding(85), minhash.banding(80)) == (40, 63)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "u long, v long")
    got = {r.node: r.comp for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


# ------------------------------------------------------------ op7

def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/ b\r\nc", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", None), (5, "u", ""),
            (None, "u", big), (6, "é", "é" * 600 + "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "small"), (8, "u", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("x"))
    folder = f"file://{tmp_path}/w"
    raw = warc.write_archives(pages.repartition(2), f"{folder}/raw")
    normal = warc.normalise(raw, f"{folder}/normal")
    got = warc.read_records(normal, folder).collect()
    want = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in (1, 2, None):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 3, None)
        else:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == want[r.page_id]
        assert r.payload_bytes == len(want[r.page_id])
    import gzip
    for path in raw.toPandas().archive:  # one member each; the rewritten files have one per record
        assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")
    for r in normal.collect():
        data = open(r.archive, "rb").read()
        assert data.count(b"\x1f\x8b\x08") >= r.n_records == len(open(r.sidecar).readlines())
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_truncated_archive_is_an_error():
    import gzip
    import io
    whole = warc.record_bytes(1, "u", b"abc", 3, "00" * 20, None)
    assert len(list(warc.records(io.BytesIO(gzip.compress(whole) + gzip.compress(whole))))) == 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(whole + whole[:-6]))))


# ------------------------------------------------------------ op8

KIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
               for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for i, (k, p) in enumerate(KIND.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (k == "ip" and any(int(x) > 255 for x in m.group().split("."))
                    or k == "card" and not (14 <= len(d) <= 19 and luhn(d))
                    or k == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), i, k, m.end()))
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(out))


TRICKY = ["a@b.c_d@e.f", "a@b.c.d. x@y", "@a.b", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "001.02.3.0255 1.2.3.256",
          "4242 4242 4242 4242-5", "4242-4242-4242-4242", "x4242424242424242y", "4242  4242424242424242",
          "+1 (375) 555-4393, +49 30 123", "+1(", "é😀 a.b+c@d-e.fr é 10.0.0.1", "1 " * 30 + "2", "+" * 50 + "1234567890",
          "a" * 200_000, "9" * 100_000, "1 2" * 50_000, "a@" * 3000 + "b.c", "a.b" * 50_000]


def test_base_spans_match_the_plain_patterns(spark):
    df = docs(spark, TRICKY + AWKWARD)
    got = {r.doc_id: r for r in pii.report(df.withColumn("spans", F.lit(1))).collect()}
    import hashlib
    for r in df.collect():
        want = base_spans(r.text)
        assert got[r.doc_id].spans == want, r.text[:60]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[r.doc_id].n_card == want.count("card:")
    assert pii.report(df.limit(0)).collect() == []


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"please mail u{i}@host{i}.org today" for i in range(40)]
    fresh = ["please mail hidden.name@intranet now", "see item 4711 here", "the code 1234567 is"]
    got = {r.doc_id: r.spans for r in pii.report(docs(spark, seeds + fresh)).collect()}
    assert got[40] == "email:12:32"
    assert got[41] == got[42] == ""
    assert all(got[i] == base_spans(s) for i, s in enumerate(seeds))


def test_accepted_instances_induce_further_patterns(spark):
    """The first round accepts the names after "mail"; they induce "write to"
    and "via" patterns, which find what no seed stands beside."""
    names = [f"{chr(97 + i)}lee@intranet" for i in range(26)]
    texts = [f"please mail u{i}@host{i}.org today" for i in range(40)]
    texts += [f"please mail {n} today" for n in names] + [f"write to {n} soon" for n in names]
    texts += ["write to boss@hq soon", "go to office 12", "write to 77 soon", None, ""]
    got = {r.doc_id: r.spans for r in pii.report(docs(spark, texts)).collect()}
    assert all(got[40 + i] == f"email:12:{12 + len(n)}" for i, n in enumerate(names))
    assert all(got[66 + i] == f"email:9:{9 + len(n)}" for i, n in enumerate(names))
    assert got[92] == "email:9:16"
    assert [got[i] for i in range(93, 97)] == [""] * 4
    once = pii.extract(docs(spark, texts), support=200).collect()
    assert all(len(r.spans) == len(r.seeds) for r in once)


def brute_induce(edges, support, accept, rounds):
    of, scores = {}, {}
    for p, i, r in edges:
        of.setdefault(p, []).append((i, r))
    for _ in range(rounds):
        trust = {}
        for p, inst in of.items():
            for k in range(4):
                known = [1.0 for _, r in inst if r == k]
                met = [scores[i, k] for i, r in inst if r is None and (i, k) in scores]
                sure = len(known) + sum(s >= accept and looks(i) for i, s in (
                    (i, scores[i, k]) for i, r in inst if r is None and (i, k) in scores))
                if sure >= support and (sum(known) + sum(met)) / len(inst) > pii.TRUST:
                    trust[p, k] = (sum(known) + sum(met)) / len(inst)
        miss = {}
        for p, i, r in edges:
            for k in range(4):
                if r is None and (p, k) in trust:
                    miss[i, k] = miss.get((i, k), 1.0) * max(1 - trust[p, k], 1e-6)
        scores = {x: 1 - m for x, m in miss.items()}
    best = {}
    for (i, k), sc in sorted(scores.items(), key=lambda x: x[0][1]):
        if sc >= accept and looks(i) and sc > best.get(i, (0, 0))[0]:
            best[i] = sc, k
    return {i: k for i, (_, k) in best.items()}


def looks(token):
    return sum(c in "0123456789" for c in token) >= 6 or bool(re.fullmatch("[^@]+@[^@]+", token))


def test_induction_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    kind = {i: (int(rng.integers(0, 2)) if rng.random() < 0.6 else None) for i in range(120)}
    edges = sorted({(f"p{int(p)}", i) for i in kind for p in rng.choice(14, 4)
                    if kind[i] is None or (int(p) + kind[i]) % 2 or rng.random() < 0.1})
    rows = [(p, f"x{i}@y" if i % 5 else f"v{i}", kind[i]) for p, i in edges]
    table, sizes = spark.createDataFrame(rows, "pattern string, instance string, rank int"), []
    for rounds in (1, 2, 4):
        want = brute_induce(rows, 8, 0.8, rounds)
        got = pii.induce(table, 8, 0.8, rounds).collect()
        assert {r.instance: r["rank"] for r in got} == want and len(got) == len(want)
        sizes.append(len(want))
    assert 0 < sizes[0] < sizes[1] < sizes[2]


def test_places_of_many_matches(spark):
    """Matches in runs: places on both sides of a run's end, and a text of
    many slots."""
    for n in (pii.RUN - 1, pii.RUN, pii.RUN + 1, 3 * pii.RUN, 20_000):
        text = " ".join(f"é😀 {i}a" for i in range(n))
        got = docs(spark, [text]).select(pii.slots(pii.F.col("text")).alias("s")).first().s
        want = [(m.start(2), m.end(2), m.group(1)) for m in re.finditer(r"(\S+) (\S+)", text)]
        assert [(x["start"], x["end"], x["word"]) for x in got] == want
        assert [x["after"] for x in got] == ["é😀"] * (n - 1) + [""]


# ------------------------------------------------------------ op9

def brute_hits(doc, items, window=13):
    w = words_of(doc or "", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hit, found = set(), set()
    for i, t in items:
        b = words_of(t or "", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        k = min(window, len(b))
        for s in range(len(b) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == b[s:s + k]:
                    hit.update(range(p, p + k))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


def near_item(doc, item, window=13, slop=2):
    """A window's words in order in the document, ``slop`` others among them
    at most: all ways to place them, word by word."""
    w, b = (words_of(t or "", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for t in (doc, item))
    k = min(window, len(b))
    for s in range(len(b) - k + 1 if k else 0):
        ways = {(p, 0) for p, x in enumerate(w) if x == b[s]}
        for term in b[s + 1: s + k]:
            ways = {(p + 1 + g, o + g) for p, o in ways for g in range(slop - o + 1)
                    if p + 1 + g < len(w) and w[p + 1 + g] == term}
        if ways:
            return True
    return False


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_decontamination_matches_brute_force(spark, monkeypatch, block_words):
    rng = np.random.default_rng(4)
    words = [f"k{i}" for i in range(12)]
    items = [(10, " ".join(rng.choice(words, 30))), (2, "short item"), (3, None), (4, "..."), (None, "k1 k2 k3"),
             (5, "solo"), (10, None), (7, " ".join(["k1"] * 20))]
    texts = list(AWKWARD) + [" ".join(rng.choice(words, 80)) for _ in range(20)]
    texts += [PROSE + " " + items[0][1][5:] + " " + PROSE, "A short item, SOLO.", items[0][1], "k1 " * 40]
    loose = items[0][1].split()[3:16]
    texts += [" ".join(loose[:4] + ["zz"] * a + loose[4:9] + ["k3"] * b + loose[9:]) for a, b in ((1, 1), (2, 0), (2, 1), (0, 3))]
    texts += ["short y item", "short x y z item", "item short"]
    df = docs(spark, texts).union(awkward(spark).where("doc_id is null"))
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(0))
    full = decontam.blocks
    monkeypatch.setattr(decontam, "blocks", lambda t, a="item_id", b="text", w=13: full(t, a, b, w, block_words))
    index = common.cut(decontam.build_index(df.withColumn("segment", F.lit(1))))
    got = decontam.search(index, tests).collect()
    assert len(got) == df.count()
    by_id = {r.doc_id: r.text for r in df.collect()}
    near = [(i, t) for i, t in items if i is not None]
    for r in got:
        if r.doc_id is not None:
            assert r.near == sorted({str(i) for i, t in near if near_item(by_id[r.doc_id], t)}), r.doc_id
        n, hit, found = brute_hits(by_id[r.doc_id], items)
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r.items) == (n, hit, found)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
    bad = {r.doc_id for r in got if r.contaminated}
    kept = decontam.drop_contaminated(df, tests)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} - {None} == set(range(len(texts))) - bad
    assert decontam.search(index.limit(0), tests).collect() == []
    assert not any(r.contaminated for r in decontam.search(index, tests.limit(0)).collect())


def test_proximity(spark):
    df = docs(spark, ["one two three four", "one x two three y four", "one x y z w two three four", "four three two one"])
    tests = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = {(r.doc_id, r.start, r.end) for r in decontam.proximity(decontam.build_index(df), tests, 2).collect()}
    assert got == {(0, 0, 4), (1, 0, 6)}


# ------------------------------------------------------------ op10

def test_language_id(spark):
    rng = np.random.default_rng(8)
    stems = {"aa": ["tha", "ing", "wor", "ell"], "bb": ["sch", "ung", "ein", "keit"], "cc": ["ção", "nha", "lho", "ões"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lg], 2)) for _ in range(30)), lg)
            for i, lg in enumerate(["aa", "bb", "cc"] * 80)]
    rows += [(500 + i, t, "aa" if i % 2 else None) for i, t in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("pick", F.lit(0))
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predict_column(spark, model).alias("p")).collect()}
    held = [r for r in rows if r[0] % 4 == 2 and r[0] < 500]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(0 <= p.score <= 1 for p in got.values())
    for i, t in enumerate(AWKWARD):
        no_letter = not any(c.isalpha() for c in t or "")
        assert (got[500 + i].lang_pred == "und") == no_letter
    assert (model.weight == 0).mean() > 0.5
    empty = langid.fit(df.limit(0))
    assert df.limit(3).select(langid.predict_column(spark, empty).alias("p")).first().p.lang_pred == "und"


# ------------------------------------------------------------ pipeline

def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 70)) for _ in range(120)] + AWKWARD
    texts += [texts[0], texts[1] + " tail"]
    df = docs(spark, texts).union(awkward(spark).where("doc_id is null")).withColumn("shard", F.lit("mine"))
    sf = f"{tmp_path}/sf"
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 10 == 0)) for i in range(100)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, texts[5])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*df.columns, "_shard"]
    kept = {r.doc_id for r in out.collect()}
    assert 5 not in kept and 132 not in kept and 133 not in kept
    stages = corpus_pipeline.STAGES
    assert len(stages) == 5
    empty = df.limit(0)
    for _, stage in stages[:-1]:
        assert stage(spark, empty, sf).columns == df.columns
