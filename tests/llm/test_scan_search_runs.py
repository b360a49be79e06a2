"""Template licenses, presence-mask search and periodic runs against brute
force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import common, lexical, licenses, periodic
from ledgerflow.llm.text import byte_class, word_slices

DOC = "doc_id long, text string, LICENSE string, n_words long, p string"
VISIBLE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in zip(ids, texts)], DOC)


def alnum(t):
    return licenses.words_of(t or "")


AWKWARD = [None, "", " \n\t", "one", "x" * 3_000_000, "MIT License" * 3, "the MIT\nLicense. mit-license", "é ü 日本 " * 50,
           "a " * 24, "a " * 23, "ab cd " * 40_000, "\x00odd \x85 bytes   here"]


def test_long_words_hash_alike_in_pieces(monkeypatch):
    from ledgerflow.llm import text
    arr = pa.array(["a bc " * 700 + "z" * 5000 + " tail", "zz" * 3000, "end"])
    whole = [w.hash for _, _, w in word_slices(arr, byte_class("visible"))]
    monkeypatch.setattr(text, "PIECE_BYTES", 64)
    pieces = [w.hash for _, _, w in word_slices(arr, byte_class("visible"))]
    assert [x.tolist() for x in whole] == [x.tolist() for x in pieces]


# ------------------------------------------------------------ op11

TOYS = [licenses.Template("x", "a b <<beginOptional>>c <<beginOptional>>d<<endOptional>> e<<endOptional>> f"),
        licenses.Template("y", "a <<var;name=q;match=0-3>> b a"),
        licenses.Template("z", "b <<beginOptional>>a<<endOptional>> <<var;name=q;match=2-4>> c <<beginOptional>>c<<endOptional>>"),
        licenses.Template("o", "<<beginOptional>>a<<endOptional>> d", True)]


def brute_matches(words, templates):
    out = []
    for i in range(len(words)):
        for k, t in enumerate(templates):
            ends = [j for j in range(i + 1, len(words) + 1)
                    if re.fullmatch(licenses.pattern(t), " ".join(words[i:j]) + " ")]
            if ends:
                out.append((k, i, max(ends)))
    return out


@pytest.mark.parametrize("states", [3, 4096])
def test_templates_match_as_regular_expressions(spark, monkeypatch, states):
    monkeypatch.setattr(licenses, "STATES", states)
    rng = random.Random(states)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(25))) for _ in range(300)]
    auto = licenses.Automaton(TOYS)
    for a, b, w in word_slices(pa.array(texts), byte_class("alnum")):
        got = list(zip(*[x.tolist() for x in auto.matches(w)]))
        want = [(k, i + int(w.first[d]), e + int(w.first[d]))
                for d in range(a, b) for k, i, e in brute_matches(alnum(texts[d]), TOYS)]
        assert got == want


def test_markup_errors():
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>", "a <<var;name=x>> b",
                "<<var;name=x;match=1-2>> a", "", "a <<var;name=x;match=3-2>>"):
        with pytest.raises(ValueError):
            licenses.Automaton([licenses.Template("l", bad)])


def test_real_notices_with_optional_and_replaced_wording(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.": ("apache", "apache,apache-2.0"),
        "Licensed under the Apache License, Version 2.1": ("apache", "apache"),
        "Released under the terms of the MIT License!": ("mit", "mit"),
        "licensed under the GNU General Public License (GPL) as published by the Free Software Foundation, version 3":
            ("gpl", "gpl,gpl-3.0"),
        "To the extent possible under law, Jane Roe of Example Ltd. has waived all copyright and related or "
        "neighboring rights to this work": ("", "cc0-1.0"),
        "To the extent possible under law, has waived all copyright and related or neighboring rights to": ("", ""),
        "Licensed under CC BY-NC 4.0.": ("", "cc-by-nc-4.0"), "Licensed under CC BY-NC 4,1": ("", "")}
    got = {r.doc_id: r for r in licenses.digest(table(spark, list(texts))).collect()}
    for i, (base, labels) in enumerate(texts.values()):
        assert (got[i].base_labels, got[i].labels) == (base, labels), list(texts)[i]


def test_license_digest_on_awkward_rows(spark):
    docs = table(spark, AWKWARD + AWKWARD[5:7] + [None], [*range(len(AWKWARD)), 5, None, None])
    rows = licenses.digest(docs).collect()
    assert len(rows) == docs.count()
    text_of = dict(enumerate(AWKWARD))
    for r in rows:
        if r.doc_id is None:
            continue
        w = alnum(text_of[r.doc_id])
        at = [i for t in licenses.TEMPLATES if t.base for n in [t.markup.split()]
              for i in range(len(w)) if w[i: i + len(n)] == n]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    kept = licenses.scan(docs)
    assert kept.columns == [*docs.columns, "licenses"] and kept.count() == docs.count()
    with pytest.raises(ValueError):
        licenses.scan(docs, out="License")
    assert licenses.digest(docs.limit(0)).collect() == []


# ------------------------------------------------------------ op12

def brute_search(docs, items, k=20):
    """docs: (id, text) rows; items: (id, text) rows."""
    words = [(i, alnum(t)) for i, t in docs]
    n = sum(bool(w) for _, w in words)
    total = sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    pooled = {}
    for i, t in sorted(set(items), key=str):
        pooled.setdefault(i, []).extend(alnum(t))
    out = set()
    for item, terms in pooled.items():
        scored = []
        for d, w in words:
            if not w:
                continue
            m = 100 - 25 + (25 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(x, 0) + 1)))
                    * ((1000000000 * w.count(x)) // (1000 * w.count(x) + 12 * m)) for x in terms)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        for rank, (s, named, d) in enumerate(sorted(scored)[:k], 1):
            out.add((item, rank, d if named else None, -s))
    return out


def found(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


@pytest.mark.parametrize("block", [40, 200_000])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(lexical, "STEP", 3)
    rng = random.Random(block)
    vocab = [f"w{i}" for i in range(150)]
    draw = lambda n: " ".join(vocab[int(rng.paretovariate(0.6)) % 150] for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 60))) for i in range(400)]
    docs += [(i, "w1 w2 w3") for i in range(400, 460)]  # ties beyond k
    docs += [(None, "w1 w2 w3"), (460, None), (461, ""), (5, docs[5][1]), (462, "W1, w2; W3!"), (463, draw(20_000))]
    items = [(1, "w1 w2 w3"), (1, "w1 w2 w3"), (2, draw(100)), (3, draw(10)), (3, draw(10)), (4, None), (5, "unknown words"),
             (None, draw(7)), (6, " ".join(vocab)), (7, "w1 w1 W1 w9")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = found(lexical.search(common.cut(lexical.build_index(d)), q))
    assert got == brute_search(docs, items)


def test_search_edge_cases(spark):
    d, q = table(spark, AWKWARD), spark.createDataFrame([(1, "mit license x"), (2, "日本 ab")], "item_id int, text string")
    got = lexical.search(common.cut(lexical.build_index(d)), q)
    assert found(got) == brute_search(list(enumerate(AWKWARD)), [(1, "mit license x"), (2, "日本 ab")])
    assert got.schema["item_id"].dataType.simpleString() == "int"
    index = common.cut(lexical.build_index(d))
    assert lexical.search(index, q.limit(0)).collect() == []
    assert lexical.search(common.cut(lexical.build_index(d.limit(0))), q).collect() == []


def test_search_leaves_documents_unscored(monkeypatch):
    """Groups that cannot reach the limit are not scored."""
    rows, seen = [], []
    texts = ["rare common"] * 30 + ["common filler"] * 5000
    for a, b, w in word_slices(pa.array(["rare common"]), byte_class("alnum")):
        items = lexical.Items([{"item": "q", "words": w.hash.tobytes()}])
    items.weigh(5030, 10060, {i: n for i, n in enumerate([30, 5030] if items.vocab[0] == w.hash[0] else [5030, 30])})
    add = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, s, n, i: (seen.append(len(s)), add(self, s, n, i)))
    from unittest.mock import MagicMock
    df = MagicMock()
    df.select.return_value.mapInArrow = lambda run, ddl: rows.extend(
        run([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])]))
    lexical.build_index(df)
    ranker = lexical.Ranker(items, 20)
    for b in rows:
        ranker.work({c: b.column(c)[0].as_py() for c in lexical.SEGMENT.names[2:]})
    assert sum(seen) < 100 and ranker.best[0].id.tolist() == list(range(20))


# ------------------------------------------------------------ op13

def brute_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check_runs(texts, least=24, times=3):
    for t, r in zip(texts, periodic.scan(pa.array(texts, pa.string()), least, times).to_pylist()):
        w = re.findall(VISIBLE, t or "")
        want = brute_runs(w, least, times)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
        assert (r["collapsed"], r["n_words"]) == (collapsed(w, want), len(w))


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (8, 2), (30, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    texts = [None, "", "  \n", "a", "a " * 24, "a " * 23, "A a " * 12]
    for _ in range(400):
        k = rng.choice([1, 2, 3, 5, 40])
        w = [str(rng.randrange(k)) for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(3)):
            p = rng.randrange(1, 20)
            block, at = [str(rng.randrange(k)) for _ in range(p)], rng.randrange(len(w) + 1)
            w[at:at] = [block[i % p] for i in range(rng.randrange(90))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    a, b = "0", "1"
    for _ in range(9):
        a, b = a + b, b + a  # overlap-free
    f, g = "0", "01"
    for _ in range(12):
        f, g = g, g + f  # many runs
    check_runs([*texts, " ".join(a), " ".join(g), " ".join(["x"] * 600)], least, times)


def test_blocks_of_comparisons_do_not_matter(monkeypatch):
    monkeypatch.setattr(periodic, "CELLS", 16)
    check_runs(["a b " * 60, "x " + "a b c " * 30 + "y", " ".join(str(i * i % 7) for i in range(400))])


def test_run_digest_on_awkward_rows(spark):
    ids = [*range(len(AWKWARD)), 8, None]
    texts = AWKWARD + [AWKWARD[8], AWKWARD[8]]
    ids += range(100, 180)
    texts += [" ".join(str((i * k) % 97) for i in range(k)) for k in range(80)]
    rows = periodic.digest(table(spark, texts, ids)).collect()
    assert len(rows) == len(ids)
    text_of = dict(zip(ids, texts))
    looped = 0
    for r in rows:
        if r.doc_id in (None, 4, 10):
            continue
        w = re.findall(VISIBLE, text_of[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            looped += 1
        runs = brute_runs(w)
        assert r.n_runs == len(runs)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
        if runs:
            s, m, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert looped
    long = next(r for r in rows if r.doc_id == 10)
    assert (long.start, long.length, long.period) == (0, 80_000, 2)
    assert periodic.digest(table(spark, AWKWARD).limit(0)).collect() == []
    both = table(spark, AWKWARD).withColumn("q", periodic.runs_column(F.col("text")))
    assert both.where("size(q.runs) > 0").count() == 3 and "LICENSE" in both.columns
