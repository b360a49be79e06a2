import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerflow.operators import aggregate as agg
from ledgerflow.operators import quality as qa
from ledgerflow.operators import runs as rn
from ledgerflow.schemas import BANKSIM_NET, BENCH_RUNS, PAYSIM
from ledgerflow.session import scratch_path
from ledgerflow.sources import delimited as dl


def _lines(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


FIELDS = [("", 1), (",", 2), ("a", 1), (",a", 2), ("a,,b", 3), ("1,T,2,O'Neil,3,4,O'Hara,5,6,0,0", 11), ("'a,b',c", 2),
          ("'a\\'b,c',d", 2), ("'open,b", 2), ("x'a,b'y", 2), ("'',''", 2), ("'a' ,b", 2), ("'it's',b", 2), ("a,'b,c'", 2),
          ("'a,b'c,d", 3)]


@pytest.mark.parametrize("line, n", FIELDS)
def test_fields_are_counted_as_the_parser_splits(spark, line, n):
    got = _lines(spark, line).select(dl.field_count().alias("n"), dl.split_fields().alias("f")).first()
    assert got.n == n and len(got.f) == n and ",".join(got.f) == line


def test_a_long_line_is_counted_in_linear_time(spark):
    n = 200_000
    for line, want in ((",".join(["'a,b'"] * n), n), ("'" * n, 1), ("'" + "x," * n, n + 1), ("'" + "\\\\" * n + "',b", 2)):
        assert _lines(spark, line).select(dl.field_count()).first()[0] == want


def test_apostrophes_keep_their_layout(spark):
    tagged = dl.tag_records(_lines(spark, "1,T,2,O'Neil,3,4,O'Hara,5,6,0,0", "'d\\'A','M','7.0','x','1'"), dl.default_layouts())
    got = sorted((r.layout, r.malformed) for r in tagged.collect())
    assert got == [("banksim_net", False), ("paysim", False)]
    assert tagged.selectExpr("paysim.nameOrig as a", "banksim_net.Source as b").filter("a = \"O'Neil\" or b = \"d'A\"").count() == 2


def _folder(spark, name, text):
    path = scratch_path(spark, name)
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write(text)
    return path


def test_one_pass_writes_both_sides(spark):
    path = _folder(spark, "both", "Source,Target,Weight,typeTrans,fraud\n'C','M','1.5','x','0'\n'C','M'\n'C','M','bad','x','0'\n"
                                  "'C','M','1','x','0','9'\n\n,M,2.5,x,1\n")
    got = dl.ingest(spark, path, BANKSIM_NET, scratch_path(spark, "both_out"), quote="'")
    assert rows(got.good, "Source", "Weight") == [("C", 1.5), (None, 2.5)] or rows(got.good, "Weight") == [(1.5,), (2.5,)]
    assert got.counts == {"n_good": 2, "n_dropped": 3, "too_few_fields": 1, "too_many_fields": 1, "bad_value": 1}
    assert rows(got.bad, "reason", "raw") == [("bad_value", "'C','M','bad','x','0'"), ("too_few_fields", "'C','M'"),
                                              ("too_many_fields", "'C','M','1','x','0','9'")]
    assert got.good.schema.fieldNames() == BANKSIM_NET.fieldNames()
    clean = dl.ingest(spark, _folder(spark, "none", ""), PAYSIM, scratch_path(spark, "none_out"))
    assert clean.good.count() == clean.bad.count() == 0 and clean.counts["n_good"] == 0


def test_merged_moments_do_not_cancel(spark):
    """A mean of 1e9 and a spread of 1: the merged deviation is Spark's own,
    but for the rounding of the groups' means (1e-6 each here); a difference of
    sums of squares would be off by more than the deviation itself."""
    df = spark.range(40_000).selectExpr("id % 300 as g", "1e9D + cast(pmod(xxhash64(id), 1000) as double) / 1000 as x")
    parts = df.groupBy("g").agg(F.count(F.lit(1)).alias("hourly_tx_count"), F.count("x").alias("n"), F.avg("x").alias("mean"),
                                (F.var_pop("x") * F.count("x")).alias("m2"))
    for ddof, fn in ((1, F.stddev_samp), (0, F.stddev_pop)):
        got, want = agg.merged_stats(parts, ddof).first(), df.agg(F.avg("x").alias("m"), fn("x").alias("s")).first()
        assert abs(got.global_std - want.s) < 1e-7 and abs(got.global_mean / want.m - 1) < 1e-14
    assert tuple(agg.merged_stats(parts.limit(0)).first()) == (None, None)


def _runs(spark, rows_):
    base = {"engine": "spark", "workload": "w", "exit_code": 0, "wall_time_sec": 1.0, "sample_fraction": 1.0, "data_size_mb": 5.0}
    names = list(base)
    kinds = {f.name: f.dataType.simpleString() for f in BENCH_RUNS.fields}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in names)
    return spark.createDataFrame([tuple({**base, **r}[c] for c in names) for r in rows_], ddl)


def test_near_fractions_chain_without_a_window_over_all(spark):
    fractions = [0.1, 0.105, 0.112, 0.13, 0.5, 0.51, 0.519, None, 1.0]
    got = rn.match_fractions(_runs(spark, [{"sample_fraction": f} for f in fractions]))
    assert {r.sample_fraction: r.fraction_key for r in got.collect()} == {
        0.1: 0.1, 0.105: 0.1, 0.112: 0.1, 0.13: 0.13, 0.5: 0.5, 0.51: 0.51, 0.519: 0.51, None: None, 1.0: 1.0}
    many = spark.range(20_000).selectExpr("'s' as engine", "id * 0.0001D + if(id % 2 = 0, 0.5D, 0) as sample_fraction")
    keys = rn.match_fractions(many, tolerance=0.00015)
    vals, key = sorted({r.sample_fraction for r in many.collect()}), {}
    for i, v in enumerate(vals):
        key[v] = v if not i or v - vals[i - 1] > 0.00015 - 1e-9 else key[vals[i - 1]]
    assert all(key[r.sample_fraction] == r.fraction_key for r in keys.collect())


def test_scaling_curve_with_one_x_for_all(spark, monkeypatch):
    monkeypatch.setattr(rn, "PIECE", 7)
    data = [{"wall_time_sec": float(1 + (i * 37) % 50)} for i in range(300)]
    got = rn.scaling_curve(_runs(spark, data)).collect()
    assert sorted(r.position for r in got) == list(range(1, 301))
    by = sorted(got, key=lambda r: r.position)
    assert [r.wall_time_sec for r in by] == sorted(d["wall_time_sec"] for d in data)


def test_footprint_lists_all_tables_at_once(spark):
    root = scratch_path(spark, "fp")
    for name, sizes in (("a", [3, 5]), ("a/b", [7]), ("ab", [11])):
        os.makedirs(f"{root}/{name}", exist_ok=True)
        for i, n in enumerate(sizes):
            with open(f"{root}/{name}/{i}.dat", "wb") as f:
                f.write(b"x" * n)
    got = qa.footprint(spark, {"one": f"{root}/a", "two": f"file:{root}/a/b", "three": f"{root}/ab/"}, glob="*.dat")
    assert rows(got, "table", "n_files", "total_bytes") == [("one", 2, 8), ("three", 1, 11), ("two", 1, 7)]
