import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import groupwise as g
from groupwise.streaming import windowed_agg
from groupwise.types import widened

NA = [(1, "a", 1.0), (2, "a", float("nan")), (3, "a", None), (4, "a", 4.0), (5, "b", 2.0), (6, "c", None), (7, None, 9.0), (8, "a", 7.5)]
N = None


@pytest.fixture(scope="module")
def na(spark):
    return spark.createDataFrame(NA, "id int, k string, v double").repartition(3)


def by_key(df, column):
    return {r["k"]: r[column] for r in df.collect()}


REDUCTIONS = [
    (g.size(), (5, 1, 1)), (g.count("v"), (3, 1, 0)), (g.sum_("v"), (12.5, 2.0, 0.0)), (g.sum_("v", min_count=2), (12.5, N, N)), (g.sum_("v", exact=2), (12.5, 2.0, 0.0)),
    (g.prod("v"), (30.0, 2.0, 1.0)), (g.prod("v", min_count=1), (30.0, 2.0, N)), (g.mean("v"), (4.166666666666667, 2.0, N)),
    (g.var("v"), (10.583333333333332, N, N)), (g.std("v"), (3.253203549323856, N, N)), (g.sem("v"), (1.878237944930774, N, N)), (g.skew("v"), (0.2299368867399838, N, N)), (g.skew("v", skipna=False), (N, N, N)),
    (g.median("v"), (4.0, 2.0, N)), (g.min_("v"), (1.0, 2.0, N)), (g.max_("v"), (7.5, 2.0, N)), (g.max_("v", 2), (7.5, N, N)),
    (g.first("v"), (1.0, 2.0, N)), (g.first("v", 2), (1.0, N, N)), (g.last("v"), (7.5, 2.0, N)), (g.nth("v", 2), (4.0, N, N)), (g.nth("v", 4), (N, N, N)),
    *[(g.quantile("v", 0.3, m), (x, 2.0, N)) for m, x in [("linear", 2.8), ("lower", 1.0), ("higher", 4.0), ("nearest", 4.0), ("midpoint", 2.5)]],
]


@pytest.mark.parametrize(("reduction", "expected"), REDUCTIONS)
def test_reductions(na, reduction, expected):
    got = by_key(g.grouped(na, "k", "id").agg(x=reduction), "x")
    assert set(got) == {"a", "b", "c"}
    for k, e in zip("abc", expected, strict=True):
        assert got[k] == (e if e is None else pytest.approx(e, rel=1e-12))


def test_ohlc_and_all_in_one_aggregation(na):
    df = g.grouped(na, "k", "id").agg(x=g.ohlc("v"), n=g.nth("v", 2), q=g.quantile("v", [0.3, 0.5], "lower"), s=g.sum_("v"))
    got = {r["k"]: tuple(r)[1:] for r in df.collect()}
    assert got == {"a": (1.0, 7.5, 1.0, 7.5, 4.0, 1.0, 4.0, 12.5), "b": (2.0,) * 4 + (N, 2.0, 2.0, 2.0), "c": (N,) * 7 + (0.0,)}


TRANSFORMS = [
    (g.cumsum("v"), [1, N, N, 5, 2, N, N, 12.5]), (g.cumsum("v", skipna=False), [1, N, N, N, 2, N, N, N]), (g.cumprod("v"), [1, N, N, 4, 2, N, N, 30]),
    (g.cummin("v"), [1, N, N, 1, 2, N, N, 1]), (g.cummax("v"), [1, N, N, 4, 2, N, N, 7.5]), (g.shift("v"), [N, 1, N, N, N, N, N, 4]), (g.shift("v", -1), [N, N, 4, 7.5, N, N, N, N]),
    (g.ffill("v"), [1, 1, 1, 4, 2, N, N, 7.5]), (g.ffill("v", 1), [1, 1, N, 4, 2, N, N, 7.5]), (g.bfill("v", 1), [1, N, 4, 4, 2, N, N, 7.5]), (g.bfill("v"), [1, 4, 4, 4, 2, N, N, 7.5]),
    (g.rank("v"), [1, N, N, 2, 1, N, N, 3]), (g.rank("v", pct=True), [1 / 3, N, N, 2 / 3, 1, N, N, 1]), (g.shift("v", 0), [1, N, N, 4, 2, N, N, 7.5]),
]


def test_transforms(na):
    df = g.grouped(na, "k", "id").transform(**{f"t{i}": t for i, (t, _) in enumerate(TRANSFORMS)})
    rows = df.orderBy("id").collect()
    for i, (_, expected) in enumerate(TRANSFORMS):
        assert [r[f"t{i}"] for r in rows] == expected


def test_transforms_of_one_spec_share_an_exchange(na):
    df = g.grouped(na, "k", "id").transform(a=g.cumsum("v"), b=g.cummax("v"), c=g.shift("v"), d=g.bfill("v", 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_kleene(spark):
    rows = [("a", True), ("a", N), ("b", False), ("b", N), ("c", N), ("c", N), ("d", False)]
    df = g.grouped(spark.createDataFrame(rows, "k string, b boolean"), "k").agg(p=g.any_("b"), q=g.any_("b", False), r=g.all_("b"), s=g.all_("b", False))
    assert {r["k"]: tuple(r)[1:] for r in df.collect()} == {"a": (True, True, True, N), "b": (False, N, False, False), "c": (False, N, True, N), "d": (False, False, False, False)}


def test_zero_infinity_and_constants(spark):
    inf = float("inf")
    df = spark.createDataFrame([(i, "z", v, None) for i, v in enumerate([0, 3, 5])] + [(10 + i, k, None, x) for i, (k, x) in enumerate([("n", -inf), ("n", -inf), ("p", 1.0), ("p", inf), ("p", 5.0)] + [("c", 0.1)] * 7 + [("s", 1.0), ("s", 2.0)])], "id int, k string, i bigint, x double")
    f = g.grouped(df, "k", "id")
    got = {r["k"]: r for r in f.agg(lo=g.min_("i"), p=g.prod("i"), f=g.first("i"), n=g.count("i"), hi=g.max_("x"), sk=g.skew("x"), va=g.var("x")).collect()}
    assert tuple(got["z"])[1:5] == (0, 0.0, 0, 3) and got["n"]["hi"] == -inf
    assert (got["c"]["sk"], got["c"]["va"]) == (0.0, pytest.approx(0, abs=1e-30)) and got["s"]["sk"] is None
    assert [r["c"] for r in f.transform(c=g.cumsum("x")).where("k = 'p'").orderBy("id").collect()] == [1.0, inf, inf]


def test_declared_groups_and_kept_null_keys(spark, na):
    domain = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    df = g.grouped(na.withColumn("b", F.col("v") > 0), "k", groups=domain).agg(n=g.size(), s=g.sum_("v"), p=g.prod("v"), o=g.any_("b"), e=g.all_("b"), m=g.max_("v"))
    got = {r["k"]: tuple(r)[1:] for r in df.collect()}
    assert set(got) == {"a", "b", "z"} and got["z"] == (0, 0.0, 1.0, False, True, N)
    assert by_key(g.grouped(na, "k", dropna=False).size(), "size")[None] == 1
    assert {r["id"]: r["c"] for r in g.grouped(na, "k", "id", dropna=False).transform(c=g.cumsum("v")).collect()}[7] == 9.0


def test_take(spark):
    src = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "pos bigint, v double")
    ix = spark.createDataFrame(list(enumerate([2, -1, 0, 1, 2, 9])), "out_pos bigint, ix bigint")
    got = {r["out_pos"]: r["v"] for r in g.take(src, ix).collect()}
    assert got == {0: 3.0, 1: N, 2: 1.0, 3: N, 4: 3.0, 5: N}
    assert {r["out_pos"]: r["v"] for r in g.take(src, ix, fill=0).collect()}[1] == 0.0
    with pytest.raises(Exception, match="no row at position 9"):
        g.take(src, ix, missing="raise").collect()
    wide = spark.createDataFrame([(1, 2, 3)], "a bigint, b bigint, c bigint")
    assert tuple(g.take_columns(wide, [2, 0, 2]).first()) == (3, 1, 3)
    with pytest.raises(IndexError):
        g.take_columns(wide, [3])
    numbered = g.with_positions(spark.range(1000).repartition(7).withColumnRenamed("id", "x"), "x")
    assert numbered.where("x <> pos").count() == 0 and numbered.count() == 1000
    two = spark.range(500).selectExpr("cast(id % 7 as string) as a", "if(id % 5 = 0, null, id) as b", "id")
    got = [r["id"] for r in g.with_positions(two, ["a", "b", "id"]).orderBy("pos").collect()]
    assert got == [r["id"] for r in two.orderBy("a", "b", "id").collect()]
    assert g.with_positions(two.where("id < 0"), "id").count() == 0


def test_integer_products_are_exact(spark):
    rows = [("a", v) for v in (3_037_000_499, 3_037_000_499, -1, 1, -1)] + [("b", v) for v in (0, 2**40, 2**40)] + [("c", -(2**62)), ("c", 2), ("d", -1), ("e", N), ("f", 2**53 + 1), ("f", -1)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(3)
    got = g.grouped(df, "k").agg(p=g.prod("v"), q=g.prod("v", min_count=1))
    assert got.schema["p"].dataType == T.LongType()
    assert {r["k"]: (r["p"], r["q"]) for r in got.collect()} == {k: (p, N if k == "e" else p) for k, p in {"a": 3_037_000_499**2, "b": 0, "c": -(2**63), "d": -1, "e": 1, "f": -(2**53) - 1}.items()}
    assert g.grouped(df.where("v <> 0"), "k").agg(p=g.prod("v"))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for more in ([("x", 2)] * 64, [("x", 2**40)] * 2):
        with pytest.raises(Exception, match="exceeds a long|overflow"):
            g.grouped(spark.createDataFrame(more, "k string, v bigint"), "k").agg(p=g.prod("v")).collect()
    domain = spark.createDataFrame([("a",), ("z",)], "k string")
    assert by_key(g.grouped(df, "k", groups=domain).agg(p=g.prod("v")), "p")["z"] == 1


def test_float_results_are_double_unless_cast_back(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.25)], "k string, v float")
    out = g.grouped(df, "k").agg(s=g.sum_("v"), t=g.sum_("v").cast("float"), p=g.prod("v").cast("float"))
    assert [f.dataType for f in out.schema][1:] == [T.DoubleType(), T.FloatType(), T.FloatType()]
    assert tuple(out.first()) == ("a", 3.75, 3.75, 3.375)


def test_names_that_clash_raise(spark, na):
    f = g.grouped(na, "k", "id")
    for make in (lambda: f.transform(v=g.cumsum("v")), lambda: f.transform(ID=g.cumsum("v")), lambda: f.agg(k=g.size()), lambda: f.agg(K=g.size()), lambda: f.agg(x_open=g.size(), x=g.ohlc("v")), lambda: g.with_positions(na, "id", "V")):
        with pytest.raises(ValueError):
            make()
    inner = na.withColumns({"__part": F.lit(1), "__row": F.lit(2), "__n": F.lit(3), "__base": F.lit(4)})
    assert [tuple(r)[3:] for r in g.with_positions(inner, "id").orderBy("id").collect()] == [(1, 2, 3, 4, k) for k in range(8)]


def test_positions_in_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, id % 11) as a", "id").repartition(5)
        got = [r["id"] for r in g.with_positions(rows, ["a", "id"]).orderBy("pos").collect()]
        assert got == [r["id"] for r in rows.orderBy("a", "id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_unsigned_bits(spark):
    df = spark.createDataFrame([(-1, -1, -1), (5, 6, 7)], "a tinyint, b int, c bigint")
    out = g.read_as(df, a="uint8", b="uint32", c="uint64")
    assert [f.dataType for f in out.schema] == [T.ShortType(), T.LongType(), T.DecimalType(20, 0)]
    assert [tuple(map(int, r)) for r in out.orderBy("a").collect()] == [(5, 6, 7), (255, 2**32 - 1, 2**64 - 1)]
    with pytest.raises(TypeError):
        g.read_as(df, a="uint7")
    with pytest.raises(ValueError):
        g.read_as(df, z="uint8")


def test_ranked_reductions_need_one_exchange(na):
    df = g.grouped(na, "k", "id").agg(q=g.quantile("v", 0.3, "lower"), n=g.nth("v", 2), s=g.sum_("v"), f=g.first("v"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def random_frame(seed, n=400):
    r = np.random.default_rng(seed)
    v = r.choice([np.nan, -np.inf, np.inf, *r.normal(size=5).round(2), *r.normal(size=60)], n, p=[0.4, 0.005, 0.005, *[0.03] * 5, *[0.44 / 60] * 60])
    k = r.integers(0, 8, n)
    v[k == 7] = np.nan
    return pd.DataFrame({"id": np.arange(n), "k": k, "v": v})


def same(a, b):
    return all(pd.isna(x) and pd.isna(y) or x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_pandas(spark, seed):
    pdf = random_frame(seed)
    finite = pdf.assign(v=pdf.v.where(np.isfinite(pdf.v)))
    df = spark.createDataFrame(finite).repartition(3)
    f, p = g.grouped(df, "k", "id"), finite.groupby("k").v
    got = f.agg(
        sum=g.sum_("v"), prod=g.prod("v"), mean=g.mean("v"), var=g.var("v"), var0=g.var("v", 0), std=g.std("v"), sem=g.sem("v"), skew=g.skew("v"), median=g.median("v"), min=g.min_("v"), max=g.max_("v"), first=g.first("v"), last=g.last("v"),
        **{f"q_{m}": g.quantile("v", 0.37, m) for m in ("linear", "lower", "higher", "nearest", "midpoint")},
    ).orderBy("k").toPandas()
    want = {"sum": p.sum(), "prod": p.prod(), "mean": p.mean(), "var": p.var(), "var0": p.var(ddof=0), "std": p.std(), "sem": p.sem(), "skew": p.skew(), "median": p.median(), "min": p.min(), "max": p.max(), "first": p.first(), "last": p.last()}
    want |= {f"q_{m}": p.quantile(0.37, interpolation=m) for m in ("linear", "lower", "higher", "nearest", "midpoint")}
    for name, expected in want.items():
        assert same(got[name], expected), name


@pytest.mark.parametrize("seed", [3])
def test_transforms_against_pandas(spark, seed):
    pdf = random_frame(seed)
    df = spark.createDataFrame(pdf).repartition(3)
    p = pdf.groupby("k").v
    options = [(m, a, pct, na) for m in ("average", "min", "max", "first", "dense") for a in (True, False) for pct in (True, False) for na in ("keep", "top", "bottom")]
    made = {f"r{i}": g.rank("v", m, a, pct, na) for i, (m, a, pct, na) in enumerate(options)}
    made |= {"cummin": g.cummin("v"), "cummax": g.cummax("v"), "s1": g.shift("v"), "s3": g.shift("v", -3), "f2": g.ffill("v", 2), "b": g.bfill("v")}
    got = g.grouped(df, "k", "id").transform(**made).orderBy("id").toPandas()
    for i, (m, a, pct, na) in enumerate(options):
        assert same(got[f"r{i}"], p.rank(method=m, ascending=a, pct=pct, na_option=na)), (m, a, pct, na)
    for name, want in {"cummin": p.cummin(), "cummax": p.cummax(), "s1": p.shift(1), "s3": p.shift(-3), "f2": p.ffill(limit=2), "b": p.bfill()}.items():
        assert same(got[name], want), name


def test_row_order_of_the_input_does_not_matter(spark):
    pdf = random_frame(5)
    results = []
    for n in (1, 5):
        df = spark.createDataFrame(pdf.sample(frac=1, random_state=n)).repartition(n)
        results.append(g.grouped(df, "k", "id").transform(a=g.cummax("v"), b=g.ffill("v", 1)).orderBy("id").toPandas())
    pd.testing.assert_frame_equal(*results)


def test_errors(na):
    f = g.grouped(na, "k")
    with pytest.raises(ValueError, match="order_by"):
        f.transform(x=g.cumsum("v"))
    with pytest.raises(TypeError):
        f.agg(x=g.sum_("k"))
    with pytest.raises(TypeError):
        f.agg(x=g.any_("v"))
    for bad in (lambda: g.quantile("v", 1.5), lambda: g.quantile("v", 0.5, "highest"), lambda: g.rank("v", "other"), lambda: g.nth("v", 0), lambda: g.ffill("v", -2), lambda: g.grouped(na, "nope"), lambda: f.agg(x=g.size(), y=g.sum_("nope"))):
        with pytest.raises(ValueError):
            bad()


def test_types():
    assert widened("uint64") == T.DecimalType(20, 0) and widened("uint8") == T.ShortType()
    with pytest.raises(TypeError):
        widened("complex128")


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", "ab"[s % 2], float(s)) for s in range(40)]
    df = spark.createDataFrame(rows, "t string, k string, v double").selectExpr("timestamp(t) as t", "k", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_agg(stream, "k", "t", "20 seconds", "5 seconds", n=g.size(), s=g.sum_("v")).writeStream.format("memory").queryName("grouped_stream").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["window_start"])[-2:], r["k"]): (r["n"], r["s"]) for r in spark.table("grouped_stream").collect()}
    assert got == {(f"{w:02d}", k): (10, float(sum(s for s in range(w, w + 20) if s % 2 == (k == "b")))) for w in (0, 20) for k in "ab"}
    with pytest.raises(ValueError):
        windowed_agg(stream, "k", "t", "20 seconds", "5 seconds", x=g.nth("v", 2))
