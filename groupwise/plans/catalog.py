"""Registered queries of the grouped operators, each with the SQL that gives the same rows.

Sums of money-like columns use the exact mode and other doubles are rounded, as the order of
additions is free in both engines. SQL columns are cast to bigint, double or varchar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import groupwise as g
from groupwise.sources import read_table
from groupwise.types import is_floating

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SPARSE_QUANTITY = "CASE WHEN l_discount > 0.02 THEN l_quantity END"
SPARSE_VALUE = "CASE WHEN event_id % 5 <> 0 THEN value END"
FLAG = "CASE WHEN l_discount = 0 THEN NULL ELSE l_tax > 0.05 END"
SOME_KEY = "CASE WHEN user_id % 7 <> 0 THEN user_id END"
EVENTS = f"(SELECT *, {SPARSE_VALUE} AS v FROM events)"
LINES = f"(SELECT *, {SPARSE_QUANTITY} AS q, {FLAG} AS flag FROM lineitem)"


def _register(name: str, query: Query, sql: str) -> None:
    _QUERIES[name], _SQL[name] = query, " ".join(sql.split())


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if is_floating(f.dataType) else F.col(f.name) for f in df.schema])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").selectExpr("*", f"{SPARSE_QUANTITY} AS q", f"{FLAG} AS flag")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").selectExpr("*", f"{SPARSE_VALUE} AS v")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """events by type: size, sum, mean, variance, median and skewness in one aggregation."""
    f = g.grouped(read_table(spark, d, "events"), "event_type")
    return _rounded(f.agg(size=g.size(), total=g.sum_("value"), mean=g.mean("value"), var=g.var("value"), median=g.median("value"), skew=g.skew("value")), 4)


_register(
    "events_summary",
    flagship,
    """SELECT event_type, count(*) AS size, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS var,
    round(median(value), 4) AS median, round(skewness(value), 4) AS skew FROM events GROUP BY event_type""",
)


def _reduction(name: str, table: Callable, keys: list[str], sql_table: str, sql: str, order_by: str = "", digits: int = 6, **reductions: g.Reduction) -> None:
    """A query of reductions and the select list that gives them."""
    ks = ", ".join(keys)
    _register(name, lambda s, d: _rounded(g.grouped(table(s, d), keys, order_by or ()).agg(**reductions), digits), f"SELECT {ks}, {sql} FROM {sql_table} GROUP BY {ks}")


_reduction("group_size", _events, ["event_type"], "events", "count(*) AS size", size=g.size())
_reduction("group_count", _events, ["event_type"], EVENTS, "count(v) AS n", n=g.count("v"))
_reduction("group_sum", _lines, ["l_suppkey"], LINES, "coalesce(cast(sum(cast(q AS DECIMAL(18,2))) AS DOUBLE), 0) AS total", total=g.sum_("q", exact=2))
_reduction("group_sum_min_count", _lines, ["l_orderkey"], LINES, "CASE WHEN count(q) >= 3 THEN cast(sum(cast(q AS DECIMAL(18,2))) AS DOUBLE) END AS total", total=g.sum_("q", min_count=3, exact=2))
_reduction("group_sum_integer", _lines, ["l_returnflag"], LINES, "cast(sum(l_linenumber) AS BIGINT) AS total", total=g.sum_("l_linenumber"))
_register(
    "group_prod",
    lambda s, d: _rounded(g.grouped(_lines(s, d).withColumn("x", 1 + F.col("l_tax")), "l_orderkey").agg(p=g.prod("x"))),
    "SELECT l_orderkey, round(coalesce(product(1 + l_tax), 1), 6) AS p FROM lineitem GROUP BY l_orderkey",
)
_register(
    "group_prod_min_count",
    lambda s, d: _rounded(g.grouped(_lines(s, d).selectExpr("*", "CASE WHEN l_discount > 0.02 THEN 1 + l_tax END AS x"), "l_orderkey").agg(p=g.prod("x", min_count=2))),
    "SELECT l_orderkey, CASE WHEN count(x) >= 2 THEN round(product(x), 6) END AS p FROM (SELECT *, CASE WHEN l_discount > 0.02 THEN 1 + l_tax END AS x FROM lineitem) GROUP BY l_orderkey",
)
FLAGS = ["l_returnflag", "l_linestatus"]
_reduction("group_mean", _lines, FLAGS, LINES, "round(avg(q), 6) AS m", m=g.mean("q"))
_reduction("group_var", _lines, FLAGS, LINES, "round(var_samp(q), 6) AS x", x=g.var("q"))
_reduction("group_std", _lines, FLAGS, LINES, "round(stddev_samp(q), 6) AS x", x=g.std("q"))
_reduction("group_sem", _lines, FLAGS, LINES, "round(stddev_samp(q) / sqrt(count(q)), 6) AS x", x=g.sem("q"))
_reduction("group_var_ddof0", _orders, ["o_custkey"], "orders", "round(var_pop(o_totalprice), -3) AS x", digits=-3, x=g.var("o_totalprice", ddof=0))
_reduction("group_var_ddof2", _events, ["user_id"], EVENTS, "CASE WHEN count(v) > 2 THEN round(var_pop(v) * count(v) / (count(v) - 2), 4) END AS x", digits=4, x=g.var("v", ddof=2))
_reduction("group_skew", _events, ["event_type"], EVENTS, "CASE WHEN count(v) < 3 THEN NULL WHEN var_pop(v) = 0 THEN 0 ELSE round(skewness(v), 6) END AS x", x=g.skew("v"))
_reduction("group_skew_noskipna", _events, ["user_id"], EVENTS, "CASE WHEN count(v) < count(*) OR count(v) < 3 THEN NULL WHEN var_pop(v) = 0 THEN 0 ELSE round(skewness(v), 6) END AS x", x=g.skew("v", skipna=False))
_reduction("group_median", _lines, ["l_suppkey"], LINES, "round(median(q), 6) AS x", x=g.median("q"))
_reduction("group_quantile_linear", _lines, ["l_suppkey"], LINES, "round(quantile_cont(q, 0.1), 6) AS x_0, round(quantile_cont(q, 0.5), 6) AS x_1, round(quantile_cont(q, 0.9), 6) AS x_2", x=g.quantile("q", [0.1, 0.5, 0.9]))


def _quantiles(mode: str, inexact: str) -> None:
    def at(q: str) -> str:
        lo = f"cast(floor({q} * (len(a) - 1)) AS INT)"
        part = f"({q} * (len(a) - 1) - floor({q} * (len(a) - 1)))"
        return f"CASE WHEN a IS NULL THEN NULL WHEN {part} = 0 THEN a[{lo} + 1] ELSE {inexact.format(lo=lo, part=part, q=q)} END"

    _register(
        f"group_quantile_{mode}",
        lambda s, d: g.grouped(_events(s, d), "user_id").agg(x=g.quantile("v", [0.3, 0.5, 0.75], mode)),
        f"""SELECT user_id, {at("0.3::double")} AS x_0, {at("0.5::double")} AS x_1, {at("0.75::double")} AS x_2
        FROM (SELECT user_id, list_sort(list(v) FILTER (WHERE v IS NOT NULL)) AS a FROM {EVENTS} GROUP BY user_id)""",
    )


_quantiles("lower", "a[{lo} + 1]")
_quantiles("higher", "a[{lo} + 2]")
_quantiles("midpoint", "(a[{lo} + 1] + a[{lo} + 2]) / 2")
_quantiles("nearest", "CASE WHEN {part} > 0.5 OR ({part} = 0.5 AND {q} > 0.5) THEN a[{lo} + 2] ELSE a[{lo} + 1] END")
_reduction("group_min", _orders, ["o_custkey"], "orders", "min(o_totalprice) AS x, min(o_orderpriority) AS s", x=g.min_("o_totalprice"), s=g.min_("o_orderpriority"))
_reduction("group_max", _orders, ["o_custkey"], "orders", "max(o_totalprice) AS x, max(o_orderpriority) AS s", x=g.max_("o_totalprice"), s=g.max_("o_orderpriority"))
_reduction("group_min_min_count", _lines, ["l_orderkey"], LINES, "CASE WHEN count(q) >= 2 THEN min(q) END AS lo, CASE WHEN count(q) >= 2 THEN max(q) END AS hi", lo=g.min_("q", 2), hi=g.max_("q", 2))
_reduction("group_any", _lines, ["l_orderkey"], LINES, "coalesce(bool_or(flag), false) AS b", b=g.any_("flag"))
_reduction("group_all", _lines, ["l_orderkey"], LINES, "coalesce(bool_and(flag), true) AS b", b=g.all_("flag"))
_reduction("group_any_kleene", _lines, ["l_orderkey"], LINES, "CASE WHEN coalesce(bool_or(flag), false) THEN true WHEN count(*) > count(flag) THEN NULL ELSE false END AS b", b=g.any_("flag", skipna=False))
_reduction("group_all_kleene", _lines, ["l_orderkey"], LINES, "CASE WHEN NOT coalesce(bool_and(flag), true) THEN false WHEN count(*) > count(flag) THEN NULL ELSE true END AS b", b=g.all_("flag", skipna=False))
_reduction("group_first", _events, ["user_id"], EVENTS, "arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS x, arg_min(event_type, event_id) AS t", "event_id", x=g.first("v"), t=g.first("event_type"))
_reduction("group_last", _events, ["user_id"], EVENTS, "arg_max(v, event_id) FILTER (WHERE v IS NOT NULL) AS x, arg_max(event_type, event_id) AS t", "event_id", x=g.last("v"), t=g.last("event_type"))
_register(
    "group_nth2",
    lambda s, d: g.grouped(_events(s, d), "user_id", "event_id").agg(x=g.nth("v", 2), t=g.nth("event_type", 2)),
    f"""SELECT user_id, max(CASE WHEN v IS NOT NULL AND rv = 2 THEN v END) AS x, max(CASE WHEN rt = 2 THEN event_type END) AS t FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, v IS NULL ORDER BY event_id) AS rv, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rt FROM {EVENTS}) GROUP BY user_id""",
)
_reduction(
    "group_ohlc", _events, ["event_type"], EVENTS,
    "arg_min(v, ts) FILTER (WHERE v IS NOT NULL) AS x_open, max(v) AS x_high, min(v) AS x_low, arg_max(v, ts) FILTER (WHERE v IS NOT NULL) AS x_close", "ts", x=g.ohlc("v"),
)


def _transform(name: str, sql: str, windows: str = "", digits: int = 4, **transforms: g.Transform) -> None:
    """A query of transforms of events by user in the order of event_id."""

    def query(s: SparkSession, d: str) -> DataFrame:
        out = g.grouped(_events(s, d), "user_id", "event_id").transform(**transforms)
        return _rounded(out.select("event_id", *transforms), digits)

    base = f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {EVENTS})"
    _register(name, query, f"SELECT event_id, {sql} FROM {base} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY user_id ORDER BY event_id), b AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING){windows}")


CLEAN = "count(*) FILTER (WHERE v IS NULL) OVER w = 0"
_transform("group_cumsum", "CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 4) END AS x", x=g.cumsum("v"))
_transform("group_cumsum_noskipna", f"CASE WHEN {CLEAN} THEN round(sum(v) OVER w, 4) END AS x", x=g.cumsum("v", skipna=False))
_transform("group_cummin", "CASE WHEN v IS NOT NULL THEN round(min(v) OVER w, 4) END AS x", x=g.cummin("v"))
_transform("group_cummin_noskipna", f"CASE WHEN {CLEAN} THEN round(min(v) OVER w, 4) END AS x", x=g.cummin("v", skipna=False))
_transform("group_cummax", "CASE WHEN v IS NOT NULL THEN round(max(v) OVER w, 4) END AS x", x=g.cummax("v"))
_transform("group_cummax_noskipna", f"CASE WHEN {CLEAN} THEN round(max(v) OVER w, 4) END AS x", x=g.cummax("v", skipna=False))


def _cumprod(name: str, skipna: bool, sql: str) -> None:
    """Factors near one, so that long products stay finite."""
    factor = "CASE WHEN event_id % 5 <> 0 THEN 1 + (event_id % 7 - 3) / 100.0 END"
    _register(
        name,
        lambda s, d: _rounded(g.grouped(_events(s, d).selectExpr("event_id", "user_id", f"cast({factor} as double) as f"), "user_id", "event_id").transform(x=g.cumprod("f", skipna)).select("event_id", "x")),
        f"SELECT event_id, {sql} FROM (SELECT *, cast({factor} AS DOUBLE) AS f FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    )


_cumprod("group_cumprod", True, "CASE WHEN f IS NOT NULL THEN round(product(f) OVER w, 6) END AS x")
_cumprod("group_cumprod_noskipna", False, "CASE WHEN count(*) FILTER (WHERE f IS NULL) OVER w = 0 THEN round(product(f) OVER w, 6) END AS x")
_transform("group_shift1", "round(lag(v, 1) OVER o, 4) AS x", x=g.shift("v", 1))
_transform("group_shift_neg2", "round(lead(v, 2) OVER o, 4) AS x", x=g.shift("v", -2))
_transform("group_shift0", "round(v, 4) AS x", x=g.shift("v", 0))
_transform("group_ffill", "round(last_value(v IGNORE NULLS) OVER w, 4) AS x", x=g.ffill("v"))
_transform("group_bfill", "round(last_value(v IGNORE NULLS) OVER b, 4) AS x", x=g.bfill("v"))
_transform("group_ffill_limit1", "CASE WHEN rn - last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER w <= 1 THEN round(last_value(v IGNORE NULLS) OVER w, 4) END AS x", x=g.ffill("v", 1))
_transform("group_bfill_limit1", "CASE WHEN last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER b - rn <= 1 THEN round(last_value(v IGNORE NULLS) OVER b, 4) END AS x", x=g.bfill("v", 1))
_transform(
    "group_transforms_fused", "CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 4) END AS s, CASE WHEN v IS NOT NULL THEN round(max(v) OVER w, 4) END AS m, round(lag(v, 1) OVER o, 4) AS l",
    s=g.cumsum("v"), m=g.cummax("v"), l=g.shift("v", 1),
)


def _rank(name: str, sql: str, **parameters) -> None:
    """Rank of values cut to ten steps, so that there are ties."""
    step = "CASE WHEN event_id % 5 <> 0 THEN cast(floor(value) AS BIGINT) % 10 END"
    _register(
        name,
        lambda s, d: _rounded(g.grouped(_events(s, d).selectExpr("event_id", "user_id", f"{step} AS r"), "user_id", "event_id").transform(x=g.rank("r", **parameters)).select("event_id", "x")),
        f"SELECT event_id, round(cast({sql} AS DOUBLE), 6) AS x FROM (SELECT *, {step} AS r FROM events) "
        "WINDOW k AS (PARTITION BY user_id, r IS NULL ORDER BY r), p AS (PARTITION BY user_id, r IS NULL), t AS (PARTITION BY user_id, r), f AS (PARTITION BY user_id, r IS NULL ORDER BY r, event_id), "
        "d AS (PARTITION BY user_id ORDER BY r DESC NULLS FIRST), l AS (PARTITION BY user_id ORDER BY r NULLS LAST)",
    )


_rank("group_rank_average", "CASE WHEN r IS NOT NULL THEN rank() OVER k + (count(*) OVER t - 1) / 2.0 END")
_rank("group_rank_min", "CASE WHEN r IS NOT NULL THEN rank() OVER k END", method="min")
_rank("group_rank_max", "CASE WHEN r IS NOT NULL THEN rank() OVER k + count(*) OVER t - 1 END", method="max")
_rank("group_rank_first", "CASE WHEN r IS NOT NULL THEN row_number() OVER f END", method="first")
_rank("group_rank_dense", "CASE WHEN r IS NOT NULL THEN dense_rank() OVER k END", method="dense")
_rank("group_rank_pct", "CASE WHEN r IS NOT NULL THEN (rank() OVER k + (count(*) OVER t - 1) / 2.0) / count(*) OVER p END", pct=True)
_rank("group_rank_dense_pct", "CASE WHEN r IS NOT NULL THEN dense_rank() OVER k / cast(count(DISTINCT r) OVER p AS DOUBLE) END", method="dense", pct=True)
_rank("group_rank_descending_top", "rank() OVER d", method="min", ascending=False, na_option="top")
_rank("group_rank_bottom", "rank() OVER l + (count(*) OVER t - 1) / 2.0", na_option="bottom")


def _take_1d(s: SparkSession, d: str) -> DataFrame:
    source = g.with_positions(_orders(s, d).select("o_orderkey", "o_totalprice"), "o_orderkey")
    index = _orders(s, d).selectExpr("o_orderkey AS out_pos", "CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE (o_orderkey * 7) % 1000 END AS ix")
    return g.take(source, index)


_register(
    "take_1d",
    _take_1d,
    """SELECT i.out_pos, i.ix, s.o_orderkey, s.o_totalprice FROM (SELECT o_orderkey AS out_pos, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE (o_orderkey * 7) % 1000 END AS ix FROM orders) i
    LEFT JOIN (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) s ON i.ix = s.pos""",
)
_register(
    "take_1d_fill",
    lambda s, d: g.take(_orders(s, d).selectExpr("o_orderkey AS pos", "o_totalprice"), _orders(s, d).selectExpr("o_orderkey AS out_pos", "CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey END AS ix"), fill=0),
    """SELECT i.out_pos, i.ix, CASE WHEN i.ix = -1 THEN 0 ELSE s.o_totalprice END AS o_totalprice FROM (SELECT o_orderkey AS out_pos, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey END AS ix FROM orders) i
    LEFT JOIN orders s ON i.ix = s.o_orderkey""",
)


def _elements(s: SparkSession, d: str) -> DataFrame:
    taken: Column = g.take_elements("embedding", [3, 0, 3, 1])
    return read_table(s, d, "embeddings").select("vec_id", taken.alias("t")).select("vec_id", *[F.get("t", F.lit(k)).cast("double").alias(f"e{k}") for k in range(4)])


_register("take_2d_elements", _elements, "SELECT vec_id, cast(embedding[4] AS DOUBLE) AS e0, cast(embedding[1] AS DOUBLE) AS e1, cast(embedding[4] AS DOUBLE) AS e2, cast(embedding[2] AS DOUBLE) AS e3 FROM embeddings")
_register(
    "take_2d_axis1",
    lambda s, d: g.take_columns(_lines(s, d).selectExpr("l_orderkey", "l_partkey", "l_suppkey", "cast(l_linenumber AS BIGINT) AS l_linenumber"), [2, 0, 2, 1]),
    "SELECT l_suppkey AS c0, l_orderkey AS c1, l_suppkey AS c2, l_partkey AS c3 FROM lineitem",
)
_register(
    "null_keys_dropped",
    lambda s, d: g.grouped(_events(s, d).selectExpr("*", f"{SOME_KEY} AS k"), "k").agg(n=g.size(), v=g.count("v")),
    f"SELECT {SOME_KEY} AS k, count(*) AS n, count(v) AS v FROM {EVENTS} WHERE user_id % 7 <> 0 GROUP BY 1",
)
_register(
    "null_keys_kept",
    lambda s, d: g.grouped(_events(s, d).selectExpr("*", f"{SOME_KEY} AS k"), "k", dropna=False).agg(n=g.size(), v=g.count("v")),
    f"SELECT {SOME_KEY} AS k, count(*) AS n, count(v) AS v FROM {EVENTS} GROUP BY 1",
)
_register(
    "null_keys_in_transforms",
    lambda s, d: _rounded(g.grouped(_events(s, d).selectExpr("*", f"{SOME_KEY} AS k"), "k", "event_id").transform(x=g.cumsum("v"), y=g.shift("v")).select("event_id", "x", "y"), 4),
    f"""SELECT event_id, CASE WHEN k IS NOT NULL AND v IS NOT NULL THEN round(sum(v) OVER w, 4) END AS x, CASE WHEN k IS NOT NULL THEN round(lag(v) OVER (PARTITION BY k ORDER BY event_id), 4) END AS y
    FROM (SELECT *, {SOME_KEY} AS k FROM {EVENTS}) WINDOW w AS (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)


def _empty_groups(s: SparkSession, d: str) -> DataFrame:
    nations = read_table(s, d, "nation").where("n_regionkey <> 2").selectExpr("n_regionkey AS k", "cast(n_nationkey AS double) AS x", "n_nationkey > 3 AS b")
    domain = read_table(s, d, "region").selectExpr("r_regionkey AS k")
    return g.grouped(nations, "k", groups=domain).agg(n=g.size(), s=g.sum_("x"), s1=g.sum_("x", min_count=1), p=g.prod("x"), a=g.any_("b"), e=g.all_("b"), m=g.mean("x"), hi=g.max_("x"))


_register(
    "empty_groups",
    _empty_groups,
    """SELECT r_regionkey AS k, count(n_regionkey) AS n, coalesce(sum(x), 0) AS s, sum(x) AS s1, coalesce(product(x), 1) AS p, coalesce(bool_or(x > 3), false) AS a, coalesce(bool_and(x > 3), true) AS e, avg(x) AS m, max(x) AS hi
    FROM region LEFT JOIN (SELECT n_regionkey, cast(n_nationkey AS DOUBLE) AS x FROM nation WHERE n_regionkey <> 2) ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
)


def _all_positions(s: SparkSession, d: str) -> DataFrame:
    source = g.with_positions(_orders(s, d).select("o_orderkey", "o_totalprice"), "o_orderkey")
    n = _orders(s, d).count()
    return g.take(source, _orders(s, d).selectExpr("o_orderkey AS out_pos", f"(o_orderkey * 7919) % {n} AS ix"))


_register(
    "take_1d_all_positions",
    _all_positions,
    """SELECT i.out_pos, i.ix, s.o_orderkey, s.o_totalprice FROM (SELECT o_orderkey AS out_pos, (o_orderkey * 7919) % (SELECT count(*) FROM orders) AS ix FROM orders) i
    LEFT JOIN (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) s ON i.ix = s.pos""",
)
_reduction(
    "group_prod_integer", lambda s, d: read_table(s, d, "lineitem"), ["l_orderkey"], "lineitem", "cast(product(l_linenumber + 0.0) AS BIGINT) AS p, CASE WHEN count(*) >= 3 THEN cast(product(l_linenumber + 0.0) AS BIGINT) END AS p3",
    p=g.prod("l_linenumber"), p3=g.prod("l_linenumber", min_count=3),
)


# Columns of other types: float32, decimal, unsigned and timestamps.
def _floats(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").selectExpr("label", "vec_id", "embedding[0] AS x", "CASE WHEN vec_id % 4 <> 0 THEN embedding[1] END AS y")


def _float_results(s: SparkSession, d: str) -> DataFrame:
    f = g.grouped(_floats(s, d), "label", "vec_id")
    out = f.agg(n=g.count("y"), total=g.sum_("x"), mean=g.mean("y"), var=g.var("x"), median=g.median("x"), q=g.quantile("y", 0.3, "higher"), lo=g.min_("y").cast("double"), hi=g.max_("x").cast("double"), head=g.first("y").cast("double"))
    return _rounded(out, 5)


_register(
    "dtype_float32",
    _float_results,
    """SELECT label, count(y) AS n, round(sum(x), 5) AS total, round(avg(y), 5) AS mean, round(var_samp(x), 5) AS var, round(median(x), 5) AS median,
    round(list_sort(list(y) FILTER (WHERE y IS NOT NULL))[cast(ceil(0.3::double * (count(y) - 1)) AS INT) + 1], 5) AS q, round(min(y), 5) AS lo, round(max(x), 5) AS hi, round(arg_min(y, vec_id) FILTER (WHERE y IS NOT NULL), 5) AS head
    FROM (SELECT label, vec_id, cast(embedding[1] AS DOUBLE) AS x, CASE WHEN vec_id % 4 <> 0 THEN cast(embedding[2] AS DOUBLE) END AS y FROM embeddings) GROUP BY label""",
)


def _decimals(s: SparkSession, d: str) -> DataFrame:
    lines = _lines(s, d).selectExpr("l_orderkey", "cast(q AS DECIMAL(12,2)) AS m")
    f = g.grouped(lines, "l_orderkey")
    return f.agg(n=g.count("m"), total=g.sum_("m", min_count=1).cast("double"), mean=g.mean("m"), lo=g.min_("m").cast("double"), hi=g.max_("m").cast("double"), mid=g.median("m").cast("double"))


_register(
    "dtype_decimal",
    lambda s, d: _rounded(_decimals(s, d)),
    f"""SELECT l_orderkey, count(m) AS n, round(cast(sum(m) AS DOUBLE), 6) AS total, round(avg(cast(m AS DOUBLE)), 6) AS mean, round(cast(min(m) AS DOUBLE), 6) AS lo,
    round(cast(max(m) AS DOUBLE), 6) AS hi, round(median(cast(m AS DOUBLE)), 6) AS mid FROM (SELECT *, cast(q AS DECIMAL(12,2)) AS m FROM {LINES}) GROUP BY l_orderkey""",
)
BITS = "cast((event_id * 2654435) % 2000000000 - 1000000000 AS INT)"


def _unsigned(s: SparkSession, d: str) -> DataFrame:
    rows = g.read_as(read_table(s, d, "events").selectExpr("event_id", "user_id", f"{BITS} AS u"), u="uint32")
    f = g.grouped(rows, "user_id", "event_id")
    return f.agg(total=g.sum_("u"), lo=g.min_("u"), hi=g.max_("u"), tail=g.last("u"))


_register(
    "dtype_unsigned",
    _unsigned,
    f"""SELECT user_id, cast(sum(u) AS BIGINT) AS total, min(u) AS lo, max(u) AS hi, arg_max(u, event_id) AS tail
    FROM (SELECT event_id, user_id, CASE WHEN b < 0 THEN cast(b AS BIGINT) + 4294967296 ELSE cast(b AS BIGINT) END AS u FROM (SELECT *, {BITS} AS b FROM events)) GROUP BY user_id""",
)


def _times(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "events").selectExpr("event_id", "user_id", "CASE WHEN event_id % 5 <> 0 THEN cast(ts AS TIMESTAMP) END AS t")
    out = g.grouped(rows, "user_id", "event_id").transform(before=g.shift("t"), filled=g.ffill("t"), latest=g.cummax("t"), place=g.rank("t", method="min"))
    return out.select("event_id", *[F.unix_micros(c).alias(c) for c in ("before", "filled", "latest")], F.col("place").cast("long").alias("place"))


_register(
    "dtype_timestamp",
    _times,
    """SELECT event_id, epoch_us(lag(t) OVER o) AS before, epoch_us(last_value(t IGNORE NULLS) OVER w) AS filled, CASE WHEN t IS NOT NULL THEN epoch_us(max(t) OVER w) END AS latest,
    CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY user_id, t IS NULL ORDER BY t) END AS place FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN cast(ts AS TIMESTAMP) END AS t FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY user_id ORDER BY event_id)""",
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
