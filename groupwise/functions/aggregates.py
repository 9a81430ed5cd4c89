"""Grouped reductions.

Each function returns a Reduction; GroupedFrame.agg puts all of them into one aggregation. A
reduction may ask for helper columns (ranks over the group's own window), which share the
aggregation's partitioning, so that no further shuffle is needed. Values are NA-normalised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.functions.na import missing
from groupwise.spec import GroupSpec

INTERPOLATIONS = ("linear", "lower", "higher", "nearest", "midpoint")


@dataclass(frozen=True)
class Reduction:
    """op and column; needs: the type asked for; build(v, spec, helpers) gives {suffix: Column}.

    helpers(v, spec) gives {name: Column} to be computed before the aggregation; empty is the value
    of a declared group without rows; typed(kind) gives the reduction for a column of that type.
    """

    op: str
    column: str | None
    needs: str
    build: Callable[[Column, GroupSpec, dict[str, Column]], dict[str, Column]]
    helpers: Callable[[Column, GroupSpec], dict[str, Column]] | None = None
    empty: object = None
    typed: Callable[[T.DataType], Reduction] | None = None

    def cast(self, kind: str) -> Reduction:
        """The results as another type; those of float columns are double unless cast back."""

        def build(v, spec, helpers):
            return {name: c.cast(kind) for name, c in self.build(v, spec, helpers).items()}

        return replace(self, build=build, typed=(lambda t: self.typed(t).cast(kind)) if self.typed else None)


def _one(op, column, needs, make, empty=None, helpers=None) -> Reduction:
    return Reduction(op, column, needs, lambda v, spec, h: {"": make(v, spec, h)}, helpers, empty)


def _at_least(v: Column, least: int, result: Column) -> Column:
    return F.when(F.count(v) >= least, result) if least > 0 else result


def size() -> Reduction:
    """Rows of the group, missing values included."""
    return _one("size", None, "any", lambda v, s, h: F.count(F.lit(1)), 0)


def count(column: str) -> Reduction:
    """Values that are not missing."""
    return _one("count", column, "any", lambda v, s, h: F.count(v), 0)


def sum_(column: str, min_count: int = 0, exact: int | None = None) -> Reduction:
    """Sum of the values; NULL with fewer than min_count of them.

    exact: decimals to keep; the sum then is over decimal(38, exact), free of the order of rows,
    and exact for inputs with no more decimals than that.
    """

    def make(v, s, h):
        total = F.sum(v.cast(f"decimal(38,{exact})")).cast("double") if exact is not None else F.sum(v)
        return _at_least(v, min_count, F.coalesce(total, F.lit(0)))

    return _one("sum", column, "numeric", make, 0 if min_count <= 0 else None)


def prod(column: str, min_count: int = 0) -> Reduction:
    """Product; NULL with fewer than min_count values.

    Of integer columns it is exact, a long, and raises on overflow; of others, and on streams, a double.
    """
    plain = _one("prod", column, "numeric", lambda v, s, h: _at_least(v, min_count, F.coalesce(F.product(v.cast("double")), F.lit(1.0))), 1.0 if min_count <= 0 else None)
    return replace(plain, typed=lambda kind: _whole_prod(column, min_count) if isinstance(kind, T.IntegralType) else plain)


def _whole_prod(column: str, min_count: int) -> Reduction:
    """A product within a long has at most 63 factors other than 0, 1 and -1, so no more are collected."""
    name = f"__factor_{column}"

    def helpers(v, spec):
        factor = v.isNotNull() & ~v.isin(0, 1, -1)
        return {name: F.when(factor, F.row_number().over(spec.group().orderBy(factor.desc())))}

    def make(v, spec, h):
        factors = F.collect_list(F.when(h[name] <= 64, v.cast("long")))
        sign = (1 - 2 * (F.count_if(v == -1) % 2)).cast("long")
        product = F.aggregate(factors, sign, lambda a, x: a * x)
        overflow = F.raise_error(F.lit(f"prod({column}) exceeds a long")).cast("long")
        return _at_least(v, min_count, F.when(F.count_if(v == 0) > 0, F.lit(0).cast("long")).when(F.count(h[name]) > 63, overflow).otherwise(product))

    return _one("prod", column, "numeric", make, 1 if min_count <= 0 else None, helpers)


def mean(column: str) -> Reduction:
    return _one("mean", column, "numeric", lambda v, s, h: F.avg(v.cast("double")))


def _variance(v: Column, ddof: int) -> Column:
    n = F.count(v)
    known = {0: F.var_pop(v), 1: F.var_samp(v)}.get(ddof, F.var_pop(v) * n / F.when(n > ddof, n - ddof))
    return F.when(n > ddof, known)


def var(column: str, ddof: int = 1) -> Reduction:
    """Sum of squared deviations over n - ddof; NULL where n <= ddof."""
    return _one("var", column, "numeric", lambda v, s, h: _variance(v.cast("double"), ddof))


def std(column: str, ddof: int = 1) -> Reduction:
    return _one("std", column, "numeric", lambda v, s, h: F.sqrt(_variance(v.cast("double"), ddof)))


def sem(column: str, ddof: int = 1) -> Reduction:
    """Standard error of the mean: sqrt(var / n)."""
    return _one("sem", column, "numeric", lambda v, s, h: F.sqrt(_variance(v.cast("double"), ddof) / F.count(v)))


def skew(column: str, skipna: bool = True) -> Reduction:
    """Adjusted Fisher-Pearson skewness; NULL below three values, 0 for equal ones."""

    def make(v, s, h):
        v = v.cast("double")
        n = F.count(v).cast("double")
        adjusted = F.when(n < 3, F.lit(None).cast("double")).when(F.var_pop(v) == 0, F.lit(0.0)).otherwise(F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
        return adjusted if skipna else F.when(missing(v) == 0, adjusted)

    return _one("skew", column, "numeric", make)


def median(column: str) -> Reduction:
    return _one("median", column, "numeric", lambda v, s, h: F.median(v))


def _place(column: str) -> str:
    return f"__place_{column}"


def quantile(column: str, q: float | list[float], interpolation: str = "linear") -> Reduction:
    """Exact quantiles of the values. A list of q gives a column for each, in order: _0, _1, ...

    Other interpolations than linear pick values by their rank in the group's window, which
    spills to disk for a large group instead of holding it in memory.
    """
    qs = [q] if isinstance(q, (int, float)) else list(q)
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation is one of {', '.join(INTERPOLATIONS)}")
    if not qs or not all(0 <= x <= 1 for x in qs):
        raise ValueError("quantiles lie between 0 and 1")
    names = [""] if isinstance(q, (int, float)) else [f"_{k}" for k in range(len(qs))]

    def helpers(v, spec):
        if interpolation == "linear":
            return {}
        w = spec.group()
        return {_place(column): F.row_number().over(w.orderBy(v.asc_nulls_last())), f"{_place(column)}_n": F.count(v).over(w)}

    def make(v, spec, h):
        if interpolation == "linear":
            return {n: F.percentile(v, F.lit(float(x))) for n, x in zip(names, qs, strict=True)}
        place, n = h[_place(column)], h[f"{_place(column)}_n"]
        return {name: _picked(v.cast("double"), place, n, float(x)) for name, x in zip(names, qs, strict=True)}

    def _picked(v, place, n, x):
        at = F.lit(x) * (n - 1)
        low = F.floor(at)
        part = F.max(at - low)
        lower, upper = (F.max(F.when((place == low + k) & v.isNotNull(), v)) for k in (1, 2))
        if interpolation == "lower":
            return lower
        if interpolation == "higher":
            inexact = upper
        elif interpolation == "midpoint":
            inexact = (lower + upper) / 2
        else:  # nearest: a half goes up for q above one half only
            inexact = F.when((part > 0.5) | ((part == 0.5) & F.lit(x > 0.5)), upper).otherwise(lower)
        return F.when(part == 0, lower).otherwise(inexact)

    return Reduction("quantile", column, "numeric", make, helpers)


def min_(column: str, min_count: int = 1) -> Reduction:
    return _one("min", column, "orderable", lambda v, s, h: _at_least(v, max(min_count, 1), F.min(v)))


def max_(column: str, min_count: int = 1) -> Reduction:
    return _one("max", column, "orderable", lambda v, s, h: _at_least(v, max(min_count, 1), F.max(v)))


def any_(column: str, skipna: bool = True) -> Reduction:
    """True if a value is true; without skipna by Kleene's logic (unknown unless decided)."""

    def make(v, s, h):
        seen = F.coalesce(F.bool_or(v), F.lit(False))
        return seen if skipna else F.when(seen, True).when(missing(v) > 0, F.lit(None)).otherwise(False)

    return _one("any", column, "boolean", make, False)


def all_(column: str, skipna: bool = True) -> Reduction:
    def make(v, s, h):
        seen = F.coalesce(F.bool_and(v), F.lit(True))
        return seen if skipna else F.when(~seen, False).when(missing(v) > 0, F.lit(None)).otherwise(True)

    return _one("all", column, "boolean", make, True)


def _by_order(pick, v: Column, spec: GroupSpec, op: str) -> Column:
    return pick(v, F.when(v.isNotNull(), spec.order_value(op)))


def first(column: str, min_count: int = 1) -> Reduction:
    """First value in row order that is not missing."""
    return _one("first", column, "any", lambda v, s, h: _at_least(v, max(min_count, 1), _by_order(F.min_by, v, s, "first")))


def last(column: str, min_count: int = 1) -> Reduction:
    return _one("last", column, "any", lambda v, s, h: _at_least(v, max(min_count, 1), _by_order(F.max_by, v, s, "last")))


def nth(column: str, rank: int = 1, min_count: int = 1) -> Reduction:
    """rank-th value (from 1) in row order that is not missing; NULL if there are fewer."""
    if rank < 1:
        raise ValueError("rank counts from 1")
    if rank == 1:
        return first(column, min_count)
    name = f"__nth_{column}"

    def helpers(v, spec):
        w = spec.group().orderBy(v.isNull(), *[F.col(c) for c in spec.need_order("nth")])
        return {name: F.when(v.isNotNull(), F.row_number().over(w))}

    return _one("nth", column, "any", lambda v, s, h: _at_least(v, max(min_count, 1), F.max_by(v, F.when(h[name] == rank, F.lit(1)))), None, helpers)


def ohlc(column: str) -> Reduction:
    """First, largest, smallest and last value: _open, _high, _low, _close."""

    def make(v, spec, h):
        return {"_open": _by_order(F.min_by, v, spec, "ohlc"), "_high": F.max(v), "_low": F.min(v), "_close": _by_order(F.max_by, v, spec, "ohlc")}

    return Reduction("ohlc", column, "numeric", make)
