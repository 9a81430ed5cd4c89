"""Grouped transforms: one result for each row. All of a frame share one window partitioning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from groupwise.functions.na import missing
from groupwise.spec import GroupSpec

TIES = ("average", "min", "max", "first", "dense")
NA_OPTIONS = ("keep", "top", "bottom")


@dataclass(frozen=True)
class Transform:
    """op, column and the type asked for; build(v, spec) gives the result column."""

    op: str
    column: str
    needs: str
    build: Callable[[Column, GroupSpec], Column]
    backwards: bool = False


def _cumulative(op: str, column: str, pick: Callable[[Column], Column], skipna: bool, needs: str) -> Transform:
    def make(v: Column, spec: GroupSpec) -> Column:
        w = spec.running(op)
        clean = v.isNotNull() if skipna else missing(v).over(w) == 0
        return F.when(clean, pick(v).over(w))

    return Transform(op, column, needs, make)


def cumsum(column: str, skipna: bool = True) -> Transform:
    """Running sum; a missing value gives NULL there, and without skipna from there on."""
    return _cumulative("cumsum", column, F.sum, skipna, "numeric")


def cumprod(column: str, skipna: bool = True) -> Transform:
    return _cumulative("cumprod", column, lambda v: F.product(v.cast("double")), skipna, "numeric")


def cummin(column: str, skipna: bool = True) -> Transform:
    return _cumulative("cummin", column, F.min, skipna, "orderable")


def cummax(column: str, skipna: bool = True) -> Transform:
    return _cumulative("cummax", column, F.max, skipna, "orderable")


def shift(column: str, periods: int = 1) -> Transform:
    """Value of the row `periods` earlier in the group (later if negative); NULL where there is none."""
    return Transform("shift", column, "any", lambda v, spec: F.lag(v, periods).over(spec.ordered("shift")))


def _fill(op: str, column: str, limit: int, backwards: bool) -> Transform:
    if limit < -1:
        raise ValueError("limit is -1 (none) or a count")

    def make(v: Column, spec: GroupSpec) -> Column:
        if limit == -1:
            return F.last(v, ignorenulls=True).over(spec.running(op, backwards))
        return F.last(v, ignorenulls=True).over(spec.ordered(op, backwards).rowsBetween(-limit, Window.currentRow))

    return Transform(op, column, "any", make, backwards)


def ffill(column: str, limit: int = -1) -> Transform:
    """Missing values take the last value before them, for at most `limit` rows in a row (-1: any)."""
    return _fill("ffill", column, limit, False)


def bfill(column: str, limit: int = -1) -> Transform:
    return _fill("bfill", column, limit, True)


def rank(column: str, method: str = "average", ascending: bool = True, pct: bool = False, na_option: str = "keep") -> Transform:
    """Rank of each value in its group, as double.

    method: how ties rank; pct: as a share of the ranked rows (of the distinct ranks for dense);
    na_option: missing values get NULL, or rank first or last.
    """
    if method not in TIES:
        raise ValueError(f"method is one of {', '.join(TIES)}")
    if na_option not in NA_OPTIONS:
        raise ValueError(f"na_option is one of {', '.join(NA_OPTIONS)}")

    def make(v: Column, spec: GroupSpec) -> Column:
        apart = [v.isNull()] if na_option == "keep" else []
        nulls_first = na_option == "top"
        up = v.asc_nulls_first() if nulls_first else v.asc_nulls_last()
        down = v.desc_nulls_first() if nulls_first else v.desc_nulls_last()
        value = up if ascending else down
        group = Window.partitionBy(*spec.keys, *apart)
        w = group.orderBy(value)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*spec.keys, *apart, v))
        if method == "first":
            found = F.row_number().over(group.orderBy(value, *spec.need_order("rank")))
        elif method == "dense":
            found = F.dense_rank().over(w)
        else:
            found = F.rank().over(w) + {"min": F.lit(0), "max": ties - 1, "average": (ties - 1) / 2}[method]
        found = found.cast("double")
        if pct and method == "dense":
            # ranks from either end add up to the number of distinct values plus one
            other = {(True, False): v.desc_nulls_first(), (True, True): v.desc_nulls_last(), (False, False): v.asc_nulls_first(), (False, True): v.asc_nulls_last()}[ascending, nulls_first]
            found = found / (F.dense_rank().over(w) + F.dense_rank().over(group.orderBy(other)) - 1)
        elif pct:
            found = found / F.count(F.lit(1)).over(group)
        return F.when(v.isNotNull(), found) if na_option == "keep" else found

    return Transform("rank", column, "orderable", make)
