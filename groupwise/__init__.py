"""Grouped analytics on Spark DataFrames: reductions, transforms and positional gather."""

from groupwise.functions.aggregates import Reduction, all_, any_, count, first, last, max_, mean, median, min_, nth, ohlc, prod, quantile, sem, size, skew, std, sum_, var
from groupwise.functions.transforms import Transform, bfill, cummax, cummin, cumprod, cumsum, ffill, rank, shift
from groupwise.operators.frame import GroupedFrame, grouped
from groupwise.operators.gather import take, take_columns, take_elements, with_positions
from groupwise.spec import GroupSpec
from groupwise.types import read_as

__all__ = [
    "GroupSpec", "GroupedFrame", "Reduction", "Transform", "all_", "any_", "bfill", "count", "cummax", "cummin", "cumprod", "cumsum", "ffill", "first", "grouped", "last",
    "max_", "mean", "median", "min_", "nth", "ohlc", "prod", "quantile", "rank", "read_as", "sem", "shift", "size", "skew", "std", "sum_", "take", "take_columns", "take_elements", "var", "with_positions",
]
