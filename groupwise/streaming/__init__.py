"""Grouped reductions over unbounded input.

Reductions that depend on no row order and need no helper columns are mergeable aggregates, so
they run over event-time windows of a stream as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupwise.functions.aggregates import Reduction
from groupwise.functions.na import normalize
from groupwise.spec import GroupSpec
from groupwise.types import require


def windowed_agg(stream: DataFrame, keys: str | Sequence[str], time: str, every: str, late: str, **reductions: Reduction) -> DataFrame:
    """Reductions by key and tumbling event-time window; rows later than `late` are dropped."""
    spec = GroupSpec(keys)
    spec.check(stream)
    columns = []
    for name, r in reductions.items():
        if r.helpers is not None:
            raise ValueError(f"{r.op} needs the whole group and does not run on a stream")
        value = None
        if r.column is not None:
            kind = stream.schema[r.column].dataType
            require(kind, r.needs, r.column, r.op)
            value = normalize(r.column, kind)
        columns += [c.alias(name + suffix) for suffix, c in r.build(value, spec, {}).items()]
    timed = stream.where(spec.key_known).withWatermark(time, late)
    out = timed.groupBy(F.window(time, every).alias("window"), *spec.keys).agg(*columns)
    return out.select(F.col("window.start").alias("window_start"), *spec.keys, *[c for c in out.columns if c not in ("window", *spec.keys)])
