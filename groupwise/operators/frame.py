"""GroupedFrame: all reductions of a call in one aggregation, all transforms in one select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.functions.aggregates import Reduction
from groupwise.functions.na import normalize
from groupwise.functions.transforms import Transform
from groupwise.spec import GroupSpec
from groupwise.types import require


def _distinct(names: Sequence[str], expected: int | None = None) -> None:
    """Raise ValueError unless the names differ, whatever their case."""
    seen: dict[str, int] = {}
    for n in names:
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
    twice = [n for n, k in seen.items() if k > 1]
    if twice or len(seen) < (expected or 0):
        raise ValueError(f"columns of one name: {', '.join(twice) or 'results'}")


class GroupedFrame:
    """df grouped by keys; see GroupSpec for the parameters."""

    def __init__(self, df: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str] = (), dropna: bool = True, groups: DataFrame | None = None):
        self.df, self.spec = df, GroupSpec(keys, order_by, dropna, groups)
        self.spec.check(df)

    def _value(self, op: Reduction | Transform) -> Column | None:
        if op.column is None:
            return None
        if op.column not in self.df.columns:
            raise ValueError(f"{op.op}: no such column: {op.column}")
        kind = self.df.schema[op.column].dataType
        require(kind, op.needs, op.column, op.op)
        return normalize(op.column, kind)

    def agg(self, **reductions: Reduction) -> DataFrame:
        """A row per group: the keys and a column (or columns) for each named reduction.

        Raises ValueError where a result has the name of a key or of another result.
        """
        reductions = {name: r.typed(self.df.schema[r.column].dataType) if r.typed and r.column in self.df.columns else r for name, r in reductions.items()}
        values = {name: self._value(r) for name, r in reductions.items()}
        rows = self.df.where(self.spec.key_known) if self.spec.dropna else self.df
        helpers: dict[str, Column] = {}
        for name, r in reductions.items():
            if r.helpers:
                helpers |= r.helpers(values[name], self.spec)
        if helpers:
            _distinct([*self.df.columns, *helpers])
            rows = rows.select("*", *[c.alias(n) for n, c in helpers.items()])
        known = {n: F.col(n) for n in helpers}
        columns, empty = [], {}
        for name, r in reductions.items():
            for suffix, c in r.build(values[name], self.spec, known).items():
                columns.append(c.alias(name + suffix))
                empty[name + suffix] = r.empty
        _distinct([*self.spec.keys, *empty], len(self.spec.keys) + len(columns))
        out = rows.groupBy(*self.spec.keys).agg(*columns)
        return self._declared(out, empty) if self.spec.groups is not None else out

    def _declared(self, out: DataFrame, empty: dict[str, object]) -> DataFrame:
        """The declared groups, with each reduction's value for an empty group where there is none."""
        groups = self.spec.groups.select(*self.spec.keys).distinct()
        joined = groups.join(out.withColumn("__seen", F.lit(True)), list(self.spec.keys), "left")
        filled = [F.when(F.col("__seen"), F.col(c)).otherwise(F.lit(e)).cast(out.schema[c].dataType).alias(c) for c, e in empty.items()]
        return joined.select(*self.spec.keys, *filled)

    def transform(self, **transforms: Transform) -> DataFrame:
        """All rows and columns of df, and a column for each named transform.

        Raises ValueError where a transform has the name of a column. Forward transforms come before backward ones, so that equal window orders are sorted once.
        """
        _distinct([*self.df.columns, *transforms])
        made = sorted(transforms.items(), key=lambda item: item[1].backwards)
        columns = {name: self.spec.visible(t.build(self._value(t), self.spec)) for name, t in made}
        out = self.df.select("*", *[c.alias(n) for n, c in columns.items()])
        return out.select(*self.df.columns, *transforms)

    def size(self) -> DataFrame:
        from groupwise.functions.aggregates import size

        return self.agg(size=size())


def grouped(df: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str] = (), dropna: bool = True, groups: DataFrame | None = None) -> GroupedFrame:
    return GroupedFrame(df, keys, order_by, dropna, groups)
