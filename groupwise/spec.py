"""What a grouped operator needs to know: keys, row order, null keys, declared groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GroupSpec:
    """keys: grouping columns. order_by: columns giving a total order of rows, for operators that
    depend on it. dropna: rows with a null key belong to no group. groups: a DataFrame with the key
    columns that declares the groups of the result, also those without rows.
    """

    keys: Sequence[str]
    order_by: Sequence[str] = ()
    dropna: bool = True
    groups: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self):
        for name in ("keys", "order_by"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value))
        if not self.keys:
            raise ValueError("at least one key is needed")

    def check(self, df: DataFrame) -> None:
        missing = [c for c in (*self.keys, *self.order_by) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")

    def need_order(self, op: str) -> tuple[str, ...]:
        if not self.order_by:
            raise ValueError(f"{op} depends on row order: order_by is needed")
        return self.order_by

    @property
    def key_known(self) -> Column:
        return reduce(Column.__and__, [F.col(k).isNotNull() for k in self.keys])

    def order_value(self, op: str) -> Column:
        cols = self.need_order(op)
        return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)

    def group(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def ordered(self, op: str, backwards: bool = False) -> WindowSpec:
        cols = self.need_order(op)
        return self.group().orderBy(*[F.col(c).desc() if backwards else F.col(c).asc() for c in cols])

    def running(self, op: str, backwards: bool = False) -> WindowSpec:
        return self.ordered(op, backwards).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def visible(self, result: Column) -> Column:
        """A row's result, null for rows of no group."""
        return F.when(self.key_known, result) if self.dropna else result
