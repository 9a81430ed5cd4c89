"""Missing values: after normalisation NULL is the only one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.types import is_floating


def normalize(column: str | Column, kind: T.DataType) -> Column:
    """NaN of floating columns becomes NULL; anything else is left as it is (0 is data)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c) if is_floating(kind) else c


def missing(v: Column) -> Column:
    """How many values of a group are missing."""
    return F.count_if(v.isNull())
