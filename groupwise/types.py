"""Column types: checks by operator, and widening for unsigned inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark types that hold the element types of NumPy-style arrays.
WIDENED = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "object": T.StringType(),
}


def widened(name: str) -> T.DataType:
    """The Spark type for an array element type; unsigned ones widen."""
    try:
        return WIDENED[name]
    except KeyError:
        raise TypeError(f"no Spark type for {name}") from None


def read_as(df: DataFrame, **names: str) -> DataFrame:
    """df with columns as the named array element types.

    A column of a signed type as wide as an unsigned one holds its bits, so negative values stand
    for the upper half of the unsigned range.
    """
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")

    def column(c: str, name: str) -> Column:
        kind, value = widened(name), F.col(c).cast(widened(name))
        if name.startswith("uint") and df.schema[c].dataType == WIDENED[name.removeprefix("u")]:
            value = F.when(value < 0, value + F.lit(str(1 << int(name.removeprefix("uint")))).cast(kind)).otherwise(value).cast(kind)
        return value

    return df.withColumns({c: column(c, name) for c, name in names.items()})


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def require(kind: T.DataType, what: str, column: str, op: str) -> None:
    """Raise TypeError unless a column's type suits an operator: numeric, boolean, orderable or any."""
    fits = {"numeric": is_numeric, "boolean": lambda t: isinstance(t, T.BooleanType), "orderable": is_orderable, "any": lambda t: True}[what](kind)
    if not fits:
        raise TypeError(f"{op}({column}): {kind.simpleString()} is not {what}")
