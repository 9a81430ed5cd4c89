"""Positional gather: rows by position, columns by position, array elements by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of the sample for each range, and at least in all.
SAMPLE_ROWS, LEAST_SAMPLE = 20, 4096


def _range_bounds(df: DataFrame, cols: list[str], parts: int) -> list[list]:
    """Values that cut the rows into about `parts` even ranges, from a sample that grows with the parts alone."""
    sample = df.select(*cols).orderBy(F.xxhash64(*cols)).limit(max(LEAST_SAMPLE, SAMPLE_ROWS * parts)).orderBy(*cols).collect()
    return [list(sample[len(sample) * k // parts]) for k in range(1, parts)] if len(sample) >= parts else [list(r) for r in sample[1:]]


def _range_of(df: DataFrame, cols: list[str], bounds: list[list]) -> Column:
    """The number of bounds that a row has reached, in two steps of about the root of their number each."""
    if not bounds:
        return F.lit(0)
    own = F.struct(*cols)
    literals = [F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(cols, values, strict=True)]) for values in bounds]
    step = max(1, round(len(literals) ** 0.5))
    reached = lambda some: F.size(F.filter(some, lambda b: b <= own))
    heads = reached(F.array(*literals[::step]))
    chunks = F.array(*[F.array(*literals[k : k + step]) for k in range(0, len(literals), step)])
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + reached(F.get(chunks, heads - 1)))


def _unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column."""
    out, taken = [], {c.lower() for c in df.columns}
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_positions(df: DataFrame, order_by: str | Sequence[str], name: str = "pos") -> DataFrame:
    """df with dense positions from 0 in a total order.

    Rows are numbered within ranges of the order, as many as there are shuffle partitions, and
    shifted by the counts of the earlier ranges, so no task sorts more than a range. The bounds are
    literals, so the range of a row is the same wherever it is computed; what is broadcast is one
    row per range. A column that is called `name` already raises ValueError.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already")
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    part, n, base, row = _unused(df, "__part", "__n", "__base", "__row")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(part, _range_of(df, cols, _range_bounds(df, cols, parts)))
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = F.broadcast(counts.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(base)))  # a row per range
    numbered = ranged.withColumn(row, F.row_number().over(Window.partitionBy(part).orderBy(*cols))).join(bases, part)
    return numbered.withColumn(name, F.col(base) + F.col(row) - 1).select(*df.columns, name)


def take(source: DataFrame, index: DataFrame, position: str = "pos", index_col: str = "ix", fill: object = None, missing: str = "null") -> DataFrame:
    """Each row of index with the columns of source at its position.

    -1 gives `fill` in every source column (NULL by default); NULL values of source survive as
    they are. A position that source does not have gives NULL, or an error with missing="raise".
    """
    if missing not in ("null", "raise"):
        raise ValueError("missing is null or raise")
    values = [c for c in source.columns if c != position]
    clash = set(values) & set(index.columns)
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    found = source.withColumnRenamed(position, "__pos").withColumn("__found", F.lit(True))
    joined = index.join(found, index[index_col] == found["__pos"], "left")

    def value(c: str) -> Column:
        there = F.col(c)
        if missing == "raise":
            there = F.when(F.col("__found").isNull() & F.col(index_col).isNotNull(), F.raise_error(F.concat(F.lit("no row at position "), F.col(index_col).cast("string"))).cast(source.schema[c].dataType)).otherwise(there)
        return F.when(F.col(index_col) == -1, F.lit(fill).cast(source.schema[c].dataType)).otherwise(there).alias(c)

    return joined.select(*index.columns, *map(value, values))


def take_columns(df: DataFrame, positions: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Columns of df (those not in keep) by position, repeats and any order allowed; named c0, c1, ..."""
    columns = [c for c in df.columns if c not in keep]
    if any(not 0 <= p < len(columns) for p in positions):
        raise IndexError(f"positions lie from 0 to {len(columns) - 1}")
    return df.select(*keep, *[F.col(columns[p]).alias(f"c{k}") for k, p in enumerate(positions)])


def take_elements(array: str | Column, positions: Sequence[int]) -> Column:
    """Elements of an array column by position as a new array; NULL where there is none."""
    a = F.col(array) if isinstance(array, str) else array
    return F.when(a.isNotNull(), F.array(*[F.get(a, F.lit(p)) for p in positions]))
