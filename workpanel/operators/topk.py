"""Top-1 per key as an aggregate.

``row_number() == 1`` over ``partitionBy(key)`` sorts each key's whole group
in one task; a key holding a third of the rows would then sit in one task.
``min_by(payload, sort_key)`` (or ``max_by`` with a shorter key, see
``order_key``) is an ordinary grouped aggregate instead: it is combined
map-side before the shuffle, so each key ships at most one row per map
partition, and the order (with its tie-breaker) is total, so the answer is
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One ordering term: (column, "asc" | "desc", "first" | "last" for nulls).
OrderTerm = tuple[str, str, str]


def _descending(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return -F.unix_date(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(dtype, T.NumericType):
        return -c
    raise TypeError(f"descending order is supported for dates and numbers, not {dtype}")


def sort_key(df: DataFrame, order: list[OrderTerm]) -> Column:
    """A struct whose ascending order is ``order``; its minimum is the first row."""
    fields = []
    for i, (name, direction, nulls) in enumerate(order):
        c, f = F.col(name), df.schema[name]
        if f.nullable:  # a column that cannot be null needs no null rank
            fields.append((c.isNotNull() if nulls == "first" else c.isNull()).alias(f"n{i}"))
        fields.append((c if direction == "asc" else _descending(c, f.dataType)).alias(f"v{i}"))
    return F.struct(*fields)


def _max_form(df: DataFrame, order: list[OrderTerm]) -> Column | None:
    """A shorter key for ``max_by`` when every term puts nulls last and is
    descending, or ascending on a number / date (negated): nulls compare
    lowest, so no null-rank fields are needed."""
    fields = []
    for i, (name, direction, nulls) in enumerate(order):
        if nulls != "last":
            return None
        dtype = df.schema[name].dataType
        if direction == "desc":
            fields.append(F.col(name).alias(f"v{i}"))
        elif isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            fields.append(_descending(F.col(name), dtype).alias(f"v{i}"))
        else:
            return None
    return F.struct(*fields)


def order_key(df: DataFrame, order: list[OrderTerm]):
    """``(min_by | max_by, key)`` whose pick is the first row in ``order``."""
    k = _max_form(df, order)
    return (F.max_by, k) if k is not None else (F.min_by, sort_key(df, order))


def first_by(df: DataFrame, key: str | list[str], order: list[OrderTerm],
             cols: list[str]) -> DataFrame:
    """One row per ``key``: the ``cols`` of the first row in ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    pick, k = order_key(df, order)
    top = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in cols]), k).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in cols])
