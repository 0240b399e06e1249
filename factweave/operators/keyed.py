"""Joins against small tables of keys, as of predicates, fields or documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of keys that is broadcast, and values named in a filter, at most.
FEW, NAMED = 10_000, 1_000


def few(keys: DataFrame, most: int = FEW) -> DataFrame:
    """``keys``, to be broadcast if it has at most ``most`` rows, which is looked up
    here and now; such a table isn't worked out again.

    A join by a few keys that is no broadcast deals the other side by them: one
    task for all facts of a predicate. A longer table is left as it is."""
    rows = keys.limit(most + 1).toArrow()  # at most ``most`` + 1
    if rows.num_rows > most:
        return keys
    return F.broadcast(keys.sparkSession.createDataFrame(rows, keys.schema))


def named(df: DataFrame, column: str, keys: DataFrame, most: int = NAMED) -> DataFrame:
    """``df`` without rows that can't meet ``keys`` on ``column``, if ``keys`` has at
    most ``most`` values there; else as it is. The join is still to be made."""
    values = [r[0] for r in keys.select(column).distinct().limit(most + 1).collect()]  # at most ``most`` + 1
    return df if len(values) > most else df.where(F.col(column).isin([v for v in values if v is not None]))
