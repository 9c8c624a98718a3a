"""Current state from an append-only log of partial writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def fold(log, key, last=(), first=(), seq="seq", written="set_cols"):
    """One row per key. Each log row writes the columns named in its array `written`; of the
    `last` columns the latest write stays, null included, of the `first` ones the earliest. seq (of
    any type that has an order) is a total order within a key. One aggregation, combined before the shuffle."""
    at = lambda f, c: F.expr(f"{f}({c}, {seq}) FILTER (WHERE array_contains({written}, '{c}'))").alias(c)
    return log.groupBy(*key).agg(*(at("max_by", c) for c in last), *(at("min_by", c) for c in first))


def writes(rows, columns, seq):
    """Log rows that write the given columns."""
    return rows.withColumns({"set_cols": F.array(*map(F.lit, columns)), "seq": seq})


def latest(rows, key, order):
    """The row that comes last in `order` (sort expressions, last first), for each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def earliest_value(rows, key, value, seq):
    """First written value of each key; a null first value stays."""
    return rows.groupBy(*key).agg(F.min_by(value, seq).alias(value))
