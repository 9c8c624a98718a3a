"""Reports on what should hold."""

from __future__ import annotations

from pyspark.sql import functions as F


def group_sizes(children, key, expected=12):
    """Keys whose number of rows is not the expected one."""
    return children.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def winner_conflicts(matches, players):
    """Matches whose winners are not all of one side, or of another than the match says."""
    sides = players.where("is_win <> 0").groupBy("match_uid").agg(F.min("camp").alias("low"), F.max("camp").alias("high"))
    rows = matches.join(sides, "match_uid", "left")
    one = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    return rows.where(~one | ~F.col("winner_side").eqNullSafe(F.col("low"))).select("match_uid", "winner_side", "low", "high")


def orphans(children, parents, key):
    """Rows without a parent."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def duplicates(rows, key):
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def attrition(responses, status="http_status"):
    """(missing, n): fetches that found nothing, which is normal, among all."""
    return responses.agg(F.count_if(F.col(status) == 404).alias("missing"), F.count("*").alias("n"))
