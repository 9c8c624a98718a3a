"""Column expressions of the crawl domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain: the lowest level of interest, the season offset of rank keys.
RANK_FLOOR, SEASON_OFFSET = 13, 1001000
UNTAGGED_PRIORITY = 999999999


def reaches_floor(level) -> Column:
    """Level known and high enough; an unknown one is not."""
    return F.coalesce(F.col(level) >= RANK_FLOOR, F.lit(False))


def below_floor(level) -> Column:
    """Level known and too low; an unknown one is not skipped."""
    return F.coalesce(F.col(level) < RANK_FLOOR, F.lit(False))


def history_visible(visibility) -> Column:
    """visibility: a map<string, boolean>; hidden unless it says otherwise."""
    return F.coalesce(F.try_element_at(visibility, F.lit("match_history")), F.lit(False))


def priority(tag, coverage) -> Column:
    """Least covered tags first, untagged entries last."""
    return F.when(F.col(tag).isNull(), UNTAGGED_PRIORITY).otherwise(F.coalesce(coverage, F.lit(0)))


#: The rank as it stands in its text.
RANK = "rank_game STRUCT<level: DOUBLE, rank_score: DOUBLE>"


def rank_text(info, season) -> Column:
    """The text of the rank of a season in a profile's parsed map<string, string>; null where there is none."""
    return F.try_element_at(info, F.concat(F.lit("rank_game_"), (F.lit(SEASON_OFFSET) + season).cast("string")))


def rank_blob(raw, season) -> Column:
    """struct(level, score) from the profile's doubly encoded rank of a season; null where it is
    missing or cannot be parsed."""
    info = F.from_json(raw, "player STRUCT<info: MAP<STRING, STRING>>")["player"]["info"]
    rank = F.from_json(rank_text(info, season), RANK)["rank_game"]
    return F.when(rank.isNotNull(), F.struct(rank["level"].cast("int").alias("level"), rank["rank_score"].alias("score")))


def response_class(status, failed) -> Column:
    """ok, missing, limited or failed. Every status that is none of the special ones is a success."""
    return (
        F.when(failed, "failed")
        .when(F.col(status) == 404, "missing")
        .when(F.col(status).isin(429, 403), "limited")
        .when(F.col(status) >= 500, "failed")
        .otherwise("ok")
    )


def eta(pending, per_minute):
    """(unit, amount) of the time until the queue is empty; the caller formats the amount."""
    minutes = pending / per_minute
    unit = F.when(pending == 0, "empty").when(per_minute <= 0, "unknown").when(minutes < 60, "minutes").when(minutes < 48 * 60, "hours").otherwise("days")
    amount = F.when((pending > 0) & (per_minute > 0), F.when(minutes < 60, minutes).when(minutes < 48 * 60, minutes / 60).otherwise(minutes / 1440))
    return unit, amount


def eta_text(unit, amount):
    """The one formatted value, on the driver; its formats are fixed."""
    return {"empty": "queue empty", "unknown": "unknown (no recent throughput)"}.get(unit) or {"minutes": f"~{amount:.0f}m", "hours": f"~{amount:.1f}h", "days": f"~{amount:.1f}d"}[unit]


def whole(column) -> Column:
    """A payload number as INT, as truncation does it; null where it is none."""
    return F.col(column).cast("int") if isinstance(column, str) else column.cast("int")
