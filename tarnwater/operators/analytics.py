"""Datasets for analysis."""

from __future__ import annotations

from pyspark.sql import functions as F


def before_score(rows):
    """rows with the score that a player brought into the match."""
    return rows.withColumn("pre_score", F.col("new_score") - F.col("add_score"))


def exploded(matches, players, bans):
    """One row per match, player and ban (twelve times six for a full match)."""
    return before_score(players.join(matches, "match_uid").join(bans, "match_uid"))


def nested(matches, players, bans):
    """One row per match and player, the bans as an ordered array: no fan-out."""
    lists = bans.groupBy("match_uid").agg(F.sort_array(F.collect_list(F.struct("round_idx", "battle_side", "hero_id", "is_pick"))).alias("bans"))
    return before_score(players.join(matches, "match_uid").join(lists, "match_uid", "left"))
