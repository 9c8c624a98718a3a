"""Schemas of the tables and of the payloads they are shredded from.

Fixed values: names, types and keys of the data model. Numbers that payloads write as floats are
read as DOUBLE and cast, as an INT field would silently become null.
"""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = {
    "players": "uid BIGINT, nick_name STRING, discovery_hero_id INT, latest_known_score DOUBLE, latest_known_level INT, visibility_json STRING, crawl_status STRING, last_crawled_at BIGINT, claimed_at BIGINT, created_at BIGINT",
    "heroes": "hero_id INT, first_seen_at BIGINT, last_seeded_at BIGINT",
    "matches": "match_uid STRING, match_time_stamp BIGINT, match_play_duration DOUBLE, game_mode_id INT, map_id INT, season INT, winner_side INT, mvp_uid BIGINT, mvp_hero_id INT, svp_uid BIGINT, svp_hero_id INT, replay_id BIGINT, fetched_at BIGINT",
    "match_bans": "match_uid STRING, round_idx INT, battle_side INT, hero_id INT, is_pick INT",
    "match_players": "match_uid STRING, player_uid BIGINT, camp INT, cur_hero_id INT, k INT, d INT, a INT, total_hero_damage DOUBLE, total_hero_heal DOUBLE, total_damage_taken DOUBLE, is_win INT, add_score DOUBLE, new_score DOUBLE, level INT, new_level INT, session_hit_rate DOUBLE",
    "match_player_heroes": "match_uid STRING, player_uid BIGINT, hero_id INT, k INT, d INT, a INT, play_time DOUBLE",
    "hero_coverage": "hero_id INT, covered BIGINT",
}
KEYS = {
    "players": ["uid"],
    "heroes": ["hero_id"],
    "matches": ["match_uid"],
    "match_bans": ["match_uid", "round_idx", "battle_side", "hero_id"],
    "match_players": ["match_uid", "player_uid"],
    "match_player_heroes": ["match_uid", "player_uid", "hero_id"],
    "hero_coverage": ["hero_id"],
}
#: The column by whose hash a table is cut into parts: what belongs to one match lies in one part of each table.
PARTED = {name: key[0] for name, key in KEYS.items()}
#: Columns whose first value stays; all others take the latest, null included.
FIRST_WINS = {"players": ["discovery_hero_id", "created_at"], "heroes": ["first_seen_at"]}

MATCH = (
    "match_uid STRING, match_time_stamp BIGINT, match_play_duration DOUBLE, game_mode_id DOUBLE, mvp_uid BIGINT, mvp_hero_id DOUBLE, svp_uid BIGINT, svp_hero_id DOUBLE, replay_id STRING, "
    "dynamic_fields STRUCT<ban_pick_info: ARRAY<STRUCT<battle_side: DOUBLE, hero_id: DOUBLE, round_idx: DOUBLE, is_pick: DOUBLE>>>, "
    "match_players ARRAY<STRUCT<player_uid: BIGINT, nick_name: STRING, camp: DOUBLE, cur_hero_id: DOUBLE, is_win: DOUBLE, k: DOUBLE, d: DOUBLE, a: DOUBLE, total_hero_damage: DOUBLE, total_hero_heal: DOUBLE, total_damage_taken: DOUBLE, session_hit_rate: DOUBLE, "
    "dynamic_fields: STRUCT<add_score: DOUBLE, level: DOUBLE, new_level: DOUBLE, new_score: DOUBLE>, player_heroes: ARRAY<STRUCT<hero_id: DOUBLE, k: DOUBLE, d: DOUBLE, a: DOUBLE, play_time: DOUBLE>>>>"
)
HISTORY_PAGE = "ARRAY<STRUCT<match_uid: STRING, match_map_id: DOUBLE, match_season: STRING, match_time_stamp: BIGINT, game_mode_id: DOUBLE>>"
PROFILE = "player STRUCT<info: MAP<STRING, STRING>>, visibility MAP<STRING, STRING>"
HERO_BOARD = "players ARRAY<STRUCT<player_uid: BIGINT, info: STRUCT<name: STRING>>>"
GLOBAL_BOARD = "players ARRAY<STRUCT<name: STRING, uid: STRING, rank: STRUCT<rank_game_id: INT>>>"


def schema(name):
    return T.StructType.fromDDL(TABLES[name])


def empty(spark, name):
    """The table before anything is written to it."""
    return spark.createDataFrame([], schema(name))


def conform(df, name):
    """df under the newest schema of a table: columns it lacks are null, others go."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
