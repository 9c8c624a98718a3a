"""Nested matches into flat rows, whole or not at all."""

from __future__ import annotations

from pyspark.sql import functions as F

INT = lambda path: F.col(path).cast("int")


def admissible():
    """Whether a parsed match (match, readable) can enter: it has a key, every player an id, every segment
    a hero and every ban its four numbers."""
    players = F.coalesce("match.match_players", F.array())
    bans = F.coalesce("match.dynamic_fields.ban_pick_info", F.array())
    ban_ok = F.forall(bans, lambda b: b["hero_id"].isNotNull() & b["round_idx"].isNotNull() & b["battle_side"].isNotNull() & b["is_pick"].isNotNull())
    player_ok = F.forall(players, lambda p: p["player_uid"].isNotNull() & F.forall(F.coalesce(p["player_heroes"], F.array()), lambda h: h["hero_id"].isNotNull()))
    return F.coalesce(F.col("readable") & F.col("match.match_uid").isNotNull() & ban_ok & player_ok, F.lit(False))


def admitted(parsed):
    """(admitted, rejected): a match enters with all its rows or none. Each of the two reads `parsed` anew."""
    flagged = parsed.withColumn("admitted", admissible())
    return flagged.where("admitted").drop("admitted"), flagged.where("NOT admitted").drop("admitted")


def admission_counts(parsed):
    """(admitted, rejected) as numbers of matches, one row; each match is parsed and judged once for both."""
    flagged = parsed.select(admissible().alias("admitted"))
    return flagged.agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))


def winner_side():
    """Camp of the first player who won, else null."""
    return F.get(F.filter("match.match_players", lambda p: F.coalesce(p["is_win"], F.lit(0.0)) != 0), 0)["camp"].cast("int")


def _with_seq(rows):
    """What tells the order of the documents stays beside their rows."""
    return [c for c in ("seq", "doc") if c in rows.columns]


def match_rows(rows, season, now, map_id=None):
    m = lambda c: F.col(f"match.{c}")
    return rows.select(
        *_with_seq(rows), m("match_uid"), m("match_time_stamp"), m("match_play_duration"), INT("match.game_mode_id").alias("game_mode_id"),
        (F.lit(None) if map_id is None else F.col(map_id)).cast("int").alias("map_id"), F.lit(season).cast("int").alias("season"), winner_side().alias("winner_side"),
        m("mvp_uid"), INT("match.mvp_hero_id").alias("mvp_hero_id"), m("svp_uid"), INT("match.svp_hero_id").alias("svp_hero_id"),
        F.expr("try_cast(match.replay_id AS BIGINT)").alias("replay_id"), F.lit(now).cast("long").alias("fetched_at"),
    )


def ban_rows(rows):
    bans = rows.select(*_with_seq(rows), "match.match_uid", F.posexplode("match.dynamic_fields.ban_pick_info").alias("pos", "b"))
    return bans.select(*_with_seq(rows), "pos", "match_uid", *(INT(f"b.{c}").alias(c) for c in ("round_idx", "battle_side", "hero_id", "is_pick")))


def player_rows(rows):
    players = rows.select(*_with_seq(rows), "match.match_uid", F.posexplode("match.match_players").alias("pos", "p"))
    ints, doubles = ("camp", "cur_hero_id", "k", "d", "a"), ("total_hero_damage", "total_hero_heal", "total_damage_taken")
    return players.select(
        *_with_seq(rows), "pos", "match_uid", "p.player_uid", *(INT(f"p.{c}").alias(c) for c in ints), *(F.col(f"p.{c}") for c in doubles), INT("p.is_win").alias("is_win"),
        "p.dynamic_fields.add_score", "p.dynamic_fields.new_score", INT("p.dynamic_fields.level").alias("level"), INT("p.dynamic_fields.new_level").alias("new_level"), "p.session_hit_rate",
    )


def segment_rows(rows):
    """Hero segments of each player of each match."""
    players = rows.select(*_with_seq(rows), "match.match_uid", F.posexplode("match.match_players").alias("at", "p"))
    parts = players.select(*_with_seq(rows), "at", "match_uid", "p.player_uid", F.posexplode("p.player_heroes").alias("pos", "h"))
    place = (F.col("at").cast("long") * (1 << 31) + F.col("pos")).alias("pos")
    return parts.select(*_with_seq(rows), place, "match_uid", "player_uid", *(INT(f"h.{c}").alias(c) for c in ("hero_id", "k", "d", "a")), "h.play_time")


def heroes_seen(rows):
    """Distinct heroes of bans, segments and current picks."""
    ids = lambda path, field: F.transform(F.coalesce(path, F.array()), lambda x: x[field].cast("int"))
    players = F.coalesce("match.match_players", F.array())
    every = F.array_union(
        ids(F.col("match.dynamic_fields.ban_pick_info"), "hero_id"),
        F.array_union(ids(players, "cur_hero_id"), F.flatten(F.transform(players, lambda p: F.transform(F.coalesce(p["player_heroes"], F.array()), lambda h: h["hero_id"].cast("int"))))),
    )
    return rows.select(F.explode(every).alias("hero_id")).where("hero_id IS NOT NULL").distinct()


def shred(rows, season, now, map_id=None):
    """name -> rows of every table that admitted matches yield, with seq (if there is one) and their
    place `pos` in the document. Equal keys are left to the upsert."""
    return {"matches": match_rows(rows, season, now, map_id), "match_bans": ban_rows(rows), "match_players": player_rows(rows), "match_player_heroes": segment_rows(rows), "heroes": heroes_seen(rows).withColumn("first_seen_at", F.lit(now).cast("long"))}
