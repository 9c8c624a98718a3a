"""Seeding the queue from boards, in order of precedence."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..sources import payloads

#: Seconds after which a hero's board is read again.
REFRESH = 86400


def stale_sources(sources, cutoff, stamp="last_seeded_at"):
    """Sources never read or last read before the cutoff."""
    return sources.where(F.col(stamp).isNull() | (F.col(stamp) < cutoff))


def seeds(hero_entries, global_entries):
    """(uid, tag, nick_name): hero boards (hero_id, pos, uid, nick_name) come first and tag what they
    bring, the global board (pos, uid, nick_name) brings the rest untagged. The first mention of an
    id counts, with its name."""
    none = F.lit(None).cast("int")
    every = hero_entries.select("uid", "nick_name", F.col("hero_id").alias("tag"), F.struct(F.lit(0).alias("s"), F.col("hero_id").cast("long").alias("h"), F.col("pos").cast("long").alias("p")).alias("at")).unionByName(
        global_entries.select("uid", "nick_name", none.alias("tag"), F.struct(F.lit(1).alias("s"), F.lit(0).cast("long").alias("h"), F.col("pos").cast("long").alias("p")).alias("at"))
    )
    first = every.where("uid IS NOT NULL").groupBy("uid").agg(F.min_by(F.struct("tag", "nick_name"), "at").alias("s"))
    return first.select("uid", "s.tag", "s.nick_name")


def new_seeds(found, players):
    """Seeds that the store does not have yet."""
    return found.join(players.select("uid").distinct(), "uid", "left_anti")


def reseeded(players, heroes, hero_boards, global_board, now, refresh=REFRESH):
    """(new players, heroes with their stamps) from landed boards (hero_id, raw) and (raw).

    Only boards of heroes that were never read, or longer than `refresh` seconds ago, count. A hero
    whose board is missing or unreadable keeps its stamp, so it is tried again; so is a global board
    that can't be read. New players are pending, with the tag and name of their first mention.
    """
    due = stale_sources(heroes, now - refresh).select("hero_id")
    boards = payloads.readable_boards(hero_boards.join(due, "hero_id", "left_semi"))
    found = new_seeds(seeds(payloads.hero_board(boards), payloads.global_board(global_board)), players)
    new = found.select("uid", "nick_name", F.col("tag").alias("discovery_hero_id"), F.lit("pending").alias("crawl_status"), F.lit(now).cast("long").alias("created_at"))
    read = boards.select("hero_id").distinct().withColumn("_read", F.lit(True))
    stamps = heroes.join(read, "hero_id", "left").withColumn("last_seeded_at", F.when(F.col("_read"), F.lit(now).cast("long")).otherwise(F.col("last_seeded_at"))).drop("_read")
    return new, stamps


def reseed(store, hero_boards, global_board, now, refresh=REFRESH):
    """Put what the boards bring into the store, as one commit; returns how many players are new, counted as
    they are written."""
    players, heroes = store.read("players"), store.read("heroes")
    new, stamps = reseeded(players, heroes, hero_boards, global_board, now, refresh)
    told = Observation("seeded")
    with store.staged(new.observe(told, F.count("*").alias("n"))) as new:
        n = told.get["n"]
        store.commit({"players": players.unionByName(new, allowMissingColumns=True), "heroes": stamps})
    return n
