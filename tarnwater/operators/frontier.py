"""The work queue: what to take next."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expressions import priority


def coverage(facts, by, name="covered"):
    """Rows per value; a value without rows is absent."""
    return facts.groupBy(by).agg(F.count("*").alias(name))


def ranked(players, facts, by, tag="discovery_hero_id", counts=None):
    """Pending players with the coverage and priority of their tag; ids break ties. counts: (by, covered), where
    the coverage is kept already and need not be counted."""
    counts = coverage(facts, by) if counts is None else counts.select(by, "covered")
    rows = players.join(counts.where(F.col(by).isNotNull()).withColumnRenamed(by, tag), tag, "left")
    return rows.withColumn("priority", priority(tag, F.col("covered")))


def top(players, facts, by, k, tag="discovery_hero_id", created="created_at", counts=None):
    """The k next entries, by a bounded heap in each task and one merge."""
    return ranked(players, facts, by, tag, counts).orderBy("priority", created, "uid").limit(k)


def stored_coverage(store):
    """(hero_id, covered) of a store: as kept, or counted where an older store lacks it."""
    return store.read("hero_coverage") if store.has("hero_coverage") else coverage(store.read("match_player_heroes"), "hero_id")


def assign(chosen, workers, created="created_at"):
    """Chosen entries dealt to workers in turn; no two hold the same one. chosen has k rows at most."""
    w = Window.orderBy("priority", created, "uid")
    return chosen.withColumn("slot", F.row_number().over(w) - 1).withColumn("worker", (F.col("slot") % workers).cast("int"))
