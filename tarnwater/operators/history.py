"""Incremental scans of paged, newest-first histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def chain(pages, full=20):
    """Of pages (uid, skip, kind, page_size), one for each skip, those that a reader comes to: 0, `full`, 2 * `full`
    and so on without a gap, up to the first that is not ok or not full. Empty pages are pages too, so
    this comes before pages are exploded into entries."""
    order = Window.partitionBy("uid").orderBy("skip")
    rows = pages.withColumn("_here", F.col("skip") == (F.row_number().over(order) - 1) * full)
    stops = ~F.col("_here") | (F.col("kind") != "ok") | (F.col("page_size") < full)
    before = F.max(stops).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_ended", F.coalesce(before, F.lit(False))).where("_here AND NOT _ended").drop("_here", "_ended")


def page_troubles(reached, wanted, full=20, absent="failed"):
    """(uid, skip, pos, kind) of the histories of `wanted` (uid) whose chain of pages isn't whole: where it breaks,
    and whether the page has failed, was limited or was never landed (`absent`). pos is -1, as a page comes before its entries."""
    last = reached.groupBy("uid").agg(F.max("skip").alias("skip"), F.max_by("kind", "skip").alias("kind"), F.max_by("page_size", "skip").alias("n"))
    rows = wanted.select("uid").distinct().join(last, "uid", "left")
    at = F.when(F.col("kind") == "ok", F.col("skip") + full).otherwise(F.coalesce("skip", F.lit(0)))
    broken = F.col("kind").isNull() | (F.col("kind") != "ok") | (F.col("n") >= full)
    return rows.where(broken).select("uid", at.cast("int").alias("skip"), F.lit(-1).alias("pos"), F.when(F.col("kind") == "limited", "limited").when(F.col("kind").isNull() | (F.col("kind") == "ok"), absent).otherwise("failed").alias("kind"))


def unknown(entries, known, key="match_uid"):
    """Entries whose key is not in the store."""
    return entries.join(known.select(key).distinct(), key, "left_anti")


def marked(entries, known, visited):
    """Entries with what a scan needs to know: is_known (in the store, or met before in the same history), revisit,
    and met (whether a known one has come by then). visited: (uid, last_crawled_at)."""
    rows = entries.join(known.select("match_uid").distinct().withColumn("_stored", F.lit(True)), "match_uid", "left")
    rows = rows.join(visited.select("uid", F.col("last_crawled_at").isNotNull().alias("revisit")), "uid", "left")
    again = F.row_number().over(Window.partitionBy("uid", "match_uid").orderBy("skip", "pos")) > 1
    rows = rows.withColumns({"is_known": F.coalesce("_stored", F.lit(False)) | again, "revisit": F.coalesce("revisit", F.lit(False))})
    upto = Window.partitionBy("uid").orderBy("skip", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("met", F.max("is_known").over(upto)).drop("_stored")


#: Of marked entries, those to fetch.
FETCHED = "NOT is_known AND NOT (revisit AND met)"


def scan(entries, known, visited):
    """Entries to fetch. A first visit takes every unknown one; a revisit those before the first
    known one. An entry met for the second time counts as known. visited: (uid, last_crawled_at)."""
    return marked(entries, known, visited).where(FETCHED).drop("is_known", "revisit", "met")


def troubles(found, reached, wanted, answers, full=20, absent="failed"):
    """(uid, skip, pos, kind): what keeps a visit from being whole, the first in the order of its reading: a page
    that has failed, was limited or was never landed (`absent`), or an entry to fetch whose detail has no final answer.
    found: marked entries; answers: (match_uid, kind). A revisit reads no page behind a known entry."""
    stops = found.where("revisit AND is_known").groupBy("uid").agg(F.min(F.struct("skip", "pos")).alias("stop"))
    pages = page_troubles(reached, wanted, full, absent).join(stops, "uid", "left")
    pages = pages.where(F.col("stop").isNull() | (F.struct("skip", "pos") < F.col("stop"))).drop("stop")
    kind = F.coalesce("kind", F.lit(absent))
    details = found.where(FETCHED).select("uid", "skip", "pos", "match_uid").join(answers.select("match_uid", "kind"), "match_uid", "left").where(kind.isin("failed", "limited", absent))
    every = pages.unionByName(details.select("uid", "skip", "pos", kind.alias("kind")))
    first = every.groupBy("uid").agg(F.min(F.struct(F.col("skip").cast("long").alias("skip"), F.col("pos").cast("long").alias("pos"), "kind")).alias("t"))
    return first.select("uid", "t.*")


def work_list(entries):
    """One fetch per match, though several histories may name it: the first by (uid, skip, pos)."""
    first = entries.groupBy("match_uid").agg(F.min_by(F.struct(*[c for c in entries.columns if c != "match_uid"]), F.struct("uid", "skip", "pos")).alias("e"))
    return first.select("match_uid", "e.*")


def with_details(entries, details):
    """Entries beside their details (null where these are gone); details are unique by match_uid."""
    return entries.join(details, "match_uid", "left")
