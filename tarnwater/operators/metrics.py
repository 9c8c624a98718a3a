"""Progress figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import eta, eta_text
from .frontier import coverage, stored_coverage


def status_counts(players, status="crawl_status"):
    return players.groupBy(status).agg(F.count("*").alias("n"))


def spread(counts, column="covered"):
    """(low, upper median, high) of counts, 0 where there are none. The frequencies of the counts
    are what is ordered, so it holds for any number of keys."""
    from pyspark.sql import Window

    freq = counts.groupBy(column).agg(F.count("*").alias("f"))
    upto = F.sum("f").over(Window.orderBy(column))  # one row per different count
    total = F.sum("f").over(Window.partitionBy())
    rows = freq.withColumns({"upto": upto, "total": total})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.agg(zero(F.min(column)).alias("low"), zero(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(column)))).alias("median"), zero(F.max(column)).alias("high"))


def recent(players, now, window=600, stamp="last_crawled_at"):
    """(n, per_minute) of entries stamped within the window, whatever their status."""
    n = F.count_if(F.coalesce(F.col(stamp) >= now - window, F.lit(False)))
    return players.agg(n.alias("n"), (n / F.lit(window / 60.0)).alias("per_minute"))


def drained(players, status="crawl_status"):
    """Whether nothing is left to do; stops at the first open entry."""
    return players.where(F.col(status).isin("pending", "claimed")).limit(1).agg((F.count("*") == 0).alias("drained"))


def progress(store, now, window=600):
    """The progress line of a store."""
    return progress_line(store.read("players"), store.read("matches"), None, now, window, stored_coverage(store))


def progress_line(players, matches, segments, now, window=600, counts=None):
    """The one line that operators read; its format is fixed. counts: (hero_id, covered), where it is kept already."""
    statuses = sorted((r[0], r[1]) for r in status_counts(players).collect())
    low, median, high = spread(coverage(segments, "hero_id") if counts is None else counts).first()
    row = recent(players, now, window).crossJoin(players.agg(F.count_if(F.col("crawl_status") == "pending").alias("pending")))  # one row each
    unit, amount = eta(F.col("pending"), F.col("per_minute"))
    r = row.select("per_minute", unit.alias("unit"), amount.alias("amount")).first()
    parts = [f"matches={matches.count()}", *(f"{s}={n}" for s, n in statuses), f"hero_coverage(min/median/max)={low}/{median}/{high}", f"rate={r.per_minute:.1f}/min", f"eta_to_drain_queue={eta_text(r.unit, r.amount)}"]
    return " ".join(parts)
