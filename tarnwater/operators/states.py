"""Transitions of the crawl state, as projections of a snapshot (uid, crawl_status, last_crawled_at, claimed_at).

Statuses: pending, claimed, done, error, skipped_floor, skipped_private, not_indexed. `now` and the
windows are parameters; a null stamp never expires, as a comparison with it is null.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import below_floor

#: Seconds after which finished, failed and claimed entries return to the queue.
REVISIT, RETRY, ORPHAN = 43200, 3600, 3600


def _put(rows, when, status, last="last_crawled_at", claimed="claimed_at"):
    pick = lambda then, c: F.when(when, then).otherwise(F.col(c)).alias(c)
    changed = {"crawl_status": F.lit(status), "last_crawled_at": F.col(last) if isinstance(last, str) else last, "claimed_at": F.col(claimed) if isinstance(claimed, str) else claimed}
    return rows.select(*(pick(changed[c], c) if c in changed else F.col(c) for c in rows.columns))


def nothing():
    return F.lit(None).cast("long")


def claim(rows, chosen, now):
    """Chosen ids (uid) that are still pending become claimed."""
    marked = rows.join(chosen.select("uid").distinct().withColumn("_chosen", F.lit(True)), "uid", "left")
    return _put(marked, F.coalesce("_chosen", F.lit(False)) & (F.col("crawl_status") == "pending"), "claimed", claimed=F.lit(now).cast("long")).drop("_chosen").select(rows.columns)


def release(rows, condition=None):
    """Claimed entries (that meet the condition) are pending again; when they were last done stays."""
    held = F.col("crawl_status") == "claimed"
    return _put(rows, held if condition is None else held & condition, "pending", claimed=nothing())


def put_back(rows, visits):
    """Claimed entries of visits (uid, read) that were put back are pending again. Where the visit had come to
    the history (read), the stamp of the last one goes: the next visit reads all of it."""
    marked = rows.join(visits.groupBy("uid").agg(F.max("read").alias("_read")), "uid", "left")
    held = F.col("_read").isNotNull() & (F.col("crawl_status") == "claimed")
    last = F.when(F.col("_read"), nothing()).otherwise(F.col("last_crawled_at"))
    return _put(marked, held, "pending", last=last, claimed=nothing()).drop("_read").select(rows.columns)


def reopened(rows, visits):
    """Claimed entries whose visits (uid) go on lose the stamp of the last one, so that they read the whole history."""
    marked = rows.join(visits.select("uid").distinct().withColumn("_open", F.lit(True)), "uid", "left")
    return _put(marked, F.coalesce("_open", F.lit(False)) & (F.col("crawl_status") == "claimed"), "claimed", last=nothing()).drop("_open").select(rows.columns)


def finish(rows, outcomes, now, order=None):
    """outcomes (uid, outcome): the terminal status of each, stamped with now. Of several outcomes of
    one uid the last in `order` (a column) counts, without it the greatest by name."""
    last = F.max("outcome") if order is None else F.max_by("outcome", F.struct(order, "outcome"))
    marked = rows.join(outcomes.where("outcome IS NOT NULL").groupBy("uid").agg(last.alias("outcome")), "uid", "left")
    over = F.col("outcome").isNotNull()
    return marked.select(*[
        F.when(over, F.col("outcome")).otherwise(F.col(c)).alias(c) if c == "crawl_status"
        else F.when(over, F.lit(now).cast("long")).otherwise(F.col(c)).alias(c) if c == "last_crawled_at"
        else F.when(over, nothing()).otherwise(F.col(c)).alias(c) if c == "claimed_at"
        else F.col(c)
        for c in rows.columns
    ])


def stale(now, revisit=REVISIT, retry=RETRY, orphan=ORPHAN):
    """name -> condition of the three ways back into the queue."""
    status = F.col("crawl_status")
    old = lambda c, seconds: F.coalesce(F.col(c) < now - seconds, F.lit(False))
    return {"done": (status == "done") & old("last_crawled_at", revisit), "error": (status == "error") & old("last_crawled_at", retry), "claimed": (status == "claimed") & old("claimed_at", orphan)}


def requeue(rows, now, **windows):
    """Finished entries keep their stamp, failed and orphaned ones lose it, so they are crawled as new."""
    c = stale(now, **windows)
    out = lambda column, lost: F.when(lost, nothing()).otherwise(F.col(column)).alias(column)
    back = c["done"] | c["error"] | c["claimed"]
    changed = {"crawl_status": F.when(back, "pending").otherwise(F.col("crawl_status")).alias("crawl_status"), "last_crawled_at": out("last_crawled_at", c["error"] | c["claimed"]), "claimed_at": out("claimed_at", c["claimed"])}
    return rows.select(*(changed.get(x, F.col(x)) for x in rows.columns))


def stale_counts(now, **windows):
    """Columns that count the entries of each kind that return, for agg() or observe()."""
    return [F.count_if(cond).alias(f"n_{name}") for name, cond in stale(now, **windows).items()]


def requeue_counts(rows, now, **windows):
    """How many entries of each kind would return, in one pass."""
    return rows.agg(*stale_counts(now, **windows))


def classify(rows):
    """The outcome of each visit (uid, known_level, http_status, visible, level): the first rule that
    applies, in this order: known level too low, not found, private, level too low, done."""
    return F.when(below_floor("known_level"), "skipped_floor").when(F.col("http_status") == 404, "not_indexed").when(~F.coalesce("visible", F.lit(False)), "skipped_private").when(below_floor("level"), "skipped_floor").otherwise("done")


def route(kind):
    """(status to write or null, whether to release, whether to back off) of a visit's end."""
    k = F.col(kind)
    return (
        F.when(k == "fetch_failed", "error").when(k == "finished", "done").alias("status"),
        (~k.isin("finished", "fetch_failed")).alias("released"),
        k.isin("circuit_open", "limited", "busy").alias("backs_off"),
    )
