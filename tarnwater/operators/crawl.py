"""One round of the crawl, set at a time: claimed players, what was landed for them, the store.

Responses are landed by whatever fetches them: profiles (uid, http_status, raw), history pages (uid,
skip, http_status, raw), details (match_uid, http_status, raw), boards (hero_id, raw) and (raw). Of several
for one key the one that arrived last counts. The round is the chain of a visit for all claimed players at once.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.expressions import below_floor, response_class
from ..sources import payloads
from . import frontier, history, metrics, seeding, states
from .ingest import ingest, upsert

PROFILE = ["nick_name", "latest_known_score", "latest_known_level", "visibility_json"]


def visits(claimed, profiles, season):
    """(uid, outcome, profiled, and what the profile says) of claimed players, by the newest response for each, in
    this order: known level too low, no answer or a failure (error), limited, not found, private, level too low,
    done as far as the profile goes. Those that have read a profile (profiled) have it merged."""
    known = claimed.select("uid", F.col("latest_known_level").alias("known_level"))
    latest = payloads.newest(profiles, "uid").select("uid", "raw", payloads.status(profiles).alias("http_status"))
    rows = payloads.profiles(known.join(latest, "uid", "left"), season)
    kind = F.when(F.col("http_status").isNull(), "failed").otherwise(response_class("http_status", F.lit(False)))
    failed = (kind == "failed") | ((kind == "ok") & ~F.col("readable"))
    outcome = (
        F.when(below_floor("known_level"), "skipped_floor").when(failed, "error").when(kind == "limited", "limited").when(kind == "missing", "not_indexed")
        .when(~F.col("visible"), "skipped_private").when(below_floor("latest_known_level"), "skipped_floor").otherwise("done")
    )
    profiled = ~below_floor("known_level") & ~failed & (kind == "ok")
    return rows.select("uid", outcome.alias("outcome"), profiled.alias("profiled"), *PROFILE)


def read_histories(seen, claimed, pages, known, full=payloads.PAGE_SIZE):
    """(pages that are reached, their marked entries) of the visits that are done as far as the profile goes."""
    done = seen.where("outcome = 'done'").select("uid")
    reached = history.chain(payloads.pages(pages.join(done, "uid", "left_semi")), full)
    entries = payloads.entries(reached.where("kind = 'ok'"))
    return reached, history.marked(entries, known, claimed.select("uid", "last_crawled_at"))


def to_fetch(seen, claimed, pages, known, full=payloads.PAGE_SIZE):
    """(match_uid, map_id, ...) of the matches that the histories of finished visits name and the store lacks."""
    found = read_histories(seen, claimed, pages, known, full)[1].where(history.FETCHED)
    return history.work_list(found.drop("is_known", "revisit", "met"))


def complete(seen, troubles):
    """The ends of visits (uid, outcome, skip, pos): one that is done as far as its profile goes is an error, or
    limited, where its history or a wanted match has no final answer (waiting, where it is only not there yet); where is the place
    of the first such."""
    rows = seen.join(troubles.withColumnRenamed("kind", "trouble"), "uid", "left")
    outcome = F.when((F.col("outcome") != "done") | F.col("trouble").isNull(), F.col("outcome")).when(F.col("trouble") == "limited", "limited").when(F.col("trouble") == "waiting", "waiting").otherwise("error")
    return rows.select("uid", outcome.alias("outcome"), "skip", "pos")


#: What a round came to: documents that were rejected, visits finished (error included), visits put back.
Round = namedtuple("Round", "rejected finished released")


def visit(store, profiles, pages, details, season, now, full=payloads.PAGE_SIZE, waits=False):
    """Finish the visits of all claimed players, or put them back; returns a Round.

    Every match that was landed for one of the visits is merged, in one commit; profiles and statuses come in
    the next; a crash between them leaves the players claimed, and the round can run again. A visit is done only if
    its pages are whole and each wanted match has a final answer: merged, not found, or malformed. If not,
    it ends as an error (a page or match has failed or was never landed), or the player is put back (limited).
    As matches of such a visit may be stored by then, a next visit that stopped at the first known one would never
    come to the rest: the stamp of the last visit goes, so that the next one reads the whole history.

    waits: responses come in bit by bit. Only players whose profile has landed since they were claimed are visited, and a
    visit to which a page or match is not there yet stays claimed (until it is put back as an orphan).
    """
    claimed = store.read("players").where("crawl_status = 'claimed'")
    if waits:
        seen_at = payloads.newest(profiles, "uid").select("uid", F.col("landed_at").alias("_at"))
        claimed = claimed.join(seen_at, "uid").where("_at >= claimed_at * 1000000").drop("_at")
    told, counts = Observation("visits"), F.col("status").isNotNull()
    with store.staged(visits(claimed, profiles, season)) as seen, store.staged(payloads.answers(details)) as answers:
        reached, found = read_histories(seen, claimed, pages, store.read("matches"), full)
        with store.staged(found.drop("page_size")) as found:
            wanted = history.work_list(found.where(history.FETCHED).drop("is_known", "revisit", "met"))
            first = history.troubles(found, reached, seen.where("outcome = 'done'"), answers, full, "waiting" if waits else "failed")
            ends = complete(seen, first).join(seen.select("uid", F.col("outcome").alias("at_first")), "uid")
            waiting = F.col("outcome") == "waiting"
            ended = F.when(F.col("outcome") == "error", "fetch_failed").when(F.col("outcome") == "limited", "limited").otherwise("finished")
            status, released, _ = states.route("ended")
            status = F.when(waiting, None).when(status == "done", F.col("outcome")).otherwise(status)
            ends = ends.withColumn("ended", ended).select("uid", status.alias("status"), released.alias("released"), waiting.alias("waiting"), (F.col("at_first") == "done").alias("read"))
            with store.staged(ends.observe(told, F.count_if(counts).alias("finished"), F.count_if("released").alias("released"))) as ends:
                merged = history.with_details(wanted.select("match_uid", "map_id"), answers.where("kind IN ('ok', 'malformed')").select("match_uid", "raw")).where("raw IS NOT NULL")
                rejected = ingest(store, merged.select("raw", F.lit(now).cast("long").alias("seq"), "map_id"), season, now)
                players = upsert(store.read("players"), seen.where("profiled").select("uid", *PROFILE).withColumn("seq", F.lit(now)), "players")
                players = states.finish(players, ends.select("uid", F.col("status").alias("outcome")), now)
                players = states.put_back(players, ends.where("released").select("uid", "read"))
                store.commit({"players": states.reopened(players, ends.where("waiting"))})
    return Round(rejected, told.get["finished"], told.get["released"])


def crawl(store, profiles, pages, details, season, now):
    """One round (see visit); returns the documents that were rejected."""
    return visit(store, profiles, pages, details, season, now).rejected


def claim(store, workers, batch, now):
    """Claim the next entries of the queue, `batch` for each worker; returns how many were pending. They are
    counted as they are written."""
    players = store.read("players")
    pending = players.where("crawl_status = 'pending'")
    chosen = frontier.top(pending, None, "hero_id", workers * batch, counts=frontier.stored_coverage(store))
    told = Observation("claims")
    with store.staged(chosen.select("uid").observe(told, F.count("*").alias("n"))) as chosen:
        n = told.get["n"]
        if n:
            store.commit({"players": states.claim(players, chosen, now)})
    return n


def tick(store, boards, now, say=print):
    """The periodic part: read boards again, put stale players back. A failure to read the boards is
    said and left to the next time; requeueing needs no boards and is done all the same. Returns how many players of
    each kind were put back, counted as they are written."""
    try:
        hero_boards, global_board = boards()
        say(f"{seeding.reseed(store, hero_boards, global_board, now)} players seeded")
    except Exception as e:  # any source may fail in any way
        say(f"reseed failed, to be tried again: {type(e).__name__}: {str(e)[:200]}")
    players, told = store.read("players"), Observation("requeued")
    store.commit({"players": states.requeue(players.observe(told, *states.stale_counts(now)), now)})
    store.vacuum()
    counts = {name: told.get[f"n_{name}"] for name in states.stale(now)}
    say("put back: " + ", ".join(f"{n} {name}" for name, n in counts.items()))
    return counts


#: Seconds of rest after a round in which a player was put back, rounds in a row that may finish no visit at all.
REST, PATIENCE = 60, 3


def run(store, source, season, stop=lambda: False, clock=None, interval=86400, workers=1, batch=1000, say=print, sleep=None, rest=REST, patience=PATIENCE):
    """Crawl until nothing is pending or stop() is true, which is asked between rounds; the round at
    hand is always finished. source: an object with boards() -> (hero boards, global board) and
    responses(claimed players) -> (profiles, pages, details). After each round its counts and the progress line
    are said. A round that put players back (429, 403) is followed by a rest of `rest` seconds; after
    `patience` such rounds in a row that finished no visit, the run ends and leaves them pending. Returns the number of rounds."""
    from time import sleep as wait
    from time import time

    clock, sleep = clock or (lambda: int(time())), sleep or wait
    last, rounds, idle = None, 0, 0
    while not stop() and idle < patience:
        if last is None or clock() - last > interval:
            tick(store, source.boards, clock(), say)
            last = clock()
        if not claim(store, workers, batch, clock()):
            break
        done = visit(store, *source.responses(store.read("players").where("crawl_status = 'claimed'")), season, clock())
        rounds += 1
        say(f"round {rounds}: {done.finished} visits finished, {done.released} put back; {metrics.progress(store, clock())}")
        idle = 0 if done.finished else idle + 1
        waited = 0
        while done.released and waited < rest and not stop():
            sleep(min(1, rest - waited))
            waited += 1
    return rounds
