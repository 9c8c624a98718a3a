"""Folds over a log of responses, each client's in its own order.

The log has (client, seq, failed, latency); seq is a total order within a client.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed values of the pacing rules.
START, LOWEST, HIGHEST = 1.0, 0.2, 8.0
EASE, SLOW, DOUBLE = 0.95, 1.5, 2.0
STREAK, SLOW_SECONDS = 3, 2.0
THRESHOLD, COOLDOWN = 10, 300

#: Types of what a state holds.
KINDS = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}


def same(a, b):
    """Whether two clients are one, as Spark groups them: nulls are alike, and so are NaNs."""
    return a == b or (a != a and b != b)


def folded(log, order, values, start, step, state):
    """(client, *state) at the end of each client's responses, taken by the columns `order`.

    Spark sorts the responses, which spills, and step(state, *values) folds one of them in Python.
    From one Arrow batch to the next only the state of the client at hand is kept.
    """
    kind = log.schema["client"].dataType.simpleString()
    rows = log.repartition("client").sortWithinPartitions("client", *order).select("client", *values)
    types = [KINDS[k] for k in state.values()]

    def run(batches):
        last = None  # (client, state) at hand
        for batch in batches:
            done = []
            for client, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or not same(client, last[0]):
                    done += [last] if last else []
                    last = client, start
                last = client, step(last[1], *row)
            if done:
                yield made(done, batch.schema.field(0).type)
            of = batch.schema.field(0).type
        if last:
            yield made([last], of)

    def made(done, of):
        columns = zip(*(x for _, x in done))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], of), *map(pa.array, columns, types)], ["client", *state])

    return rows.mapInArrow(run, ", ".join([f"client {kind}", *(f"{c} {k}" for c, k in state.items())]))


def troubles():
    """(failed, slow) of a response, as columns; null is neither."""
    return F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce(F.col("latency") > SLOW_SECONDS, F.lit(False)).alias("slow")


def delay_step(state, failed, slow):
    """(delay, streak) after one response."""
    delay, streak = state
    if failed:
        return min(HIGHEST, delay * DOUBLE), 0
    if slow:
        return min(HIGHEST, delay * SLOW), 0
    return max(LOWEST, delay * EASE) if streak + 1 >= STREAK else delay, streak + 1


#: Kinds of responses to the pace, and runs of them that a map holds before it is closed.
FAST, TARDY, FAILED = range(3)
RUNS = 4096


def paced(delay, streak, kind, n):
    """(delay, streak) after n responses of one kind; the same as n steps, but no longer than it takes to a bound."""
    if kind == FAST:
        eased = n - max(0, STREAK - 1 - streak)
        while eased > 0 and delay > LOWEST:
            delay, eased = max(LOWEST, delay * EASE), eased - 1
        return delay, streak + n
    while n and delay < HIGHEST:
        delay, n = min(HIGHEST, delay * (DOUBLE if kind == FAILED else SLOW)), n - 1
    return delay, 0


class Pace:
    """What a stretch of a log does to any (delay, streak) before it.

    A step keeps the order of two states (a lower delay with a longer streak stays lower), in floating point too. So the
    lowest and the highest state there can be before the stretch are paced side by side: once they meet, every state
    has met them, and what came before no longer matters. Only a stretch in which they don't meet has to
    keep its runs of responses, to be gone through when the state before it is known. `then` puts two stretches together.
    """

    def __init__(self):
        self.low, self.high = (LOWEST, STREAK - 1), (HIGHEST, 0)
        self.runs, self.met, self.trouble, self.since = [], False, False, 0

    def add(self, kind, n):
        self.since = self.since + n if kind == FAST else 0
        self.trouble |= kind != FAST
        self.low, self.high = paced(*self.low, kind, n), paced(*self.high, kind, n)
        if not self.met:
            self.runs.append((kind, n))
            self.met = self.low[0] == self.high[0] and min(self.low[1], STREAK - 1) == min(self.high[1], STREAK - 1)
            if self.met:
                self.runs = []

    def then(self, other):
        if other.met:
            self.met, self.low, self.high, self.runs = True, other.low, other.high, []
            self.since = other.since if other.trouble else self.since + other.since
            self.trouble |= other.trouble
        else:
            for run in other.runs:
                self.add(*run)
        return self

    def state(self):
        """As a row: met, delay, trouble, since, kinds and numbers of the runs."""
        return self.met, self.low[0], self.trouble, self.since, [k for k, _ in self.runs], [n for _, n in self.runs]


def applied(state, met, delay, trouble, since, kinds, numbers):
    """(delay, streak) behind a stretch, given as Pace.state() has it."""
    if met:
        return delay, since if trouble else state[1] + since
    for kind, n in zip(kinds, numbers):
        state = paced(*state, kind, n)
    return state


def stretches(log, order, values, schema, made):
    """Rows of made() over the stretches of each client's log that lie in one task: (client, part, seq, ...).

    The log is sorted by ranges of client and the first column of `order`, so a client with any number of
    responses is spread over tasks. made() returns an object whose read(columns) takes a stretch's
    values, an array each, and whose rows(end) gives what there is to hand on, `end` where the client's stretch ends.
    """
    kind = log.schema["client"].dataType.simpleString()
    rows = log.repartitionByRange("client", order[0]).sortWithinPartitions("client", *order).select("client", *values)
    names = ["client", "part", "seq", *(f.split(" ")[0] for f in schema.split(", "))]

    def run(batches):
        seq, last = 0, None  # last: (client, object)
        for batch in batches:
            out = []
            clients = batch.column(0)
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            for a, b in equal_runs(clients):
                client = clients[a].as_py()
                if last is None or not same(client, last[0]):
                    out += [(last[0], r) for r in last[1].rows(True)] if last else []
                    last = client, made()
                last[1].read([v[a:b] for v in values])
                out += [(client, r) for r in last[1].rows(False)]
            yield batch_of(out, seq)
            seq += len(out)
        if last:
            yield batch_of([(last[0], r) for r in last[1].rows(True)], seq)

    def batch_of(out, seq):
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_pylist([dict(zip(names, (client, part, seq + i, *r))) for i, (client, r) in enumerate(out)], arrow)

    fields = f"client {kind}, part int, seq long, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    return rows.mapInArrow(run, fields)


def equal_runs(column):
    """(start, end) of the runs of equal values of an Arrow array; nulls are alike, and so are NaNs."""
    n = len(column)
    if not n:
        return []
    a, b = column[:-1], column[1:]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    differ |= pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        x, y = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        differ &= ~(np.isnan(x) & np.isnan(y) & (pc.is_null(a).to_numpy(zero_copy_only=False) == pc.is_null(b).to_numpy(zero_copy_only=False)))
    ends = [*(np.flatnonzero(differ) + 1).tolist(), n]
    return list(zip([0, *ends[:-1]], ends))


class PaceOf:
    """The maps of a client's stretch."""

    def __init__(self):
        self.map, self.done = Pace(), []

    def read(self, columns):
        failed, slow = columns
        kinds = np.where(failed, FAILED, np.where(slow, TARDY, FAST))
        ends = [*(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
        for a, b in zip([0, *ends[:-1]], ends):
            self.map.add(int(kinds[a]), b - a)
            if len(self.map.runs) >= RUNS:
                self.done.append(self.map.state())
                self.map = Pace()

    def rows(self, end):
        out, self.done = self.done, []
        if end:
            out.append(self.map.state())
            self.map = Pace()
        return out


PACE = "met boolean, delay double, trouble boolean, since long, kinds array<int>, numbers array<long>"


def pace_maps(log):
    """(client, part, seq, ...): what the stretches of each client's log do to its pace, a few rows each."""
    return stretches(log, ["seq", "failed", "latency"], troubles(), PACE, PaceOf)


def adaptive_delay(log):
    """(client, delay, streak) at the end of the log: the maps of its stretches, applied one after the other."""
    columns = [f.split(" ")[0] for f in PACE.split(", ")]
    return folded(pace_maps(log), ["part", "seq"], columns, (START, 0), applied, {"delay": "double", "streak": "int"})


class TroublesOf:
    """Of a client's stretch, all but runs of readable successes, of which one row each is left."""

    def __init__(self):
        self.found = []

    def read(self, columns):
        at, until, failed, bad = columns
        quiet = ~(failed | bad)
        some = np.where(np.isnan(at), np.inf, at)
        starts = np.flatnonzero(np.concatenate([[True], ~(quiet[1:] & quiet[:-1])]))
        latest = np.maximum.reduceat(some, starts)  # of a run, what tells whether any of it came while the circuit was closed
        for i, top in zip(starts.tolist(), latest.tolist()):
            self.found.append((top, None, False, False) if quiet[i] else (None if np.isnan(at[i]) else float(at[i]), None if np.isnan(until[i]) else float(until[i]), bool(failed[i]), bool(bad[i])))

    def rows(self, end):
        out, self.found = self.found, []
        return out


def circuit_log(log, cooldown=COOLDOWN):
    """(client, part, seq, at, until, failed, bad): each client's log with every run of readable successes made one
    row, at the latest of its times: such a run ends both counters if any of it came while the circuit was closed."""
    bad = F.coalesce(F.col("bad_json") if "bad_json" in log.columns else F.lit(False), F.lit(False))
    values = F.col("at").cast("double").alias("at"), (F.col("at") + cooldown).cast("double").alias("until"), F.coalesce("failed", F.lit(False)).alias("failed"), F.col("bad")
    return stretches(log.withColumn("bad", bad), ["seq", "at", "failed", "bad"], values, "at double, until double, failed boolean, bad boolean", TroublesOf)


def circuit(log, threshold=THRESHOLD, cooldown=COOLDOWN):
    """(client, failures, openings, open_until) at the end of the log of (client, seq, at, failed); where
    the log has bad_json too, also unreadable.

    A request while the circuit is open is refused and changes nothing. Failures, and successes whose
    body can't be read, have a counter each: a success ends the run of failures, a readable one that
    of unreadable ones; a failure leaves the latter as it is. The counters stay when the circuit
    opens, so the first failure (or unreadable body) afterwards opens it again. Runs of readable successes are made one row
    where they are read; what is left of a client's log, its troubles, is gone through in order.
    """

    def step(state, at, until, failed, bad):
        failures, unreadable, openings, open_until = state
        if at is not None and open_until is not None and at < open_until:
            return state
        failures = failures + 1 if failed else 0
        unreadable = unreadable if failed else unreadable + 1 if bad else 0
        opens = failures >= threshold if failed else bad and unreadable >= threshold
        return (failures, unreadable, openings + 1, until) if opens else (failures, unreadable, openings, open_until)

    found = folded(circuit_log(log, cooldown), ["part", "seq"], ["at", "until", "failed", "bad"], (0, 0, 0, None), step, {"failures": "int", "unreadable": "int", "openings": "int", "open_until": "double"})
    return found.select("client", "failures", "openings", "open_until", *(["unreadable"] if "bad_json" in log.columns else []))


def failure_streaks(log, least=2):
    """(client, first, length) of runs of consecutive failures: gaps and islands, no state."""
    by = Window.partitionBy("client").orderBy("seq")
    rows = log.withColumn("island", F.count_if(~F.col("failed")).over(by)).where("failed")
    return rows.groupBy("client", "island").agg(F.min("seq").alias("first"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def last_attempts(log, tries=3):
    """(request, outcome) of (request, attempt, kind): the last attempt decides; a request that
    used up its tries on failures has failed, on limits is limited."""
    last = log.groupBy("request").agg(F.max_by("kind", "attempt").alias("kind"), F.count("*").alias("attempts"))
    spent = F.col("attempts") >= tries
    return last.select("request", "attempts", F.when(F.col("kind").isin("ok", "missing"), F.col("kind")).when(spent & (F.col("kind") == "limited"), "rate_limited").when(spent, "fetch_failed").otherwise("retry").alias("outcome"))


def request_outcomes(log, tries=3, parses=3):
    """(request, outcome, attempts) of (request, parse, attempt, kind, readable): a request is made again, up to `parses` times, while
    its body can't be read, and each time up to `tries` attempts are made until one is ok or missing.

    The first reading that isn't unreadable decides: ok, missing, or, its tries spent, rate_limited or fetch_failed as the last
    attempt has it. Bodies that can't be read to the last are unreadable. What has attempts left is retry.
    """
    ended = F.col("kind").isin("ok", "missing")
    first = F.min_by(F.struct("kind", "readable"), F.when(ended, F.col("attempt")))
    core = log.groupBy("request", "parse").agg(first.alias("first"), F.bool_or(ended).alias("ended"), F.max_by("kind", "attempt").alias("last"), F.count("*").alias("n"))
    spent = F.col("n") >= tries
    result = (
        F.when(F.col("ended") & (F.col("first.kind") == "missing"), "missing").when(F.col("ended") & F.coalesce("first.readable", F.lit(False)), "ok").when(F.col("ended"), "unreadable")
        .when(spent & (F.col("last") == "limited"), "rate_limited").when(spent, "fetch_failed").otherwise("retry")
    )
    core = core.withColumn("result", result)
    told = F.min_by("result", F.when(F.col("result") != "unreadable", F.col("parse")))
    some = F.bool_or(F.col("result") != "unreadable")
    every = core.groupBy("request").agg(F.when(some, told).when(F.count("*") >= parses, "unreadable").otherwise("retry").alias("outcome"), F.sum("n").alias("attempts"))
    return every.select("request", "outcome", "attempts")
