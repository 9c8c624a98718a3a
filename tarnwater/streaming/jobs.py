"""Continuous forms of the batch operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import crawl, folds
from ..operators.ingest import ingest
from ..sources import payloads


def ingest_stream(landed, store, season, now, checkpoint, **options):
    """Start merging landed matches (raw, seq) into the store, one commit per micro-batch.

    A batch that is run again after a crash merges the same rows by key, so it changes nothing twice.
    """

    def batch(df, _):
        ingest(store, df, season, now)

    return landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True, **options).start()


def crawl_stream(source, store, season, checkpoint, clock=None, full=payloads.PAGE_SIZE, say=print, options=None, **trigger):
    """Start the crawl as a stream: whatever lands (profiles, pages or details) is a micro-batch, and each one goes on with the
    visits of claimed players whose profiles have landed since. source: a Landed. A visit ends when all that it wants has an answer.
    Claiming and requeueing are left to `claim` and `tick`, which may run beside it in between. A micro-batch that is run again
    finds the visits that it had ended no longer claimed. Returns the query; `run_until` stops it between micro-batches."""
    from time import time

    clock = clock or (lambda: int(time()))
    kinds = ("profiles", "pages", "details")
    parts = [source.stream(k, **(options or {})).select("landed_at") for k in kinds]

    def batch(df, n):
        done = crawl.visit(store, *(source.read(k) for k in kinds), season, clock(), full, waits=True)
        say(f"batch {n}: {done.finished} visits finished, {done.released} put back")

    return parts[0].unionByName(parts[1]).unionByName(parts[2]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def throughput(finished, window="10 minutes", slide="1 minute", late="10 minutes", ts="ts"):
    """(start, n, per_minute) over sliding windows of event time; works on streams and tables."""
    minutes = float(window.split()[0])
    rows = finished.withWatermark(ts, late) if finished.isStreaming else finished
    counts = rows.groupBy(F.window(ts, window, slide)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "n", (F.col("n") / F.lit(minutes)).alias("per_minute"))


#: The state store of stateful operators; what a pace's state holds, and a response in its `pending`.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "delay double, streak int, n long, pending binary"
PENDING = np.dtype([("seq", "<i8"), ("at", "<i8"), ("failed", "?"), ("slow", "?")])


def pace_of(idle):
    """The pace of one client from one micro-batch to the next, as a function of (key, rows, state).

    The state holds what is settled, and the responses that the watermark has not passed, among which a late one may
    still have to be put in its place by seq; it comes and goes beside the rows of many clients, without messages for each. Each
    micro-batch emits the pace as it is with all responses so far. A timeout settles the rest of a client that
    falls silent, and forgets one that has been idle for `idle` milliseconds (0: never).
    """

    def fold(settled, rows):
        delay, streak, n = settled
        for failed, slow in zip(rows["failed"].tolist(), rows["slow"].tolist()):
            delay, streak = folds.delay_step((delay, streak), failed, slow)
        return delay, streak, n + len(rows)

    def run(key, batches, state):
        *settled, pending = state.get if state.exists else (folds.START, 0, 0, b"")
        found, watermark = [np.frombuffer(bytes(pending), PENDING)], state.getCurrentWatermarkMs()
        if state.hasTimedOut and not len(found[0]):
            state.remove()
            return
        for batch in () if state.hasTimedOut else batches:
            new = np.empty(len(batch), PENDING)
            for c in PENDING.names:
                new[c] = batch[c].to_numpy()
            found.append(new)
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows["slow"], rows["failed"], rows["seq"]))]
        late = rows["at"] >= watermark  # nothing can come before the others any more
        cut = int(late.argmax()) if late.any() else len(rows)
        settled, rest = fold(settled, rows[:cut]), rows[cut:]
        state.update((*settled, rest.tobytes()))
        wake = int(rows["at"].max()) + 1
        if len(rest):
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        elif idle:
            state.setTimeoutTimestamp(max(wake + idle, watermark + 1))
        if not state.hasTimedOut:
            yield pd.DataFrame([(*key, *fold(settled, rest))], columns=["client", "delay", "streak", "n"])

    return run


def pace(responses, sink, checkpoint, ts="ts", late="10 minutes", idle=0, partitions=None):
    """Keep (client, delay, streak, n) of a stream of (client, seq, ts, failed, latency) in the folder `sink`.

    seq orders a client's responses and grows with their time. The state of each client is in Spark's state store; a
    micro-batch writes the clients that it touched, as one version there, so that a batch that is run again writes the same
    once more. A response that comes later than `late` after newer ones is dropped, if it is older than the watermark by then; one
    that comes before that is put in its place. A task holds the responses of one client that are not settled. partitions: into how many the state is cut, for good
    (the session's shuffle partitions by default). Returns a function that reads the result.
    """
    spark = responses.sparkSession
    kind = responses.schema["client"].dataType.simpleString()
    out = f"client {kind}, delay double, streak int, n long"
    rows = responses.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", late)
    failed, slow = folds.troubles()
    rows = rows.select("client", F.col("seq").cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("at"), failed, slow)
    states = rows.groupBy("client").applyInPandasWithState(pace_of(idle), out, STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def batch(df, n):
        df.write.mode("overwrite").parquet(f"{sink}/v{n}")

    provider, shuffle = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {name: spark.conf.get(name) for name in (provider, shuffle)}
    spark.conf.set(provider, ROCKSDB)
    spark.conf.set(shuffle, str(partitions or before[shuffle]))
    try:
        query = states.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return lambda: latest_versions(spark, sink, out, ["client"])


def latest_versions(spark, sink, schema, key):
    """Of each key the row of the newest version in a folder that has it; empty before the first."""
    versions = whole_versions(spark, sink)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(f"{sink}/v{n}" for n in versions))
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/v([0-9]+)/[^/]*$", 1).cast("long")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), version).alias("_row")).select(*key, "_row.*")


def distinct_stream(events, sink, checkpoint, key, ts="ts", late="1 day"):
    """Append each event of a stream once to the folder `sink`, however often it is delivered within `late`: the state
    holds a key only until the watermark has passed it. The sink commits each micro-batch once. Returns a function that reads the result."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return lambda: rows.sparkSession.read.schema(rows.schema).parquet(sink)


def throughput_stream(finished, sink, checkpoint, **windows):
    """Append the windows of throughput() to the folder `sink` as the watermark closes them. An event counts in the windows
    that are still open when it comes. Returns a function that reads the result."""
    counts = throughput(finished, **windows)
    query = counts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return lambda: counts.sparkSession.read.schema(counts.schema).parquet(sink)


class Progress(StreamingQueryListener):
    """Says a line for each micro-batch of the session's streams that had rows, and one when a stream ends."""

    def __init__(self, say=print):
        self.say = say

    def onQueryStarted(self, event):
        self.say(f"stream {event.name or event.id} started")

    def onQueryProgress(self, event):
        p = event.progress
        seen = {k: r.asDict() for k, r in (p.observedMetrics or {}).items()}
        if p.numInputRows or seen:
            told = "".join(f" {name}: " + " ".join(f"{k}={v}" for k, v in sorted(values.items())) for name, values in sorted(seen.items()))
            self.say(f"batch {p.batchId}: {p.numInputRows} rows, {p.processedRowsPerSecond or 0:.0f}/s{told}")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.say(f"stream {event.id} " + ("failed: " + event.exception.splitlines()[0] if event.exception else "ended"))


def latest_stream(events, sink, checkpoint, key, order):
    """Keep the latest row of each key of a stream of files in the folder `sink`: each micro-batch is
    merged with the version before it into a new one. Returns a function that reads the result."""
    from ..operators.changelog import latest

    spark = events.sparkSession

    def batch(df, n):
        rows = df if n == 0 else df.unionByName(spark.read.schema(df.schema).parquet(f"{sink}/v{n - 1}"))
        latest(rows, key, order).write.mode("overwrite").parquet(f"{sink}/v{n}")

    query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return lambda: newest(spark, sink, events.schema)


def whole_versions(spark, sink):
    """Numbers of the whole versions in a folder of versions."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/v*/_SUCCESS")
    found = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def newest(spark, sink, schema):
    """The newest whole version in a folder of versions, whichever run wrote it; empty before the first."""
    versions = whole_versions(spark, sink)
    return spark.read.schema(schema).parquet(f"{sink}/v{versions[-1]}") if versions else spark.createDataFrame([], schema)


def run_until(query, stop, poll=1.0):
    """Wait for a streaming query, or for stop() to be true; the micro-batch at hand is then finished
    before the query is stopped. Returns whether it ended by itself."""
    while not query.awaitTermination(poll):
        if stop():
            while query.isActive and query.status["isTriggerActive"]:
                query.awaitTermination(poll)
            query.stop()
            return False
    return True
