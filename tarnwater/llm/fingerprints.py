"""Document fingerprints from prefix polynomial hashes.

A text's prefix array answers the hash of any span in constant time: spans are equal iff their
hashes are (up to a chance of about 2**-61 for each comparison), and the longest common extension
of two positions is found by binary search. A fingerprint is the hash of the whole text and, for
each of 128 bins, the least hash of the 8-character spans that fall into it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import keyed, mixed, prefix_hashes, spans, stored, texts

SPAN, BINS, DIGITS = 8, 128, 3


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        self.sums = prefix_hashes(points)

    def span(self, start, end):
        """Hashes of the spans [start, end) (numbers or arrays), each of 62 bits."""
        return spans(self.sums, start, end)

    def equal(self, i, other, j, length):
        """Whether the spans of `length` at i here and at j in other are equal."""
        return bool(self.span(i, i + length) == other.span(j, j + length))

    def extension(self, i, other, j):
        """Length of the longest common extension of position i here and j in other."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def extension_back(self, i, other, j):
        """The same to the left of positions i and j."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low

    def fingerprint(self):
        """Hash of the whole, then DIGITS hexadecimal digits of each bin's least span; '' of no text."""
        if not self.n:
            return ""
        starts = np.arange(max(1, self.n - SPAN + 1))
        h = mixed(self.span(starts, np.minimum(starts + SPAN, self.n)))
        least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        bins = (h >> np.uint64(57)).astype(np.intp)
        order = np.argsort(h)  # bins are the topmost bits: the first of each bin is its least
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        least[bins[order[first]]] = h[order[first]]
        full = np.flatnonzero(least != np.iinfo(np.uint64).max)
        # an empty bin takes the value of the next full one, told apart by the distance
        to = full[np.searchsorted(full, np.arange(BINS)) % len(full)]
        away = (to - np.arange(BINS)) % BINS
        values = mixed(least[to] + away.astype(np.uint64)) >> np.uint64(64 - 4 * DIGITS)
        whole = int(self.span(0, self.n)) ^ self.n << 1
        return f"{whole & (1 << 64) - 1:016x}" + "".join(f"{v:03x}" for v in values.tolist())


def likeness(a, b):
    """Share of the bins in which two fingerprints agree: an estimate of the Jaccard similarity of
    the texts' 8-character spans. 1 for equal fingerprints, 0 if one alone is of no text."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(s[16:].encode(), f"S{DIGITS}") for s in (a, b))
    return float(np.mean(x == y))


def fingerprint(docs, id_col="doc_id", text_col="text"):
    """One row per row of docs: its characters and fingerprint. Null counts as empty."""

    def run(batches):
        for batch in batches:
            made = [PrefixHashes(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.n for m in made], pa.int64()), pa.array([m.fingerprint() for m in made], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string").withColumnRenamed("doc_id", id_col)


#: Bits of a text's hash in its place among the rows of its id, and of the whole place (exact as a double).
HASH_BITS, PLACE_BITS = 22, 53


def in_order(docs, id_col="doc_id", text_col="text"):
    """docs dealt into ranges of descending id, each followed by the row that comes next.

    Returns rows of doc_id, text, copies, part, guest; within partitions each part's rows are
    followed by the first row of the next part as a guest (the last part's by the very first). Null
    ids come last. Rows of one id come in the order of their texts' length, then of a hash, then of
    the texts. The rows of an id that fills more than one range are counted where they are equal
    (`copies`; 1 for all others), and dealt into several ranges by that order.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key")
    shares = lambda n: [(i + 1) / n for i in range(n)]
    rows = keyed(docs, id_col, text_col).select("doc_id", key, F.coalesce("text", F.lit("")).alias("text"))
    about = rows.agg(F.percentile_approx("key", shares(parts), 10 * parts).alias("b")).first().b or []
    ranges = Counter(about)
    hot = sorted(k for k, n in ranges.items() if n > 1)
    place = F.shiftleft(F.char_length("text").cast("long"), HASH_BITS).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    place = F.lit((1 << PLACE_BITS) - 1) - place  # the first row of an id has the greatest
    bounds = [(k, 1 << PLACE_BITS) for k, n in ranges.items() if n == 1]
    rows = rows.withColumn("copies", F.lit(1).cast("long")).withColumn("place", F.lit(0).cast("long"))
    if hot:
        alike = rows.where(F.col("key").isin(hot)).groupBy("doc_id", "key", "text").agg(F.count("*").alias("copies"))
        alike = stored(alike.withColumn("place", place))
        most = max(ranges.values())
        for r in alike.groupBy("key").agg(F.percentile_approx("place", shares(most), 10 * most).alias("b")).collect():
            n = ranges[r.key]
            bounds += {(r.key, r.b[-(-(i + 1) * most // n) - 1]) for i in range(n)}
        rows = rows.where(~F.col("key").isin(hot)).union(alike.select(rows.columns))
    bounds.sort()

    def part(keys, places):
        return [min(bisect_left(bounds, at), len(bounds) - 1) for at in zip(keys.tolist(), places.tolist())]

    @F.pandas_udf("int")
    def part_of(keys: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(part(keys, places), dtype="int32")

    # bounds are about where a range ends; its first row is that with the greatest place in it
    first = rows.groupBy(part_of("key", "place").alias("part")).agg(F.max(F.struct("key", "place")).alias("at")).orderBy("part").collect()
    firsts = {r.part: tuple(r.at) for r in first}
    before = {p: q for (p, *_), (q, *_) in zip(first, first[1:] + first[:1])}

    @F.pandas_udf("array<struct<part: int, guest: boolean>>")
    def dealt(keys: pd.Series, places: pd.Series) -> pd.Series:
        at = zip(part(keys, places), keys.tolist(), places.tolist())
        return pd.Series([[(p, False), (before[p], True)] if firsts[p] == (k, s) else [(p, False)] for p, k, s in at])

    rows = rows.withColumn("to", F.explode(dealt("key", "place"))).select("doc_id", "key", "text", "copies", "to.part", "to.guest")
    rows = rows.repartition(parts // 4, "part").sortWithinPartitions("part", "guest", F.desc("key"), place.desc(), "text")
    return rows.select("doc_id", "text", "copies", "part", "guest")


#: Rows of a batch of equal results.
LOT = 1 << 14


def edited(text, following):
    """text, its last third replaced by the beginning of the text that follows."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_with_edits(docs, id_col="doc_id", text_col="text"):
    """For each row: fingerprints of its text and of the edited text, their likeness, the likeness
    to the next document's, and how far text and edited text agree from the start (found by binary
    search over the prefix hashes). Null counts as empty; an empty table gives an empty result;
    repeated rows follow one another, rows of one id by length, then by hash; other columns are not
    read. A text is held whole, with arrays of its length: the longest bounds a task's memory.
    """
    rows = in_order(docs, id_col, text_col)

    def finish(row, following):
        (i, text, hashes, mark), (_, next_text, _, next_mark) = row, following
        new = edited(text, next_text)
        new_hashes = PrefixHashes(new)
        new_mark = mark if new == text else new_hashes.fingerprint()
        return i, hashes.n, hashlib.sha256(new.encode()).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark), hashes.extension(0, new_hashes, 0)

    def run(batches):
        last, part = None, None
        for batch in batches:
            out, again = [], []
            for i, text, copies, p, guest in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and (last is None or p != part):
                    continue  # only the first guest of a part counts
                made = PrefixHashes(text)
                row = (i, text, made, made.fingerprint())
                if last is not None:
                    out.append(finish(last, row))
                if copies > 1 and not guest:
                    again.append((len(out), copies - 2))
                    out.append(finish(row, row))
                last, part = (None if guest else row), p
            columns = list(zip(*out)) or [[]] * len(schema)
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            yield done
            for k, n in again:
                for a in range(0, n, LOT):
                    yield done.take(pa.array(np.full(min(LOT, n - a), k)))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_prefix long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return rows.mapInArrow(run, ddl).withColumnRenamed("doc_id", id_col)
