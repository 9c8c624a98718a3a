"""Suffix-array dedup: bytes of repeated strings of a given length, found by longest-previous-factor arrays.

Every window of `length` bytes has an anchor, the least hash of the `gram`-byte strings in it, and
consecutive windows with the same anchor are a block. Equal windows have equal anchors at the same
place, so blocks whose anchor occurs once are done. Blocks of equal content are settled by a count.
What is left of an anchor's different blocks goes into one group, whose window starts are put in
suffix order; the previous and next smaller positions in that order give the longest earlier match
of each window, previous and next larger ones the longest later match. A group too large for
one task is cut by ranges of offsets to the anchor and the bytes that all windows of a range share,
until its parts are small enough.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .blocks import PIECE_BITS, blocks_of, byte_column
from .common import keyed, maybe_in, membership, steps, stored
from .passages import repeated_words

LENGTH = 400
#: Bytes of the strings that anchors are chosen from, as a share of the length.
GRAM = 0.7
#: Different blocks in a group that one task puts in suffix order.
GROUP = 256


def all_blocks(rows, length, gram):
    """(g, c, t, start, n, o): the blocks of each different text t; a partition gives each text once."""

    def run(batches):
        seen = set()
        piece = 1 << PIECE_BITS
        for batch in batches:
            fresh = [i for i, x in enumerate(batch.column(0).to_pylist()) if not (x in seen or seen.add(x))]
            t, data_of = (batch.column(c).take(pa.array(fresh, pa.int64())) for c in (0, 1))
            data, offsets = byte_column(data_of)
            for a, b in steps(np.diff(offsets).tolist(), piece):
                part, inner = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for begin in range(0, max(1, len(part)), piece if b - a == 1 else len(part) + 1):
                    end = min(len(part), begin + piece + length - 1) if b - a == 1 else len(part)
                    own = inner if b - a > 1 else np.array([0, end - begin])
                    text, start, n, o, g, c = blocks_of(part[begin:end], own, length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), t.take(pa.array(a + text)), *map(pa.array, (start + begin, n, o))], ["g", "c", "t", "start", "n", "o"])

    return rows.mapInArrow(run, "g long, c long, t binary, start long, n long, o long")


def neighbours(order, lcp, smaller=True):
    """Longest match of each suffix with one at a smaller (larger) position.

    order: positions in suffix order; lcp[i]: common prefix of the suffixes order[i - 1], order[i].
    In suffix order, the nearest smaller positions before and after a suffix share the longest
    prefix with it among all smaller ones; a stack of increasing positions finds both in one pass.
    """
    out = [0] * len(order)
    stack, top = [], -1  # (position, common prefix with the entry below it); the last position
    flip = 0 if smaller else -1
    for p, common in zip(order, lcp):
        while stack and top ^ flip > p ^ flip:
            q, below = stack.pop()
            if below > common:  # before it: the entry below; after it: the one that removes it
                out[q] = below
            else:
                out[q], common = common, below
            top = stack[-1][0] if stack else -1
        stack.append((p, common if stack else 0))
        top = p
    for q, below in stack:
        out[q] = below
    return np.array(out, np.int64)


def suffix_order(data, positions, length):
    """(order, lcp) of the windows at `positions`, cut at `length`, as neighbours() takes them; equal ones keep their order."""
    keys = [data[p : p + length] for p in positions]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lcp = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1024):
        some = [keys[k] for k in order[i - 1 : i + 1024]]
        size = np.array([len(key) for key in some])
        rows = np.frombuffer(b"".join(some if size.min() == length else [key.ljust(length, b"\0") for key in some]), np.uint8).reshape(-1, length)
        differ = rows[1:] != rows[:-1]
        first = differ.argmax(1)
        first[~differ[np.arange(len(first)), first]] = length
        lcp[i : i + 1024] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return order, lcp.tolist()


def factors(data, positions, length):
    """(longest previous factor, longest next factor) of the windows at `positions`, cut at `length`."""
    order, lcp = suffix_order(data, positions, length)
    return neighbours(order, lcp), neighbours(order, lcp, smaller=False)


def group_runs(length, keep):
    """Runs of window starts to remove, from the different blocks of groups that lie one behind the other, for mapInArrow."""

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("g", "t", "start", "n", "done", "bytes"))))
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["t", "a", "b"])
        out = ([], [], [])
        for _, found in groupby(rows, itemgetter(0)):
            _, t, start, n, done, parts = zip(*found)
            positions, end = [], 0
            for x in n:
                positions += range(end, end + x)
                end += x - 1 + length
            order, lcp = suffix_order(b"".join(parts), positions, length)
            gone = neighbours(order, lcp) >= length
            if keep == "none":  # the first of equal ones stands before the second
                gone[np.array(order)[:-1][np.array(lcp[1:]) >= length]] = True
            at = 0
            for ti, s, x, finished in zip(t, start, n, done):
                if not finished:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[at : at + x].astype(np.int8), [0]])))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        for column, v in zip(out, (ti, s + a, s + b - 1)):
                            column.append(v)
                at += x
            if len(out[0]) >= 1 << 13:
                yield table(out)
                out = ([], [], [])
        yield table(out)

    return run


def cut(rows, length, bits):
    """Blocks cut into ranges of 2**bits offsets to the anchor; a range's group is the bytes that all its windows share."""
    digest = lambda *parts: int.from_bytes(hashlib.blake2b(b"|".join(parts), digest_size=8).digest(), "little", signed=True)

    def run(batches):
        for batch in batches:
            out = []
            for g, d, t, start, n, o, done, data in zip(*(batch[c].to_pylist() for c in ("g", "d", "t", "start", "n", "o", "done", "bytes"))):
                for q in range(o - n + 1 >> bits, (o >> bits) + 1):
                    low, high = max(q << bits, o - n + 1), min((q + 1 << bits) - 1, o)
                    part = data[o - high : o - low + length]
                    core = part[high - (q << bits) : high - (q + 1 << bits) + 1 + length]
                    group = digest(b"%d %d %d" % (g, q, bits), core)
                    out.append((group, digest(b"%d %d" % (group, high), part), d, t, start + o - high, high - low + 1, high, done, part))
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.binary() if k == 3 else pa.int64() for k in range(7)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:7], kinds), pa.array(columns[7], pa.bool_()), pa.array(columns[8], pa.binary())], ["g", "c", "d", "t", "start", "n", "o", "done", "bytes"])

    return rows.mapInArrow(run, "g long, c long, d long, t binary, start long, n long, o long, done boolean, bytes binary")


def settled(rows, keep):
    """(runs of blocks that occur elsewhere, one block of each content where a group has several)."""
    order = F.struct("d", "t", "start")
    each = stored(rows.groupBy("g", "c").agg(F.min(order).alias("low"), F.max(order).alias("high")))
    sizes = stored(each.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"))
    rows = rows.join(each, ["g", "c"])
    again = F.col("low") < F.col("high") if keep == "none" else order > F.col("low")
    runs = rows.where(~F.col("done") & again).select("t", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1).alias("b"))
    if keep == "none":
        rows = rows.withColumn("done", F.col("done") | again)
    left = rows.where(order == F.col("low")).dropDuplicates(["g", "c"]).join(sizes, "g")
    return runs, left.drop("low", "high", "c")


def remove_repeats(docs, length=LENGTH, keep="first", id_col="doc_id", text_col="text", group=GROUP, gram=None, words=None):
    """One row per row of docs: n_bytes, n_removed, n_spans (long) and kept, the bytes that stay.
    With words also n_repeated_words (long): the words under runs of so many words that another row
    has too, however few bytes those have; nothing is removed for that.

    A byte is removed if it is covered by a string of `length` bytes (of the text in UTF-8) that
    also starts elsewhere, in any document: at an earlier place (by id, then text, then position)
    with keep="first", anywhere with keep="none". Strings are judged on the input and may overlap;
    none crosses documents. Null and empty texts have no bytes. Equal texts count as copies of each
    other unless their ids are equal too and keep is "first"; null ids come first. An empty table
    gives an empty result; other columns are not read. A text of any length is read whole. Texts
    are told apart by MD5, anchors and contents of blocks by 62-bit hashes, what is left in groups
    byte by byte.
    """
    gram = gram or max(1, int(length * GRAM))
    rows = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"t": F.unhex(F.md5("text")), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))})
    long_ = F.octet_length("text") >= length
    enough = F.octet_length("text") >= min(length, 2 * words - 1) if words else long_
    different = stored(rows.where(enough).groupBy("t").agg(F.min("d").alias("first"), F.count("*").alias("copies"), F.min(F.octet_length("text")).cast("long").alias("size")))

    blocks = stored(all_blocks(rows.where(long_).select("t", "text"), length, gram))
    place = F.xxhash64("t", "start")
    anchors = stored(blocks.groupBy("g").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("g"))
    shared = blocks.join(anchors, "g", "left_semi").join(different.select("t", F.col("first").alias("d")), "t")
    shared = stored(shared.select("g", "c", "d", "t", "start", "n", "o", F.lit(False).alias("done")), cut=[blocks])

    runs, left = settled(shared, keep)
    left = stored(left)
    runs = [runs]
    lists = left.groupBy("t").agg(F.collect_list(F.struct("g", "d", "start", "n", "o", "done", "m")).alias("blocks"))
    some = maybe_in(rows.where(long_).select("t", "text"), "t", membership(left, "t")).where("maybe").select("t", "text")
    some = some.groupBy("t").agg(F.first("text").alias("text")).join(lists, "t")

    def with_bytes(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                t, data, own = (batch.column(c)[i] for c in range(3))
                data, own = memoryview(data.cast(pa.binary()).as_buffer()), own.values
                parts = [data[s : s + n - 1 + length].tobytes() for s, n in zip(own.field("start").to_pylist(), own.field("n").to_pylist())]
                names = ["g", "d", "start", "n", "o", "done", "m"]
                yield pa.RecordBatch.from_arrays([*(own.field(c) for c in names), pa.array([t.as_py()] * len(parts), pa.binary()), pa.array(parts, pa.binary())], [*names, "t", "bytes"])

    left = stored(some.mapInArrow(with_bytes, "g long, d long, start long, n long, o long, done boolean, m long, t binary, bytes binary"))
    bits = (length - gram).bit_length()
    while True:
        small = left.where(F.col("m") <= group).select("g", "d", "t", "start", "n", "done", "bytes").repartition("g").sortWithinPartitions("g", "d", "t", "start")
        runs.append(small.mapInArrow(group_runs(length, keep), "t binary, a long, b long"))
        large = left.where(F.col("m") > group)
        bits -= 1
        if bits < 0 or large.isEmpty():
            break
        more, left = settled(stored(cut(large, length, bits)), keep)
        runs.append(more)
        left = stored(left)

    every = runs[0]
    for more in runs[1:]:
        every = every.union(more)
    if keep == "none":
        every = every.union(different.where((F.col("copies") > 1) & (F.col("size") >= length)).select("t", F.lit(0).cast("long"), F.col("size") - length))
    every = every.groupBy("t").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("runs"))
    first = different.select("t", "first") if keep == "none" else different.where("copies > 1").select("t", "first")
    every = every.join(first, "t", "full" if keep == "first" else "left")
    if words:
        twice = different.where("copies > 1").select("t", F.lit(True).alias("twice"))
        every = every.join(repeated_words(rows, words), "t", "full").join(twice, "t", "full")
    every = stored(every)

    def finish(batches):
        for batch in batches:
            kept, removed, spans, size, repeated = [], [], [], [], []
            for text, runs, copy, n, twice in zip(batch["text"].cast(pa.binary()), *(batch[c].to_pylist() for c in ("runs", "copy", "n_repeated_words", "twice"))):
                data = memoryview(text.as_buffer())
                parts, at, gone, count, end = [], 0, 0, 0, -1
                whole = [{"a": 0, "b": len(data) - length}] if copy and len(data) >= length else runs or []
                for r in whole:
                    a, b = r["a"], r["b"] + length
                    if a > end:
                        count += 1
                        parts.append(data[at:a])
                        gone += b - a
                    else:
                        gone += max(0, b - end)
                    end = at = max(end, b)
                parts.append(data[at:])
                if twice:
                    n = len(bytes(data).split())
                    n = n if n >= words else 0
                for column, v in zip((kept, removed, spans, size, repeated), (b"".join(parts), gone, count, len(data), n or 0)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(kept, pa.binary()), pa.array(repeated, pa.int64())], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeated_words"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = maybe_in(rows, "t", membership(every, "t"))
    touched = rows.where("maybe").join(every, "t", "left").withColumn("copy", F.lit(keep == "first") & F.coalesce(F.col("d") > F.col("first"), F.lit(False)))
    zero = F.lit(0).cast("long")
    if not words:
        touched = touched.withColumns({"n_repeated_words": zero, "twice": F.lit(False)})
    touched = touched.select("doc_id", "text", "runs", "copy", "n_repeated_words", "twice").mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_repeated_words long")
    clean = rows.where("NOT maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), zero.alias("n_repeated_words"))
    out = clean.union(touched).withColumnRenamed("doc_id", id_col)
    return out if words else out.drop("n_repeated_words")
