"""Runs of words that stand in another document too: windows of words by their hashes, as blocks under an anchor.

Every window of `words` words has an anchor, the least hash of the GRAM words strings in it, and consecutive
windows with the same anchor are a block, see blocks.py. An anchor of one text only is done. A block
whose content another text has is repeated as a whole; of an anchor's other blocks each window is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .blocks import blocks_of, byte_column
from .common import maybe_in, membership, mixed, steps, stored

#: Words of the strings that anchors are chosen from, as a share of the window.
GRAM = 0.2
#: Words are hashed so many bytes at a time, windows so many words at a time.
PIECE = 1 << 18
WORDS = 1 << 17
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: What a byte at one of a word's first places adds to its hash.
NEAR = 64
ADDS = mixed(np.arange(NEAR << 8, dtype=np.uint64))
#: An odd base; its powers and those of its inverse, modulo 2**64, are kept.
BASE = 0x9E3779B97F4A7C15
POWERS = [np.ones(1, np.uint64)] * 2


def word_hashes(data, offsets):
    """(hash of each word, first word of each text and the end) for the texts data[offsets[i]:offsets[i + 1]].

    A word is a run of bytes other than space and \\x09 to \\x0d. Its hash sums one mixed number for each
    place and byte, so that a word may be cut between pieces.
    """
    at_, sums_ = [], []
    start, ended = 0, True
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        space = SPACE[part]
        after = np.concatenate([[ended], space[:-1]])
        after[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(part))] - a] = True
        begin = after & ~space
        at = np.flatnonzero(begin)
        place = np.arange(len(part)) - np.concatenate([[start - a], at])[np.cumsum(begin)]
        key = place << 8 | part
        adds = ADDS[np.minimum(key, len(ADDS) - 1)]
        far = np.flatnonzero((place >= NEAR) & ~space)
        adds[far] = mixed(key[far])
        adds[space] = 0
        if at_:
            sums_[-1][-1:] += adds[: at[0] if len(at) else None].sum()
        if len(at):
            at_.append(at + a)
            sums_.append(np.add.reduceat(adds, at))
            start = a + at[-1]
        ended = space[-1]
    if not at_:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return mixed(np.concatenate(sums_)), np.searchsorted(np.concatenate(at_), offsets)


def word_spans(values):
    """A function of the hashes of spans [i, j) of words. (Spans are short: modulo 2**64, only strings of 1024 and more
    of the Thue-Morse kind are known to collide.)"""
    if len(POWERS[0]) <= len(values):
        size = max(2 * len(POWERS[0]), len(values) + 1)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            POWERS[k] = np.cumprod(np.append(np.uint64(1), np.full(size, b, np.uint64)))
    up, down = POWERS
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return lambda i, j: mixed((sums[j] - sums[i]) * down[i] ^ np.asarray(j - i).astype(np.uint64))


def all_blocks(rows, words, gram):
    """(g, c, t, start, n): the blocks of each different text t, in words; a partition gives each text once."""

    def run(batches):
        seen = set()
        for batch in batches:
            fresh = [i for i, x in enumerate(batch.column(0).to_pylist()) if not (x in seen or seen.add(x))]
            t, texts = (batch.column(c).take(pa.array(fresh, pa.int64())) for c in (0, 1))
            values, first = word_hashes(*byte_column(texts))
            for a, b in steps(np.diff(first).tolist(), WORDS):
                for begin in range(first[a], first[b], WORDS if b - a == 1 else first[b] - first[a] + 1):
                    end = min(first[b], begin + WORDS + words - 1) if b - a == 1 else first[b]
                    own = first[a : b + 1] - begin if b - a > 1 else np.array([0, end - begin])
                    part = values[begin:end]
                    text, start, n, _, g, c = blocks_of(part, own, words, gram, word_spans(part))
                    if b - a == 1:
                        start = start + begin - first[a]
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), t.take(pa.array(a + text)), pa.array(start), pa.array(n)], ["g", "c", "t", "start", "n"])

    return rows.mapInArrow(run, "g long, c long, t binary, start long, n long")


def windows(rows, words):
    """(h, low, high, done, t, a): each window of the listed blocks of a text."""

    def run(batches):
        for batch in batches:
            t, texts, own = (batch.column(k) for k in range(3))
            values, first = word_hashes(*byte_column(texts))
            block = own.flatten()
            start, n, low, high, done = (block.field(k) for k in ("start", "n", "low", "high", "done"))
            text = np.repeat(np.arange(len(t)), own.value_lengths().to_numpy())
            n = n.to_numpy()
            which = pa.array(np.repeat(np.arange(len(n)), n))
            a = np.repeat(start.to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = a + np.repeat(first[text], n)
            h = word_spans(values)(at, at + words)
            columns = [pa.array(h.view(np.int64)), low.take(which), high.take(which), done.take(which), t.take(pa.array(text)).take(which), pa.array(a)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "low", "high", "done", "t", "a"])

    return rows.mapInArrow(run, "h long, low long, high long, done boolean, t binary, a long")


def covered(runs, words):
    """(t, n_repeated_words): words under the windows that begin at the runs [a, b] of each text."""

    def run(batches):
        for batch in batches:
            t, own = batch.column(0), batch.column(1)
            found = own.flatten()
            a, b = (found.field(k).to_numpy() for k in ("a", "b"))
            text = np.repeat(np.arange(len(t)), own.value_lengths().to_numpy())
            far = text * (b.max(initial=0) + words + 1)  # texts one behind the other
            order = np.argsort(a + far, kind="stable")
            a, end = (a + far)[order], np.maximum.accumulate((b + far)[order] + words)
            fresh = np.maximum(0, end - np.maximum(a, np.concatenate([[0], end[:-1]])))
            count = np.bincount(text[order], fresh, len(t)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([t, pa.array(count)], ["t", "n_repeated_words"])

    lists = runs.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return lists.mapInArrow(run, "t binary, n_repeated_words long")


def repeated_words(rows, words):
    """(t, n_repeated_words) of the texts with a run of `words` words that another text has too.

    rows: t, the key of a text, and text without nulls; copies of a text count as one here. Words are equal byte by
    byte, whatever stands between them. Windows and blocks are told apart by hashes of 64 bits.
    """
    rows = rows.where(F.octet_length("text") >= 2 * words - 1).select("t", "text")
    x = F.xxhash64("t")
    low, high = F.min(x).alias("low"), F.max(x).alias("high")
    blocks = stored(all_blocks(rows, words, max(1, int(words * GRAM))))
    anchors = stored(blocks.groupBy("g").agg(low, high).where("low < high").select("g"))
    shared = stored(blocks.join(anchors, "g", "left_semi"), cut=[blocks])
    each = stored(shared.groupBy("g", "c").agg(low, high))
    again = shared.join(each.where("low < high").select("g", "c"), ["g", "c"], "left_semi")
    whole = again.select("t", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1).alias("b"))

    several = each.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    left = shared.join(stored(each.join(several, "g", "left_semi")), ["g", "c"]).withColumn("done", F.col("low") < F.col("high"))
    left = stored(left.where(~F.col("done") | (x == F.col("low"))).select("t", "start", "n", "low", "high", "done"))
    lists = left.groupBy("t").agg(F.collect_list(F.struct("start", "n", "low", "high", "done")).alias("blocks"))
    some = maybe_in(rows, "t", membership(left, "t")).where("maybe").groupBy("t").agg(F.first("text").alias("text"))
    each = stored(windows(some.join(lists, "t").select("t", "text", "blocks"), words))
    again = each.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h")
    single = each.where("NOT done").join(again, "h", "left_semi").select("t", "a", F.col("a").alias("b"))
    return stored(covered(whole.union(single), words))
