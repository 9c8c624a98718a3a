"""Variable-capacity best-fit packing of documents into training sequences.

Only ids and lengths are packed. Rows are dealt by a hash of id and length into blocks of about equal
size, those that agree in both in lots of a few; within a block, pieces of decreasing length go into the fullest open bin that holds them, or
open the bin size of least cost for what it can be filled with. Which sizes may be opened is itself
optimised: the block is packed with every set of the smallest sizes, and the cheapest result stays.
At last each bin is downsized to the least permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import stored

#: Permitted sequence lengths, pieces in a block, and the length at which attention costs as much as the rest.
SIZES = (256, 512, 1024, 2048, 4096)
BLOCK = 2048
EVEN = 8192
#: Pieces of one id and length that are dealt together, at most.
LOT = 16


def price(size):
    """What a sequence costs to train on: linear layers and attention."""
    return size + size * size / EVEN


def best_fit(lengths, sizes, price=price):
    """(bin, offset) of each length, given in decreasing order, and [contents] of each bin."""
    open_, bins, room, places = [], [], [], []
    rest = int(sum(lengths))
    for n in lengths:
        k = bisect_left(open_, (n, -1))  # the least room that suffices, the earliest bin of these
        if k < len(open_):
            left, b = open_.pop(k)
        else:
            # what a new bin can come to hold is bounded by its size and by what is left to pack
            size = min((c for c in sizes if c >= n), key=lambda c: (price(c) / min(c, rest), -c))
            left, b = size, len(bins)
            bins.append(0)
            room.append(size)
        places.append((b, bins[b]))
        bins[b] += n
        if left > n:
            insort(open_, (left - n, b))
        rest -= n
    return places, bins


def pack_block(lengths, sizes=SIZES, price=price):
    """(bin, offset, capacity) of each of lengths (decreasing, none above the largest size)."""
    sizes = sorted(sizes)
    plans = []
    for k in range(len(sizes)):
        if lengths and lengths[0] > sizes[k]:
            continue
        places, bins = best_fit(lengths, sizes[: k + 1], price)
        capacity = [sizes[bisect_left(sizes, n)] for n in bins]
        plans.append((sum(map(price, capacity)), places, capacity))
    _, places, capacity = min(plans, key=lambda p: p[0])
    return [(b, offset, capacity[b]) for b, offset in places]


def words(text_col="text"):
    """Length of a text in words, over the whole of it."""
    return F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))


def pack(docs, length=None, id_col="doc_id", sizes=SIZES, block=BLOCK):
    """One row per piece: doc_id, piece, start, length, bin_id, capacity, bin_offset.

    A document longer than the largest size is cut into pieces of that size and a last one. A null
    or empty one (length null or 0) is in the result with no bin. Repeated rows are packed each on
    its own; an empty table gives an empty result; other columns are not read. length: a column of
    lengths (words of `text` by default).
    """
    top = max(sizes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce((words() if length is None else length).cast("long"), F.lit(0)).alias("n"))
    rows = stored(rows)
    some = rows.where("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / top) - 1).cast("int"))))
    some = some.withColumn("start", F.col("piece").cast("long") * top).withColumn("length", F.least(F.lit(top).cast("long"), F.col("n") - F.col("start")))
    blocks = max(1, round(some.count() / block))
    # pieces that agree in all are counted, and dealt in small lots, so no id fills a block
    alike = some.groupBy("doc_id", "piece", "start", "length").agg(F.count("*").alias("n"))
    lots = alike.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    lots = lots.withColumn("copies", F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT))
    some = lots.select(F.pmod(F.xxhash64("doc_id", "piece", "length", "lot"), F.lit(blocks)).alias("block"), "doc_id", "piece", "start", "length", "copies")

    def run(found):
        found = found.take(np.repeat(np.arange(len(found)), found["copies"].to_numpy()))
        order = [(f, "descending" if f == "length" else "ascending") for f in ("length", "doc_id", "piece")]
        found = found.sort_by(order)
        placed = pack_block(found["length"].to_pylist(), sizes)
        b, offset, capacity = (np.array(x, np.int64) for x in zip(*placed))
        first = found["block"][0].as_py() << 32
        return pa.table({**{c: found[c] for c in ("doc_id", "piece", "start", "length")}, "bin_id": first + b, "capacity": capacity, "bin_offset": offset})

    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = some.groupBy("block").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, bin_id long, capacity long, bin_offset long")
    none = F.lit(None).cast("long")
    empty = rows.where("n <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), none.alias("bin_id"), none.alias("capacity"), none.alias("bin_offset"))
    return packed.union(empty).withColumnRenamed("doc_id", id_col)
