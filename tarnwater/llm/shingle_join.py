"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of hashes of its word shingles, in one global order: rare ones first, by
counts in a sketch of fixed size, then by hash. Two sets of Jaccard similarity t or more share at
least L elements among the first n - ceil(t n) + L of each; how far a document goes (its L) follows
from the candidates that its elements promise: where they promise many, a longer prefix asks for
correspondingly more shared elements before anything is verified.

Large groups of near copies make no pairs. Equal sets are one class. Each class is compared with a
hub, a central class among those it shares elements with, and kept as its difference to the hub.
Members that link with their hub are one component already; those that don't are compared with all
members, by their differences and in blocks, of which only a spanning forest leaves. Candidate
pairs are made between different hubs and components only. An element that many such classes have
makes no pairs by a join either: they are compared in blocks that carry their prefixes, and only
candidates that share enough elements leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import STEP, binary_keys, keyed, mixed, prefix_hashes, span_hashes, steps, stored
from .components import components
from .embedding_dedup import forest

#: Counters of the sketch, in blocks: one for 64 shingles, within these bounds (4 to 64 MB).
SKETCH_BITS, SKETCH_BLOCK = (20, 24), 256
#: Rows of a block of the sketch that one group sums.
SKETCH_GROUP = 1024
#: Longest multi-match, and what verifying a candidate costs in units of one shared element.
MOST, VERIFY = 4, 8
#: Buckets of the histogram that bounds an intersection from above.
HISTOGRAM = 256
#: A class is kept as its difference to a hub if they are at least so similar (in hundredths).
NEAR = 55
#: Members of a hub in one side of a block, and elements of their differences.
BLOCK, BLOCK_ELEMENTS = 512, 1 << 20
#: Classes with an element from which on they are compared in blocks, unless their prefixes are longer
#: than that on average, where carrying these would cost more than a join's pairs.
FREQUENT, LONG = 256, 2048
#: Entries of a dense matrix that one step makes.
DENSE = 1 << 22
#: Bits of the map that spares most documents a second look; a full map only saves less.
SEEN_BITS = 22


def sets_of(column, size):
    """(sorted set elements of all texts, where each text's begin) of an Arrow string column."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32))
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = word[inner]  # texts adjoin without a separator
    end[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h = span_hashes(prefix_hashes(data), begin, end)
    first = np.searchsorted(begin, offsets)  # of each text's words
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    start = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - start[:-1], n) + np.arange(start[-1])
    length = np.minimum(np.repeat(n_words, n), size)
    out = mixed(h[at] + np.uint64(1)) if len(at) else np.zeros(0, np.uint64)
    for k in range(1, size):
        more = np.flatnonzero(length > k)
        out[more] = mixed(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + k])
    kept = np.zeros(len(out), bool)
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        part = out[a:b]
        part.sort()
        kept[a:b] = True
        kept[a + 1 : b] = part[1:] != part[:-1]
    sizes = np.add.reduceat(np.append(kept, False).astype(np.int64), start[:-1]) if len(n) else np.zeros(0, np.int64)
    sizes[n == 0] = 0
    return out[kept], np.concatenate([[0], np.cumsum(sizes)])


def sliced(batch, size):
    """(part of the batch, its elements, where each text's begin), a quarter of a MB of text at a time."""
    column = batch.column(1).fill_null("")
    lengths = np.diff(np.frombuffer(column.cast(pa.large_string()).buffers()[1], np.int64)[: len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    for a, b in steps(lengths.tolist(), STEP // 4):
        yield batch.slice(a, b - a), *sets_of(column.slice(a, b - a), size)


def set_keys(elements, start):
    """A key of 128 bits of each set (zeros for an empty one), as an Arrow array: equal sets have equal keys."""
    halves = []
    for salt in (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(elements ^ np.uint64(salt)))])
        half = mixed(sums[start[1:]] - sums[start[:-1]] + np.diff(start).astype(np.uint64))
        half[np.diff(start) == 0] = 0
        halves.append(half)
    return binary_keys(*halves)


def sketch_bits(rows):
    """Bits of the sketch for these texts, from their bytes."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1
    return int(np.clip(np.ceil(np.log2(max(1, size / 6 / 64))), *SKETCH_BITS))


def described(rows, size, kind, bits):
    """Rows of two sorts: (doc_id, n, key, histogram) of each document, (block, counts) of the sketch.
    counts are of one, two or four bytes each, as they need."""
    names = ["doc_id", "n", "key", "histogram", "block", "counts"]

    def run(batches):
        sketch = np.zeros(1 << bits, np.uint32)
        schema = None
        for batch in batches:
            for part, elements, start in sliced(batch, size):
                np.add.at(sketch, (elements >> np.uint64(64 - bits)).astype(np.intp), np.uint32(1))
                n = np.diff(start)
                at = np.repeat(np.arange(len(n)), n) * HISTOGRAM + (elements & np.uint64(HISTOGRAM - 1)).astype(np.intp)
                counts = np.bincount(at, minlength=len(n) * HISTOGRAM).reshape(len(n), HISTOGRAM)
                fits = counts.max(1, initial=0) < 256  # beyond that there is no bound
                shapes = [c.tobytes() if f else None for c, f in zip(counts.astype(np.uint8), fits)]
                none = len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), set_keys(elements, start), pa.array(shapes, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
                schema = batch.schema.field(0).type
        if schema is not None:
            blocks = sketch.reshape(-1, SKETCH_BLOCK)
            some = np.flatnonzero(blocks.any(1))
            for part in np.array_split(some, len(some) // 4096 + 1):
                none = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(none, schema), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary()), pa.array(part, pa.int32()), pa.array([narrow(blocks[b]) for b in part], pa.binary())], names)

    return rows.mapInArrow(run, f"doc_id {kind}, n long, key binary, histogram binary, block int, counts binary")


def narrow(counts):
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(k).max)
    return counts.astype(kind).tobytes()


def wide(counts):
    return np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(counts) // SKETCH_BLOCK])


def summed_sketch(described_rows, bits):
    """The sketch of all documents, summed in Spark by block; where there are many partitions in two
    steps, so that no group holds a row of every one. Its size is bounded."""

    def add(found):
        total = np.zeros(SKETCH_BLOCK, np.uint64)
        for c in found["counts"]:
            total += wide(c.as_py())
        return pa.table({"block": found["block"][:1], "counts": pa.array([narrow(np.minimum(total, 0xFFFFFFFF))], pa.binary())})

    rows = described_rows.where("block IS NOT NULL").select("block", "counts")
    salts = -(-rows.count() * SKETCH_BLOCK >> bits) // SKETCH_GROUP + 1  # rows of a block, in groups of about that size
    if salts > 1:
        rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("block", "salt").applyInArrow(add, "block int, counts binary")
    rows = rows.groupBy("block").applyInArrow(add, "block int, counts binary")
    out = np.zeros((1 << bits) // SKETCH_BLOCK * SKETCH_BLOCK, np.uint32).reshape(-1, SKETCH_BLOCK)
    for r in rows.toLocalIterator():
        out[r.block] = wide(r.counts)
    return out.ravel()


def least_shared(n, percent):
    """Elements that a set of n shares with any set of that similarity."""
    return -(-n * percent // 100)


def prefixes(rows, sketch, size, percent):
    """(element, key, n, pos, most): the prefix of each different set; pos counts in the global order."""
    sent = rows.sparkSession.sparkContext.broadcast(sketch)
    bits = len(sketch).bit_length() - 1

    def run(batches):
        counts = sent.value
        noise = counts.mean()
        promised = np.maximum(0, counts - noise - 3 * np.sqrt(noise) - 1)
        seen = set()
        for batch in batches:
            for _, elements, start in sliced(batch, size):
                out = []
                for key, a, b in zip(set_keys(elements, start).to_pylist(), start[:-1].tolist(), start[1:].tolist()):
                    if a == b or key in seen:
                        continue
                    seen.add(key)
                    n = b - a
                    own = elements[a:b]
                    bucket = (own >> np.uint64(64 - bits)).astype(np.intp)
                    shared = least_shared(n, percent)
                    longest = min(n - shared + min(MOST, shared), n)
                    order = np.lexsort((own, counts[bucket]))[:longest]
                    upto = np.cumsum(promised[bucket[order]])
                    choices = range(1, min(MOST, shared) + 1)
                    # the elements to join, and the candidates that share so many of them
                    cost = [n - shared + m + VERIFY * upto[n - shared + m - 1] / m**2 for m in choices]
                    most = 1 + int(np.argmin(cost))
                    take = n - shared + most
                    out.append((own[order[:take]], key, n, most))
                if out:
                    takes = [len(o[0]) for o in out]
                    repeat = lambda k, kind: pa.array(np.repeat(np.array([o[k] for o in out], kind), takes))
                    pos = np.concatenate([np.arange(t, dtype=np.int32) for t in takes])
                    keys = pa.array([o[1] for o in out], pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), takes)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), keys, repeat(2, np.int64), pa.array(pos), repeat(3, np.int32)], ["element", "key", "n", "pos", "most"])

    return rows.mapInArrow(run, "element long, key binary, n long, pos int, most int")


class Verifier:
    """Sets of the classes that need them, fetched from the texts once for each list of pairs."""

    def __init__(self, rows, classes, size, percent):
        self.rows, self.classes, self.size, self.percent = rows, classes, size, percent

    def bounded(self, pairs, percent):
        """The pairs (a, b) whose histograms allow that similarity."""
        shape = lambda c: self.classes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("histogram").alias(f"h_{c}"))
        rows = pairs.join(shape("a"), "a").join(shape("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

        def run(batches):
            for batch in batches:
                hists = [batch[c].to_pylist() for c in ("h_a", "h_b")]
                possible = np.ones(batch.num_rows, bool)
                at = np.array([i for i, (x, y) in enumerate(zip(*hists)) if x is not None and y is not None], np.intp)
                for part in np.array_split(at, len(at) // 4096 + 1):
                    if len(part):
                        x, y = (np.frombuffer(b"".join(h[i] for i in part), np.uint8).reshape(-1, HISTOGRAM) for h in hists)
                        most = np.minimum(x, y).sum(1, dtype=np.int64)
                        total = sum(batch[c].to_numpy()[part].astype(np.int64) for c in ("n_a", "n_b"))
                        possible[part] = 100 * most >= percent * (total - most)
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(possible))

        return rows.mapInArrow(run, "a binary, b binary")

    def sets(self, keys):
        """(key, elements) of the classes in keys."""
        size = self.size
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SEEN_BITS))
        mine = keys.join(self.classes.select("key", "doc_id"), "key").select(slot.alias("slot"))
        seen = mine.groupBy(F.shiftright("slot", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
        some = self.rows.withColumn("slot", slot).withColumn("place", F.shiftright("slot", 6))
        some = some.join(F.broadcast(seen), "place").where("(shiftright(bits, cast(slot & 63 AS int)) & 1) = 1")  # 2**16 rows at most

        def run(batches):
            for batch in batches:
                for _, elements, start in sliced(batch, size):
                    lists = pa.LargeListArray.from_arrays(pa.array(start, pa.int64()), pa.array(elements.view(np.int64))).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([set_keys(elements, start), lists], ["key", "elements"])

        found = some.select("doc_id", "text").mapInArrow(run, "key binary, elements array<long>")
        return stored(found.join(keys, "key", "left_semi").dropDuplicates(["key"]))

    def __call__(self, pairs, percent):
        """(a, b, elements of a and of b) of the pairs that may be so similar; test with `similar`."""
        pairs = stored(self.bounded(pairs, percent))
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        sets = self.sets(keys)
        side = lambda c: sets.select(F.col("key").alias(c), F.col("elements").alias(f"e_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")


def similar(percent):
    shared = F.size(F.array_intersect("e_a", "e_b")).cast("long")
    return 100 * shared >= percent * (F.size("e_a") + F.size("e_b") - shared)


def products(values, owner, rows, columns, members):
    """How many values each pair of rows and columns (members) has in common. values, owner: flat
    lists of values and their members. The matrices are made a few values at a time."""
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    use = counts[place] > 1  # a value of one alone is shared with nobody
    place, owner = (np.cumsum(counts > 1) - 1)[place[use]], owner[use]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(rows), len(columns)), np.int64)
    width = max(1, DENSE // members)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (first, first + width))
        part = np.zeros((members, width), np.float32)
        part[owner[a:b], place[a:b] - first] = 1
        out += (part[rows] @ part[columns].T).astype(np.int64)
    return out


def hub_block(percent):
    """The links within one block of a hub's members, for groupBy().applyInArrow."""

    def run(found):
        found = found.sort_by("key").combine_chunks()
        side, other = found["i"][0].as_py(), found["j"][0].as_py()
        n, chunk, hub_n = (found[c].to_numpy() for c in ("n", "chunk", "hub_n"))
        lists = [found[c].combine_chunks() for c in ("gone", "new")]
        sizes = [x.value_lengths().to_numpy() for x in lists]
        values = np.concatenate([x.flatten().to_numpy() for x in lists])  # none is gone from one and new in another
        owner = np.concatenate([np.repeat(np.arange(len(n)), x) for x in sizes])
        rows = np.flatnonzero(chunk == side)
        columns = rows if side == other else np.flatnonzero(chunk == other)
        shared = hub_n[0] - sizes[0][rows, None].astype(np.int64) - sizes[0][columns] + products(values, owner, rows, columns, len(n))
        p, q = np.nonzero(100 * shared >= percent * (n[rows, None] + n[columns] - shared))
        p, q = rows[p], columns[q]
        root = forest(len(n), p, q)
        some = np.flatnonzero(root != np.arange(len(n)))
        return pa.table({"a": found["key"].take(pa.array(some)), "b": found["key"].take(pa.array(root[some]))})

    return run


def element_block(percent):
    """The candidates within one block of the classes that have an element, for groupBy().applyInArrow.
    A pair that has several such elements is taken in the block of the least."""

    def run(found):
        element, side, other = (found[c][0].as_py() for c in ("element", "i", "j"))
        n, most, chunk = (found[c].to_numpy() for c in ("n", "most", "chunk"))
        component, hub = (found[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("component", "hub"))
        prefix = found["prefix"].combine_chunks()
        owner = np.repeat(np.arange(len(n)), prefix.value_lengths().to_numpy())
        value, pos, frequent = (prefix.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("element", "pos", "frequent"))
        rows = np.flatnonzero(chunk == side)
        columns = rows if side == other else np.flatnonzero(chunk == other)
        a, b = rows[:, None], columns[None, :]
        shared = lambda use: products(value[use], owner[use], rows, columns, len(n))
        chosen = (component[a] != component[b]) & (hub[a] != hub[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        if side == other:
            chosen &= a < b
        if chosen.any():
            chosen &= shared(frequent & (value < element)) == 0
        lesser = np.minimum(most[a], most[b])
        after = pos - (n - least_shared(n, percent))[owner]
        enough = np.zeros(chosen.shape, bool)
        for m in np.unique(lesser[chosen]):
            enough |= (lesser == m) & (shared(after < m) >= m)
        p, q = np.nonzero(chosen & enough)
        key = found["key"].combine_chunks()
        return pa.table({"a": key.take(pa.array(rows[p])), "b": key.take(pa.array(columns[q]))})

    return run


def link(docs, size=4, percent=85, id_col="doc_id", text_col="text", block=BLOCK):
    """One row per row of docs: n_shingles and component_id.

    A text's set is that of its shingles of `size` words (A-Z lower-cased, parted by ASCII white
    space); one with fewer words is a single shingle; null and empty texts, and those of white
    space alone, have none and link with nothing. Two documents link when 100 * shared elements >=
    percent * all elements. component_id is the least id that links lead to. Rows that share an id
    count as one document where ids are concerned; a null id takes part, but names no component
    unless it is alone. An empty table gives an empty result; other columns are not read.
    Elements are told apart by 64-bit hashes, sets by keys of 128 bits. A text of any length is read whole.
    """
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    bits = sketch_bits(rows)
    found = stored(described(rows, size, kind, bits))
    sketch = summed_sketch(found, bits)
    members = found.where("block IS NULL").select("doc_id", "n", "key")
    # equal sets are one class
    classes = found.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("histogram").alias("histogram"))
    verify = Verifier(rows, classes, size, percent)

    # the elements of prefixes that several classes have
    prefix = prefixes(rows, sketch, size, percent)
    alike = Window.partitionBy("element")
    shared = prefix.withColumns({"low": F.min("key").over(alike), "high": F.max("key").over(alike), "count": F.count("*").over(alike)}).where("low < high")
    shared = stored(shared.drop("low", "high").dropDuplicates(["element", "key"]))

    # a hub for each class: of the classes with its most frequent element the most central one
    takes = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + F.col("most")
    central = shared.groupBy("key").agg((F.count("*") / F.first(takes)).alias("score"), F.max_by("element", F.struct("count", "element")).alias("top"))
    hubs = shared.join(central.select("key", "score"), "key").groupBy("element").agg(F.max_by("key", F.struct("score", "n", "key")).alias("hub"))
    first = stored(central.join(hubs.withColumnRenamed("element", "top"), "top").select("key", "hub"))
    second = first.join(first.select(F.col("key").alias("hub"), F.col("hub").alias("next")), "hub", "left")
    second = second.select("key", F.explode(F.array_distinct(F.array(F.struct(F.lit(1).alias("rank"), F.coalesce("next", "hub").alias("hub")), F.struct(F.lit(0).alias("rank"), F.col("hub").alias("hub"))))).alias("x")).select("key", "x.*")
    tried = second.where("key != hub").groupBy(F.col("key").alias("a"), F.col("hub").alias("b")).agg(F.max("rank").alias("rank"))
    tried = stored(tried)
    near = verify(tried.select("a", "b"), NEAR).where(similar(NEAR))
    near = near.select("a", "b", F.size("e_a").cast("long").alias("n"), F.size("e_b").cast("long").alias("hub_n"), F.array_except("e_b", "e_a").alias("gone"), F.array_except("e_a", "e_b").alias("new"))
    near = near.join(tried, ["a", "b"])
    best = stored(near.groupBy("a").agg(F.max_by(F.struct("b", "n", "hub_n", "gone", "new"), F.struct("rank", "b")).alias("x")).select(F.col("a").alias("key"), F.col("x.b").alias("hub"), "x.n", "x.hub_n", "x.gone", "x.new"))
    common = F.col("hub_n") - F.size("gone")
    best = best.withColumn("outside", 100 * common < percent * (F.col("n") + F.col("hub_n") - common))
    to_hub = best.where("NOT outside").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    # chunks of those outside come first; each is compared with itself, the later ones and all inside
    weight = (F.size("gone") + F.size("new")).cast("long")
    number = lambda which: F.ceil(F.greatest(F.count_if(which) / block, F.sum(F.when(which, weight).otherwise(0)) / BLOCK_ELEMENTS)).cast("int")
    chunks = best.groupBy("hub").agg(number(F.col("outside")).alias("outer"), F.greatest(F.lit(1), number(~F.col("outside"))).alias("inner")).where("outer > 0")
    some = best.join(chunks, "hub")
    none = F.array().cast("array<bigint>")
    itself = some.groupBy("hub", "outer", "inner").agg(F.first("hub_n").alias("hub_n"))
    itself = itself.select("hub", F.col("hub").alias("key"), F.col("hub_n").alias("n"), "hub_n", none.alias("gone"), none.alias("new"), F.lit(False).alias("outside"), "outer", "inner")
    place = F.when(F.col("outside"), F.pmod(F.xxhash64("key"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("key"), F.col("inner")))
    dealt = some.select(itself.columns).union(itself).withColumn("chunk", place.cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1 + F.when(F.col("outside"), F.col("inner")).otherwise(0))))
    dealt = dealt.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    within = dealt.select("hub", "i", "j", "chunk", "key", "n", "hub_n", "gone", "new").groupBy("hub", "i", "j").applyInArrow(hub_block(percent), "a binary, b binary")
    edges = stored(to_hub.union(within))

    # what is left: pairs between different hubs and components that share enough of their prefixes
    named = stored(components(edges))
    placed = shared.join(named.select(F.col("node").alias("key"), "component"), "key", "left").join(best.select("key", "hub"), "key", "left")
    placed = placed.select("element", "key", "n", "pos", "most", F.coalesce("component", "key").alias("component"), F.coalesce("hub", "key").alias("hub"))
    mixed_ = placed.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("hub").alias("low_hub"), F.max("hub").alias("high_hub"), F.count("*").alias("rows"), F.sum(takes).alias("elements")).where("low < high AND low_hub < high_hub")
    frequent = (F.col("rows") >= FREQUENT) & (F.col("elements") <= F.col("rows") * LONG)
    parts = F.ceil(F.greatest(F.col("rows") / block, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    placed = stored(placed.join(mixed_.select("element", frequent.alias("frequent"), parts.alias("chunks")), "element"))
    side = lambda c: placed.where("NOT frequent").select("element", *(F.col(x).alias(f"{x}_{c}") for x in ("key", "n", "pos", "most", "component", "hub")))
    pairs = side("a").join(side("b"), "element").where("key_a < key_b AND component_a != component_b AND hub_a != hub_b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    most = F.least("most_a", "most_b")
    within = lambda c: F.col(f"pos_{c}") < F.col(f"n_{c}") - F.ceil(F.col(f"n_{c}") * percent / 100) + most
    pairs = pairs.where(within("a") & within("b")).groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(F.count("*").alias("c"), F.first(most).alias("most"), F.max("pos_a").alias("p"), F.max("pos_b").alias("q"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    # after the last shared element of the prefixes, at most the shorter rest is shared
    upper = F.col("c") + F.least(F.col("n_a") - F.col("p"), F.col("n_b") - F.col("q")) - 1
    pairs = pairs.where(F.col("c") >= F.col("most")).where(100 * upper >= percent * (F.col("n_a") + F.col("n_b") - upper)).select("a", "b")
    # classes with a frequent element: their prefixes go along, so that a block settles a pair as a whole
    often = placed.where("frequent")
    whole = placed.join(often.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("element", "pos", "frequent")).alias("prefix"))
    often = often.drop("pos").join(whole, "key").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    often = often.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    often = often.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    often = often.select("element", "i", "j", "chunk", "key", "n", "most", "component", "hub", "prefix")
    settled = often.groupBy("element", "i", "j").applyInArrow(element_block(percent), "a binary, b binary")
    pairs = pairs.union(settled.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    further = verify(stored(pairs), percent).where(similar(percent)).select("a", "b")
    named = components(edges.union(further))

    own = members.join(named.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = own.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = own.join(least, "component", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumnRenamed("doc_id", id_col)
