"""Ranked lexical search by best-first branch and bound over trees of maxima.

The occurrences of the queries' terms are kept in ranges of documents. Within a range each term has a
tree over the documents: a leaf is what the term adds at most to one document's score, a node the
greatest of its children. A query's bound for a node is the sum over its terms; the node with the highest
bound is opened first, and the search of a range ends when no bound can reach the twentieth score found
so far. Of nodes with an equal bound, those that hold a smaller id than the twentieth are still opened.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import STEP, batched, remove, stored

#: Fixed values of the score: steps of the weight, share of the length, saturation.
SCALE, SHARE, FULL, SATURATION, ONE = 1000, 25, 100, 12, 1_000_000_000
#: Documents of a range, children of a node, cells of a range's leaves at most.
RANGE, FANOUT, CELLS = 1024, 16, 1 << 23
#: Terms of the queries of a block, about; each block reads the documents once.
BLOCK = 1 << 14
#: One range in so many is searched first, for scores that the others have to reach.
PROBE = 16
#: What separates terms is ASCII and neither digit nor letter; A to Z become lower case.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def counted(text, most=STEP):
    """Terms of a text (UTF-8 bytes) with their numbers, counted piece by piece."""
    text, at, found = text.translate(TABLE), 0, Counter()
    while len(text) - at > most:
        end = text.find(b" ", at + most)
        if end < 0:
            break
        found.update(text[at:end].split())
        at = end
    found.update(text[at:].split())
    return found


def weight(documents, holding):
    return math.floor(SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def rank_key(doc_id):
    """Ids in Spark's ascending order, null first."""
    return (doc_id is not None, doc_id)


class Trees:
    """The trees of a range: leaves[term] and above it the maxima of FANOUT children each."""

    def __init__(self, terms, docs, tf, ids, m):
        self.ids = ids
        self.terms, row = np.unique(terms, return_inverse=True)
        width = -(-max(1, len(ids)) // FANOUT) * FANOUT
        leaves = np.zeros((len(self.terms), width), np.int32)
        leaves[row, docs] = ONE * tf // (SCALE * tf + SATURATION * m[docs])
        order = sorted(range(len(ids)), key=lambda d: rank_key(ids[d]))
        place = np.full(width, len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.order, self.levels, self.least = order, [leaves], [place]
        while self.levels[-1].shape[1] > 1:
            below, first = self.levels[-1], self.least[-1]
            pad = -below.shape[1] % FANOUT
            if pad:
                below, first = np.pad(below, ((0, 0), (0, pad))), np.pad(first, (0, pad), constant_values=len(ids))
            self.levels.append(below.reshape(len(below), -1, FANOUT).max(2))
            self.least.append(first.reshape(-1, FANOUT).min(1))

    def search(self, terms, weights, found, k, least):
        """found, the best k (score, id) so far, with what this range adds; none below `least` is taken.
        weights are those of the query's terms, repeats summed."""
        at = np.searchsorted(self.terms, terms)
        at = np.minimum(at, max(0, len(self.terms) - 1))
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        rows, weights = at[here], weights[here]
        if not len(rows):
            return found
        top = len(self.levels) - 1
        levels, heap = [None] * (top + 1), []
        key = lambda n: rank_key(self.ids[self.order[n]])

        def push(level, a, b):
            if levels[level] is None:
                levels[level] = self.levels[level][rows]
            bounds = weights @ levels[level][:, a:b].astype(np.int64)
            low = max(least, found[-1][0] if len(found) == k else 1)
            for j in np.flatnonzero(bounds >= low):
                heapq.heappush(heap, (-int(bounds[j]), key(self.least[level][a + j]), level, a + int(j)))

        push(top, 0, self.levels[top].shape[1])
        while heap:
            bound, first, level, node = heapq.heappop(heap)
            if len(found) == k and (bound, first) >= (-found[-1][0], found[-1][1]):
                break
            if level:
                push(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(self.least[level - 1])))
            else:
                found = sorted([*found, (-bound, first)], key=lambda f: (-f[0], f[1]))[:k]
        return found


def ranges(numbers, kind):
    """A function of batches (id, text as bytes): one row per range of documents, with the occurrences
    of the terms in `numbers`, how many documents and terms there are, and how many documents hold each term."""
    size = max(FANOUT, min(RANGE, CELLS // max(1, len(numbers)) // FANOUT * FANOUT))
    names = ["ids", "lengths", "terms", "docs", "tf", "term", "held", "n_docs", "n_terms"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids), size):
                yield made(ids[a : a + size], texts[a : a + size], batch.schema.field(0).type)

    def made(ids, texts, of):
        kept, lengths, terms, docs, tf, n_docs, n_terms = [], [], [], [], [], 0, 0
        for doc_id, text in zip(ids, texts):
            every = counted(text.as_py() or b"")
            n = every.total()
            n_docs, n_terms = n_docs + (n > 0), n_terms + n
            mine = every.keys() & numbers.keys()
            if mine:
                terms += [numbers[t] for t in mine]
                tf += [every[t] for t in mine]
                docs += [len(kept)] * len(mine)
                kept.append(doc_id)
                lengths.append(n)
        term, held = np.unique(np.array(terms, np.int32), return_counts=True)
        lists = [pa.array([kept], pa.list_(of)), *(pa.array([x], pa.list_(t)) for x, t in ((lengths, pa.int64()), (terms, pa.int32()), (docs, pa.int32()), (tf, pa.int64()), (term, pa.int32()), (held, pa.int64())))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names)

    return run, f"ids array<{kind}>, lengths array<long>, terms array<int>, docs array<int>, tf array<long>, term array<int>, held array<long>, n_docs long, n_terms long"


def searcher(queries, documents, length, k, least):
    """A function of batches of ranges: (query, id, score) of the best k of each query in the partition
    that reach least[query]. queries: lists of terms and summed weights."""

    def run(batches):
        found, kind = [[] for _ in queries], None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                of = lambda c: batch.column(c)[r].values  # noqa: B023, E731
                m = FULL - SHARE + SHARE * of("lengths").to_numpy() * documents // max(1, length)
                trees = Trees(of("terms").to_numpy(), of("docs").to_numpy(), of("tf").to_numpy(), of("ids").to_pylist(), m)
                for q, (terms, weights) in enumerate(queries):
                    found[q] = trees.search(terms, weights, found[q], k, least[q])
        if kind is not None:
            rows = [(q, f[1][1], f[0]) for q, best in enumerate(found) for f in best]
            q, ids, scores = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return run


def best(rows, k):
    """The first k rows of each query; each task keeps k of its own before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs, queries, k=20, id_col="doc_id", text_col="text", query_id="item_id", query_text="text"):
    """(query_id, rank, doc_id, score): the k highest-scoring documents of each query, score above 0.

    Null and empty texts have no terms; a query without terms, or whose terms no document has, has no
    rows. Queries that agree in id and text (A-Z lower-cased) are one; those that only share an id (null included) are
    ranked each on its own. Repeated documents are documents of their own and come in any order among
    themselves; other equal scores by ascending id, null first. Empty tables give an empty result; other
    columns aren't read. Texts are counted whole, piece by piece. Queries are worked off in blocks of
    about BLOCK terms, whatever their number, each of which reads the documents once; a block's terms,
    and its k-th best scores so far, are collected and sent to all tasks. Documents aren't shuffled.
    """
    spark = docs.sparkSession
    kind, asked = docs.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType
    fold = F.translate(F.coalesce(F.col(query_text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = queries.select(F.col(query_id).alias("item"), fold.alias("t")).select("item", "t", F.regexp_count("t", F.lit(PATTERN)).alias("n")).where("n > 0").distinct()
    blocks = max(1, math.ceil((items.agg(F.sum("n")).first()[0] or 0) / BLOCK))
    items = stored(items.withColumn("block", F.pmod(F.xxhash64("item", "t"), F.lit(blocks))))
    texts = batched(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    result = None
    for block in range(blocks):
        mine = items.where(F.col("block") == block).orderBy("item", "t").select("item", "t").collect()
        if not mine:
            continue
        asked_terms = [counted(row.t.encode()) for row in mine]
        numbers = {t: i for i, t in enumerate(sorted(set().union(*asked_terms)))}
        rows = block_of(texts, kind, asked_terms, numbers, k)
        names = spark.createDataFrame([(q, row.item) for q, row in enumerate(mine)], f"query int, item {asked.simpleString()}")
        named = rows.join(F.broadcast(names), "query").select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")
        result = named if result is None else result.unionByName(named)
    remove(items)
    if result is None:
        result = spark.createDataFrame([], f"`{query_id}` {asked.simpleString()}, rank int, `{id_col}` {kind}, score long")
    return result


def block_of(texts, kind, asked, numbers, k):
    """(query, rank, doc_id, score) of a block of queries, given by their terms."""
    spark = texts.sparkSession
    index = stored(texts.mapInArrow(*ranges(numbers, kind)))
    documents, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("term", "held")).alias("x")).groupBy("x.term").agg(F.sum("x.held").alias("held"))
    weights = {r.term: weight(documents, r.held) for r in held.collect()}  # one row per term of the block
    queries = []
    for terms in asked:
        known = sorted((numbers[t], n * weights[numbers[t]]) for t, n in terms.items() if numbers[t] in weights)
        queries.append((np.array([t for t, _ in known], np.int32), np.array([w for _, w in known], np.int64)))
    some = F.pmod(F.xxhash64("ids", "lengths"), F.lit(PROBE)) == 0
    narrow = index.where(F.size("ids") > 0).select("ids", "lengths", "terms", "docs", "tf")
    schema = f"query int, doc_id {kind}, score long"
    first = best(narrow.where(some).mapInArrow(searcher(queries, documents, length, k, [1] * len(queries)), schema), k)
    least = [1] * len(queries)
    for r in first.where(F.col("rank") == k).select("query", "score").collect():  # one row per query of the block
        least[r.query] = r.score
    sent = spark.sparkContext.broadcast((queries, least))
    run = lambda batches: searcher(sent.value[0], documents, length, k, sent.value[1])(batches)
    return best(narrow.mapInArrow(run, schema), k)
