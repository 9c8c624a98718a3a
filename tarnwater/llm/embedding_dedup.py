"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors of a label are one class with a count. Each class falls into one bucket of every
table by the signs of its products with random hyperplanes. The cosines within a bucket are taken
as matrix products, in blocks; a pair counts in the first table that brings it together. What
leaves a block is a number of links for each class and a spanning forest, never the pairs. Buckets
are large, as products are cheap and each table costs a copy of every vector in the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Expected share of the pairs exactly at the threshold that some table brings together.
RECALL = 0.998
#: Classes wanted in a bucket, and on average in one side of a block at most.
BUCKET, BLOCK = 2048, 4096
#: Cosines that are held at once.
CELLS = 1 << 20


def plan(largest, threshold, recall=RECALL, bucket=BUCKET):
    """(bits, tables) for labels of up to `largest` classes: buckets keep their size as labels
    grow, and the number of tables is what the recall at the threshold takes."""
    bits = max(2, min(30, math.ceil(math.log2(max(1, largest) / bucket))))
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def signs(vectors, bits, tables, seed=7):
    """For each vector its key in every table."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    bit = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return bit @ (1 << np.arange(bits))


def unit(vectors):
    """Rows of length 1 in double precision, however large or small their components."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def matrix(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def forest(n, i, j):
    """The least index reachable from each of n nodes over the edges i, j."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        old = root.copy()
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == old).all():
            return root


def block(threshold):
    """The links that one block adds, for groupBy().applyInArrow."""

    def run(found):
        table, side, other = (found[c][0].as_py() for c in ("table", "i", "j"))
        n = len(found)
        cls, m, chunk = (found[c].to_numpy() for c in ("cls", "m", "chunk"))
        vectors, keys = unit(matrix(found["vector"])), matrix(found["keys"]) if table else None
        rows = np.flatnonzero(chunk == side)
        columns = rows if side == other else np.flatnonzero(chunk == other)
        links, root = np.zeros(n, np.int64), np.arange(n)
        step = max(1, CELLS // max(1, len(columns)))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            p, q = np.nonzero(vectors[some] @ vectors[columns].T >= threshold)
            p, q = some[p], columns[q]
            new = p < q if side == other else np.ones(len(p), bool)
            for t in range(table):
                new[new] = keys[p[new], t] != keys[q[new], t]
            p, q = p[new], q[new]
            np.add.at(links, p, m[q])
            np.add.at(links, q, m[p])
            root = forest(n, np.concatenate([p, np.arange(n)]), np.concatenate([q, root]))
        some = links > 0
        return pa.table({"cls": cls[some], "links": links[some], "root": cls[root[some]]})

    return run


def link(vectors, threshold=0.93, id_col="vec_id", vector_col="embedding", label_col="label", recall=RECALL, bucket=BUCKET, block_size=BLOCK):
    """One row per row of vectors: n_links, component_id and kept.

    Only vectors of one label and dimension are compared. Null labels and vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing and stand alone. Every
    row counts as a vector of its own, rows that repeat an id (with the same vector or another)
    included; a null id is no component's least unless all are null. A pair at the threshold is
    found with probability `recall`, a closer one more surely; none below it is linked. An empty
    table gives an empty result; other columns are not read. Vectors are told apart by themselves,
    and find their class again by 128 bits of hashes.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    hashes = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "label", "vector").alias("h2")]
    alike = rows.where(sound).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = stored(alike.select(F.monotonically_increasing_id().alias("cls"), "*", *hashes))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, recall, bucket)

    def keyed(batches):
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), np.int64)
            size = batch["vector"].value_lengths().to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                keys[at] = signs(unit(matrix(batch["vector"].take(pa.array(at)))), bits, tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "keys"])

    given = classes.select("cls", "label", "vector", "m")
    dealt = given.mapInArrow(keyed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema) + ", keys array<int>")
    dealt = dealt.select("*", F.posexplode("keys").alias("table", "key"))
    # the keys of earlier tables go along, for pairs that these have brought together
    places = ["label", "d", "table", "key"]
    dealt = dealt.select("label", F.size("vector").alias("d"), "table", "key", "cls", "m", "vector", F.slice("keys", F.lit(1), F.col("table")).alias("keys"))
    # a bucket of more than block_size classes is cut into chunks, and each pair of chunks is a block
    sizes = dealt.groupBy(*places).agg(F.ceil(F.count("*") / block_size).cast("int").alias("chunks")).where("chunks > 1")
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = dealt.join(sizes, places, "left").withColumn("chunk", F.pmod(F.xxhash64("cls"), chunks).cast("int"))
    blocks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    blocks = blocks.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other", "chunks")
    found = stored(blocks.groupBy(*places, "i", "j").applyInArrow(block(threshold), "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.drop("label", "vector").join(links, "cls", "left").join(named.select(F.col("node").alias("cls"), "component"), "cls", "left")
    named = stored(named.select("h1", "h2", "rep", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"))
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component", "left").select("h1", "h2", "n_links", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    linked = rows.where(sound).select("vec_id", *hashes).join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone).withColumn("component_id", F.col("component_id").cast("long"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("vec_id", id_col)
