"""What the operators share: tables, written intermediate results, batches, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Characters (or bytes) that one numpy step works on, to bound a worker's memory.
STEP = 1 << 20
#: Bytes of a batch of texts that goes to a Python worker; Spark's default of 64 MB is held several
#: times over, in the executor and in the worker.
BATCH_BYTES = 8 << 20


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark):
    """A new folder in the one that driver and executors share, spark.checkpoint.dir. Only in local
    mode, where all run on one machine, a temporary one will do where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tarnwater-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def stored(df, cut=None):
    """df, written as Parquet in the shared folder and read again: a lost executor costs no
    recomputation beyond it. cut: earlier results to delete, which df alone has read."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    for old in cut or []:
        remove(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(df):
    """Delete what stored() wrote for df."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def steps(sizes, most=STEP):
    """Ranges (a, b) over consecutive items whose sizes sum to about `most`; a large item stands alone."""
    a = total = 0
    sizes = list(sizes)
    for b, n in enumerate(sizes):
        if total and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def texts(batch, column=1):
    """The texts of an Arrow batch, null as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def mixed(x):
    """A bijection of uint64 arrays that spreads every bit over all others (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Two primes and bases; each polynomial hash is taken modulo both, which makes 62 bits. (Modulo a
#: power of two, strings of the Thue-Morse kind collide whatever the base.)
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003_919, 1_203_793_417)
POWERS = [[np.ones(1, np.uint32)] * 2 for _ in PRIMES]


def powers(k, n):
    """Powers of base k and of its inverse up to n, modulo its prime; they are kept."""
    p = PRIMES[k]
    if len(POWERS[k][0]) <= n:
        made = []
        for b in (BASES[k], pow(BASES[k], -1, p)):
            out = np.ones(1, np.uint64)
            while len(out) <= n:
                out = np.concatenate([out, out * np.uint64(pow(b, len(out), p)) % np.uint64(p)])
            made.append(out.astype(np.uint32))
        POWERS[k] = made
    return POWERS[k]


def prefix_hashes(values):
    """Prefix arrays of a string of small numbers, one for each prime: the span [i, j) has the hash
    (H[j] - H[i]) / base**i. Sums stay below 2**64 for up to 2**32 values."""
    out = []
    values = values.astype(np.uint64) + np.uint64(1)
    for k, p in enumerate(PRIMES):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(k, len(values))[0][: len(values)] % np.uint64(p), out=sums[1:])
        out.append(sums)
    return out


def spans(prefix, start, end):
    """Hashes of the spans [start, end) (numbers or arrays), each of 62 bits; equal spans have equal hashes."""
    parts = []
    for k, (sums, p) in enumerate(zip(prefix, PRIMES)):
        down = powers(k, len(sums))[1]
        parts.append((sums[end] - sums[start]) % np.uint64(p) * down[start] % np.uint64(p))
    return parts[0] << np.uint64(31) | parts[1]


def span_hashes(prefix, start, end):
    """The same together with the length, spread over 64 bits."""
    return mixed(spans(prefix, start, end) ^ (end - start).astype(np.uint64) << np.uint64(40))


def binary_keys(high, low):
    """An Arrow array of 16-byte keys from two arrays of 64-bit numbers."""
    data = np.stack([high, low], 1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(high), [None, pa.py_buffer(data)]).cast(pa.binary())


def batched(docs):
    """docs, with its session set to send batches of BATCH_BYTES to Python (unless it is set to less)."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not size or not 0 < int(size[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return docs


def keyed(docs, id_col, text_col):
    """The two columns that an operator on texts needs, whatever else docs has."""
    batched(docs)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def sampled(rows, most, id_col="doc_id"):
    """The rows of the `most` ids with the least hashes (a bounded sample for training); only ids
    are sorted, and that many ids are broadcast. Rows that share an id come or go together."""
    ids = rows.select(id_col).withColumn("_h", F.xxhash64(id_col)).orderBy("_h", id_col).limit(most).select(id_col).distinct()
    return rows.join(F.broadcast(ids), id_col, "left_semi")


def free_name(df, name):
    """name, with as many underscores after it as it takes to be no column of df (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a membership map: 512 KB, whatever the input. A fuller map only lets more rows pass.
MAP_BITS = 22


def membership(keys, col):
    """A map of the values of a long column, as a table of 2**16 rows at most."""
    slot = F.pmod(F.xxhash64(col), F.lit(1 << MAP_BITS))
    rows = keys.select(slot.alias("_slot"))
    return rows.groupBy(F.shiftright("_slot", 6).alias("_place")).agg(F.expr("bit_or(shiftleft(1L, cast(_slot & 63 AS int)))").alias("_bits"))


def maybe_in(df, col, members, flag="maybe"):
    """df with a flag that is true for every row whose col is in the map, and for few others."""
    slot, place, bits = (free_name(df, c) for c in ("_slot", "_place", "_bits"))
    members = members.select(F.col("_place").alias(place), F.col("_bits").alias(bits))
    rows = df.withColumn(slot, F.pmod(F.xxhash64(col), F.lit(1 << MAP_BITS))).withColumn(place, F.shiftright(slot, 6)).join(F.broadcast(members), place, "left")
    hit = F.expr(f"coalesce((shiftright(`{bits}`, cast(`{slot}` & 63 AS int)) & 1) = 1, false)")
    return rows.withColumn(flag, hit).drop(slot, place, bits)
