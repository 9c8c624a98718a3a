"""Bounded-space online packing of token ids into sequences of one capacity.

Documents are packed where they are read: a partition keeps a fixed number of open windows, puts each
document into the fullest one that still holds it, and emits the fullest when none does, topped up with
the head of the document at hand. What is left open at the end of a partition, a few windows, is merged
in rounds of bounded groups, and the last remainder is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import functions as F

from .bpe_codec import PLAIN, WHITE, codec_of
from .common import STEP, keyed, stored

#: Tokens of a sequence, open windows of a partition, partitions whose leftovers are merged at a time.
CAPACITY, WINDOWS, MERGED = 4096, 16, 64
#: Pretokens whose ids a worker keeps at most, about; beyond that the table starts anew.
KEPT = 1 << 19
#: The id that ends each document.
END = 2
#: Bits of a sequence's number within its group, and of the group's within its round.
WITHIN, GROUPS = 36, 24


class Windows:
    """Open windows; place() takes (doc_id, start, doc_tokens, ids as bytes) and returns what is full."""

    def __init__(self, first, capacity=CAPACITY, most=WINDOWS):
        self.next, self.capacity, self.most = first, capacity, most
        self.open = []  # [used, number, pieces]

    def place(self, doc_id, start, total, ids):
        full, ids = [], memoryview(ids)
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if self.capacity - w[0] >= n]
            if fits or len(self.open) == self.most:
                window = max(fits or self.open, key=lambda w: w[0])
            else:
                window = [0, self.next, []]
                self.next += 1
                self.open.append(window)
            head = bytes(ids[: 4 * (self.capacity - window[0])])
            window[2].append((doc_id, start, total, head, window[1], window[0]))
            window[0] += len(head) // 4
            start, ids = start + len(head) // 4, ids[len(head) :]
            if window[0] == self.capacity:
                self.open.remove(window)
                full += window[2]
        return full

    def left(self):
        return [p for w in self.open for p in w[2]]

    def finish(self):
        """All that is still open, poured into one window after the other; of the last one, whose
        contents would have to be padded, as many sequences as it takes powers of two."""
        rest, self.open, self.most = self.left(), [], 1
        done = [p for doc_id, start, total, ids, *_ in rest for p in self.place(doc_id, start, total, ids)]
        rest, self.open = self.left(), []
        whole, n = self.capacity, sum(len(p[3]) // 4 for p in rest)
        for doc_id, start, total, ids, *_ in rest:
            while ids:
                if not self.open:
                    self.capacity = 1 << (n.bit_length() - 1)
                    n -= self.capacity
                    self.open = [[0, self.next, []]]
                    self.next += 1
                head = ids[: 4 * (self.capacity - self.open[0][0])]
                done += self.place(doc_id, start, total, head)
                start, ids = start + len(head) // 4, ids[len(head) :]
        self.capacity = whole
        return done


class Ids:
    """The ids of strings as bytes, little-endian. A text is split into pretokens as a whole; the ids of these are kept."""

    def __init__(self, codec):
        self.codec, self.memo = codec, {}
        self.plain = plain_split(codec.pretoken)

    def packed(self, ids):
        return struct.pack(f"<{len(ids)}I", *ids)

    def pretoken(self, p):
        codec = self.codec
        if len(p) > codec.leaf:
            return self.packed(codec.long(p))
        mapped = p if p.isascii() and p.isprintable() else "".join([codec.chars[b] for b in p.encode()])
        return self.packed([t.id for t in codec.final.model.tokenize(mapped)])

    def part(self, text):
        """The ids of a stretch of text without special tokens."""
        if PLAIN.search(text):
            found = self.codec.pretoken.findall(self.codec.library.normalizer.normalize_str(text))
        else:
            found = self.plain.findall(text.lower())
        new = set(found).difference(self.memo)
        self.memo.update((p, self.pretoken(p)) for p in new)
        out = b"".join(map(self.memo.__getitem__, found))
        for p in new:
            if len(p) > self.codec.leaf:  # rarely met again, and of any size
                del self.memo[p]
        return out

    def __call__(self, text):
        if len(self.memo) > KEPT:
            self.memo.clear()
        out = []
        for stretch in stretches(text):
            for k, part in enumerate(self.codec.special.split(stretch) if "<|" in stretch else [stretch]):
                out.append(self.packed([self.codec.special_id[part]]) if k % 2 else self.part(part))
        return b"".join(out)


def plain_split(pattern):
    """The split for texts whose characters are all below U+0250, with its classes written out, which is faster."""
    chars = sorted({x for c in range(0x250) for x in chr(c) + chr(c).lower()})  # lower case may lie beyond
    classes = {name: "".join(map(re.escape, filter(regex.compile(name).match, chars))) for name in (r"\p{L}", r"\p{N}", r"\s")}
    text = pattern.pattern
    for name, members in classes.items():
        text = text.replace(name, members)
    return re.compile(text) if "\\p" not in text else pattern


def stretches(text, most=STEP):
    """A text, a long one cut at white space: neither pretokens nor what they are normalized by reach across it."""
    at = 0
    while len(text) - at > most:
        space = WHITE.search(text, at + most)
        if not space:
            break
        yield text[at : space.end()]
        at = space.end()
    yield text[at:]


@lru_cache(maxsize=1)
def ids_of(text):
    """One table for all tasks of a worker."""
    return Ids(codec_of(text))


def pieces(rows, kind, left=()):
    """A batch of pieces; those that are left open carry their ids."""
    every = [*rows, *left]
    columns = list(zip(*every)) or [()] * 6
    data = [
        pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array([len(x) // 4 for x in columns[3]], pa.int64()), pa.array(map(zlib.crc32, columns[3]), pa.int64()),
        pa.array(columns[2], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()), pa.array([None] * len(rows) + [p[3] for p in left], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(data, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack_online(docs, tokenizer_path, id_col="doc_id", text_col="text", capacity=CAPACITY, windows=WINDOWS, end=END):
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and `end`; a null or empty text has `end` alone. One
    longer than the capacity, or met when no window holds it, is cut, and every id is in exactly one
    piece. All sequences are full, but for the last ones, of which each has as many tokens as a power
    of two. Repeated rows, and rows without an id, are documents of their own; an empty table gives an
    empty result; other columns of docs are not read. A task holds its open windows and one batch; a
    text of any length is encoded whole, so memory follows the longest one. Documents aren't shuffled.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = spark.sparkContext.broadcast(f.read())
    last = np.array([end], "<u4").tobytes()

    def read(batches):
        space = Windows(TaskContext.get().partitionId() << WITHIN, capacity, windows)
        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            names, strings = batch.column(0).to_pylist(), ["" if t is None else t for t in batch.column(1).to_pylist()]
            coded, done = ids_of(text.value), []
            for doc_id, string in zip(names, strings):
                ids = coded(string) + last
                done += space.place(doc_id, 0, len(ids) // 4, ids)
            yield pieces(done, of)
        if of is not None:
            yield pieces([], of, space.left())

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    found = stored(rows.mapInArrow(read, schema))
    result, turn = found.where("ids IS NULL"), 0
    group = F.shiftright("sequence_id", WITHIN)
    while True:
        open_ = found.where("ids IS NOT NULL").withColumn("group", F.floor(F.pmod(group, F.lit(1 << GROUPS)) / MERGED))
        most = open_.agg(F.max("group")).first()[0]
        if most is None:
            break
        turn += 1
        found = stored(open_.groupBy("group").applyInArrow(merger(turn, most == 0, capacity, windows), schema))
        result = result.unionByName(found.where("ids IS NULL"))
    return result.drop("ids").withColumnRenamed("doc_id", id_col)


def merger(turn, final, capacity, windows):
    """Packs the leftovers of a group, the longest first; the last group of all leaves nothing open."""

    def merge(found):
        found = found.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        space = Windows((turn << GROUPS | found["group"][0].as_py()) << WITHIN, capacity, windows)
        rows = zip(*(found[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")))
        done = [p for row in rows for p in space.place(*row)]
        done, left = (done + space.finish(), []) if final else (done, space.left())
        return pa.Table.from_batches([pieces(done, found.schema.field("doc_id").type, left)])

    return merge
