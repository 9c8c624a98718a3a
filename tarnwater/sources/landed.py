"""Landed responses as a data source: files of JSON lines, in the order in which they arrived.

`spark.read.format("landed").option("kind", "profiles").load(folder)` reads them as a table, `readStream`
as a stream. A row has the fields of its kind and, to tell what came later: landed_at (microseconds; the
line's own field, else the time of its file), file, and place (the byte where its line begins). Files are cut
into splits of lines, so a large one is read by many tasks. The folder has to be one that all workers reach
by a path or through pyarrow's file systems.
"""

from __future__ import annotations

import json
import time

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.json as pj
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: The kinds of responses and their fields.
KINDS = {
    "hero_boards": "hero_id INT, raw STRING", "global_board": "raw STRING", "profiles": "uid BIGINT, http_status INT, raw STRING",
    "pages": "uid BIGINT, skip INT, http_status INT, raw STRING", "details": "match_uid STRING, http_status INT, raw STRING",
}
#: What tells the order of arrival, first by time.
ARRIVAL = {"landed_at": "BIGINT", "file": "STRING", "place": "BIGINT"}
ARROW = {"INT": pa.int32(), "BIGINT": pa.int64(), "STRING": pa.string()}
#: Bytes of a split, of what a task reads at a time; seconds after which a file counts as whole.
SPLIT, BLOCK, SETTLE = 32 << 20, 4 << 20, 1.0


def fields(kind):
    return dict(f.split(" ") for f in KINDS[kind].split(", "))


class Split(InputPartition):
    """Lines of files that begin in [start, end) of each: a list of (file, time, start, end)."""

    def __init__(self, parts):
        self.parts = parts


def opened(path):
    return pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)


def files(path):
    """(microseconds, file, size) of the files of a folder in the order of their times; hidden ones don't count."""
    system, at = opened(path)
    found = system.get_file_info(pf.FileSelector(at, allow_not_found=True, recursive=True))
    some = (f for f in found if f.is_file and not f.base_name.startswith((".", "_")))
    return sorted((f.mtime_ns // 1000, f.path, f.size) for f in some)


def splits(found, size):
    """Splits of about `size` bytes; small files share one."""
    out, parts, room = [], [], size
    for at, name, n in found:
        start = 0
        while start < n:
            end = min(n, start + room)
            parts.append((name, at, start, end))
            room, start = room - (end - start), end
            if not room:
                out.append(Split(parts))
                parts, room = [], size
    return [*out, Split(parts)] if parts else out


def lines(stream, start, end, size, block):
    """(place, bytes) of blocks of whole lines that begin in [start, end) of a stream of `size` bytes."""
    at, held = start, b""
    if start:  # the line that began before belongs to the split before
        stream.seek(start - 1)
        at = start - 1
        found = b""
        while at < size:
            found = stream.read(min(block, size - at))
            cut = found.find(b"\n")
            at += len(found) if cut < 0 else cut + 1
            if cut >= 0:
                held = found[cut + 1 :]
                break
        else:
            return
    else:
        stream.seek(0)
    read = at + len(held)
    while at < end:
        if read < size:
            more = stream.read(min(block, size - read))
            read, held = read + len(more), held + more
        cut = len(held) if read >= size else held.rfind(b"\n") + 1
        if at + cut > end:  # only lines that begin before the end
            last = held.find(b"\n", max(0, end - at - 1))
            cut = len(held) if last < 0 and read >= size else last + 1
        if cut:
            yield at, held[:cut]
            at, held = at + cut, held[cut:]
        elif read >= size:
            return


def parsed(block, place, kind, name, landed_at):
    """An Arrow batch of the lines of a block. A line that is no such record has its text as `raw` and
    nothing else, so that it is seen downstream as a response that can't be read."""
    types = {c: ARROW[t] for c, t in fields(kind).items()}
    rows, places = [], []
    for line in block.split(b"\n"):
        if line.strip():
            rows.append(line)
            places.append(place)
        place += len(line) + 1
    if not rows:
        return None
    schema = pa.schema([*types.items(), ("landed_at", pa.int64())])
    try:
        table = pj.read_json(pa.BufferReader(b"\n".join(rows)), pj.ReadOptions(block_size=max(1 << 20, len(block) + 1)), pj.ParseOptions(schema, unexpected_field_behavior="ignore"))
        if len(table) != len(rows):
            raise pa.ArrowInvalid("records over several lines")
    except pa.ArrowInvalid:
        table = pa.Table.from_pylist([record(r, schema) for r in rows], schema)
    at = table["landed_at"].combine_chunks()
    at = at.fill_null(landed_at) if at.null_count else at
    arrays = [*(table[c].combine_chunks() for c in types), at, pa.array([name] * len(rows)), pa.array(places, pa.int64())]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], [*types, *ARRIVAL])


def record(line, schema):
    """A record of one line, field by field; what is of another type is null."""
    text = line.decode(errors="replace")
    try:
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError
    except ValueError:
        return {"raw": text}
    out = {}
    for f in schema:
        value = found.get(f.name)
        whole = isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << (31 if f.type == pa.int32() else 63)
        out[f.name] = value if (isinstance(value, str) if f.type == pa.string() else whole) else None
    return out


class Reader:
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.split, self.block = int(options.get("split", SPLIT)), int(options.get("block", BLOCK))
        self.settle = float(options.get("settle", SETTLE))
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    def read(self, partition):
        system, _ = opened(self.path)
        for name, at, start, end in partition.parts:
            with system.open_input_file(name) as stream:
                for place, block in lines(stream, start, end, stream.size(), self.block):
                    batch = parsed(block, place, self.kind, name, at)
                    if batch is not None:
                        yield batch


class BatchReader(Reader, DataSourceReader):
    def partitions(self):
        return splits(files(self.path), self.split) or [Split([])]


class StreamReader(Reader, DataSourceStreamReader):
    """The offset is the last file read, in the order of (time, name). Only files that are older than
    `settle` seconds are taken, so that no file can appear before the offset later on."""

    def initialOffset(self):
        return {"at": -1, "file": ""}

    def latestOffset(self):
        before = (time.time() - self.settle) * 1e6
        found = [(at, name) for at, name, _ in files(self.path) if at <= before]
        return dict(zip(("at", "file"), found[-1])) if found else self.initialOffset()

    def partitions(self, start, end):
        low, high = (start["at"], start["file"]), (end["at"], end["file"])
        return splits([f for f in files(self.path) if low < f[:2] <= high], self.split)


class LandedSource(DataSource):
    """Options: path, kind; split and block in bytes, settle in seconds (of a stream)."""

    @classmethod
    def name(cls):
        return "landed"

    def schema(self):
        types = {"INT": IntegerType(), "BIGINT": LongType(), "STRING": StringType()}
        return StructType([StructField(c, types[t]) for c, t in (fields(self.options["kind"]) | ARRIVAL).items()])

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def register(spark):
    spark.dataSource.register(LandedSource)
    return spark
