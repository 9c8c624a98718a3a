"""Versioned snapshots of the tables in a folder: one writer, readers that never wait.

A table is cut into parts by a hash of its first key. A commit writes a folder with the parts that change, of
each changed table, and then a small manifest that says where each part of each table is; readers take the newest
manifest. A crash before the manifest leaves the previous version as it was. Parts that no recent manifest
names are removed by vacuum().
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import functions as F

from .. import schemas

#: Parts of a table in a new store, seconds that a version stays readable after the next one, tables written at once.
PARTS, GRACE, AT_ONCE = 16, 3600, 4
#: How tables are compressed.
CODEC = "zstd"


def folder(spark):
    """A new folder in the one that driver and executors share; only in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='tarnwater-')}/{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark, path, writable=True, parts=PARTS):
        self.spark, self.path, self.writable = spark, path.rstrip("/"), writable
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not writable and self.version() < 0:
            raise FileNotFoundError(path)
        self.parts = self.manifest().get("parts", parts)

    @classmethod
    def readonly(cls, spark, path):
        """An existing store; writes are refused."""
        return cls(spark, path, writable=False)

    def version(self):
        """Number of the newest commit, -1 before the first."""
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return -1
        return max((int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if not s.getPath().getName().startswith(".")), default=-1)

    def manifest(self, version=None):
        """{"parts": how many parts a table has, "tables": {name: {part: folder}}} of a version, the newest by default."""
        v = self.version() if version is None else version
        if v < 0:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/_commits/{v:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def has(self, name):
        return name in self.manifest().get("tables", {})

    def read(self, name, parts=None):
        """A table, or some of its parts, under its newest schema: columns that an older snapshot lacks are null."""
        at = self.manifest().get("tables", {}).get(name, {})
        folders = sorted({f for p, f in at.items() if parts is None or int(p) in parts})
        if not folders:
            return schemas.empty(self.spark, name)
        return self.spark.read.schema(schemas.schema(name)).parquet(*(f"{self.path}/{f}" for f in folders))

    def part(self, name):
        """The part of a table in which a row lies, as a column."""
        kind = schemas.schema(name)[schemas.PARTED[name]].dataType
        return F.pmod(F.xxhash64(F.col(schemas.PARTED[name]).cast(kind)), F.lit(self.parts)).cast("int")

    def touched(self, rows, name):
        """Numbers of the parts that rows with the first key of a table lie in; as many as the table has parts at most."""
        return sorted(r.part for r in rows.select(self.part(name).alias("part")).distinct().collect())

    def put(self, kind, rows):
        """rows, written beside the tables and read again."""
        at = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        rows.write.option("compression", CODEC).parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    @contextmanager
    def staged(self, rows):
        """rows as a table of their own, which is deleted at the end: what is read many times is made once."""
        if not self.writable:
            raise PermissionError("the store was opened for reading")
        at = f"{self.path}/_staged/{uuid.uuid4().hex}"
        try:
            rows.write.option("compression", CODEC).parquet(at)
            yield self.spark.read.schema(rows.schema).parquet(at)
        finally:
            self._fs.delete(self._path(at), True)

    def commit(self, tables, parts=None):
        """Write tables (name -> DataFrame) as one new version; all of them become visible at once. parts: name ->
        numbers of the parts that its rows make up; the other parts stay as they are. A table without
        an entry there is written whole. Rows that have their `part` are dealt by it already, and are written as they lie."""
        if not self.writable:
            raise PermissionError("the store was opened for reading")
        v, old = self.version() + 1, self.manifest().get("tables", {})
        entries = {name: dict(at) for name, at in old.items()}

        def write(name):
            if "part" in tables[name].columns:
                rows = tables[name].select(*schemas.schema(name).fieldNames(), "part")
            else:
                order = ["part", "crawl_status"] if name == "players" else ["part"]  # readers of one status skip row groups
                rows = schemas.conform(tables[name], name).withColumn("part", self.part(name)).repartition("part").sortWithinPartitions(*order)
            rows.write.mode("overwrite").option("compression", CODEC).partitionBy("part").parquet(f"{self.path}/{name}/v{v:010d}")

        with ThreadPoolExecutor(AT_ONCE) as pool:  # the tables' jobs run beside each other
            list(pool.map(write, tables))
        for name in tables:
            at, some = f"{name}/v{v:010d}", (parts or {}).get(name)
            made = self._made(at)
            entries[name] = {p: f for p, f in entries.get(name, {}).items() if some is not None and int(p) not in some} | {str(p): f"{at}/part={p}" for p in made}
        temporary, final = self._path(f"{self.path}/_tmp-{v:010d}.json"), self._path(f"{self.path}/_commits/{v:010d}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"parts": self.parts, "tables": entries}).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise RuntimeError(f"version {v} was written by another writer")
        return v

    def _made(self, at):
        """The parts in the folder of a table's version; one without rows has none."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{at}")))
        return sorted(int(n[5:]) for n in names if n.startswith("part="))

    def vacuum(self, grace=GRACE, now=None):
        """Remove versions that another one has followed more than `grace` seconds ago, and the parts that only they
        name. Returns how many folders went. The newest version always stays."""
        if not self.writable:
            raise PermissionError("the store was opened for reading")
        newest, now = self.version(), time.time() if now is None else now
        if newest < 0:
            return 0
        stamps = {int(s.getPath().getName().split(".")[0]): s.getModificationTime() / 1000 for s in self._fs.listStatus(self._path(f"{self.path}/_commits")) if not s.getPath().getName().startswith(".")}
        kept = [v for v in stamps if v == newest or v + 1 not in stamps or stamps[v + 1] >= now - grace]
        named = {f for v in kept for at in self.manifest(v)["tables"].values() for f in at.values()}
        gone = 0
        for name in schemas.TABLES:
            for version in self._listed(name):
                if int(version.getName()[1:]) > newest:
                    continue  # a commit at work
                folders = [p for p in self._listed(f"{name}/{version.getName()}") if p.getName().startswith("part=")]
                stale = [p for p in folders if f"{name}/{version.getName()}/{p.getName()}" not in named]
                for p in [version] if len(stale) == len(folders) else stale:
                    self._fs.delete(p, True)
                gone += len(stale)
        for v in stamps:
            if v not in kept:
                self._fs.delete(self._path(f"{self.path}/_commits/{v:010d}.json"), False)
        return gone

    def _listed(self, at):
        folder = self._path(f"{self.path}/{at}")
        return [s.getPath() for s in self._fs.listStatus(folder) if s.isDirectory()] if self._fs.exists(folder) else []
