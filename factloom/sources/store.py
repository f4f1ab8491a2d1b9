"""A versioned store of Parquet files with manifests, transactions, snapshots, a commit journal and recovery.

Layout under a root folder, all of it through Spark's file system interface:

    data/<version>/      the records a commit wrote (delta), with their change kind
    manifests/<version>  one JSON line: version, base, deltas it consists of
    journal/<n>.prepare, journal/<n>.commit   one JSON line each

A commit writes its delta, then creates the next manifest without overwriting: of two writers on one base the second
finds it there and fails, and a commit that stopped half-way left no manifest and is never read. The current state is
the last write of each record over the manifest's deltas; ``compact`` folds them into one.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import versioning

RECORD = "kind string, id string, content string, change string, seq bigint"
#: Hours that files no manifest names are kept.
RETENTION_HOURS = 24


class StoreError(RuntimeError):
    """A store operation that can't be done."""


class ConflictError(StoreError):
    """Another commit came first."""


class Files:
    """The few file operations the store needs, on whatever file system the root is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def _write_beside(self, name: str, text: str) -> str:
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(part), False)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        return part

    def _rename(self, part: str, name: str, overwrite: bool) -> None:
        """One atomic step: a rename that refuses, or takes the place of, a file that is there."""
        if self.fs.getScheme() == "file":
            # The local file system's own rename tests first; a hard link doesn't.
            source, target = (self.path(x).toUri().getPath() for x in (part, name))
            (os.replace if overwrite else os.link)(source, target)
            self.fs.delete(self.path(part), False)
            checksum = os.path.join(os.path.dirname(source), f".{os.path.basename(source)}.crc")
            if os.path.exists(checksum):
                os.unlink(checksum)
            return
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if overwrite else kind.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        context.rename(self.path(part), self.path(name), options)

    def create(self, name: str, text: str) -> None:
        """A new file, never over another one: of two writers one fails. The text is written beside it and renamed, so it is
        whole or absent."""
        part = self._write_beside(name, text)
        try:
            self._rename(part, name, False)
        except (FileExistsError, Py4JJavaError) as error:
            self.fs.delete(self.path(part), False)
            raise ConflictError(f"{name} exists") from error

    def replace(self, name: str, text: str) -> None:
        """The file with another text; a reader sees the one or the other."""
        self._rename(self._write_beside(name, text), name, True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        size = int(self.fs.getFileStatus(self.path(name)).getLen())
        data = bytes(stream.readNBytes(size))
        stream.close()
        return data.decode()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def age_hours(self, name: str) -> float:
        return (time.time() * 1000 - self.fs.getFileStatus(self.path(name)).getModificationTime()) / 3.6e6


def valid_document_id(name: str) -> bool:
    """A relative path of plain parts."""
    parts = name.split("/")
    return bool(name) and not name.startswith("/") and all(p and p not in (".", "..") and "\\" not in p and "\0" not in p for p in parts)


@dataclass
class DocumentStore:
    """Small documents by relative path: get, create, replace, delete."""

    spark: SparkSession
    root: str

    def _name(self, name: str) -> str:
        if not valid_document_id(name):
            raise StoreError(f"{name!r} is not a document id")
        return f"{self.root}/{name}"

    def contains(self, name: str) -> bool:
        return Files(self.spark, self.root).exists(self._name(name))

    def get(self, name: str) -> str | None:
        files = Files(self.spark, self.root)
        return files.read(self._name(name)) if files.exists(self._name(name)) else None

    def create(self, name: str, text: str) -> None:
        Files(self.spark, self.root).create(self._name(name), text)

    def replace(self, name: str, text: str) -> None:
        if not self.contains(name):
            raise StoreError(f"{name!r} does not exist")
        Files(self.spark, self.root).replace(self._name(name), text)

    def delete(self, name: str) -> bool:
        return Files(self.spark, self.root).delete(self._name(name))


@dataclass
class Snapshot:
    """A pinned version."""

    store: VersionedStore
    version: int

    def read(self) -> DataFrame:
        return self.store.state(self.version)

    def contains(self, kind: str, id_: str) -> bool:
        return not self.read().where((F.col("kind") == kind) & (F.col("id") == id_)).isEmpty()


@dataclass
class VersionedStore:
    spark: SparkSession
    root: str
    #: development keeps unnamed files; production removes them after the retention time.
    mode: str = "production"

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def current(self) -> int:
        names = [n for n in self.files.names(f"{self.root}/manifests") if n.isdigit()]
        return int(names[-1]) if names else 0

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "base": None, "deltas": []}
        name = f"{self.root}/manifests/{version:012d}"
        if not self.files.exists(name):
            raise StoreError(f"version {version} does not exist")
        out = json.loads(self.files.read(name))
        if out.get("schema") != 1 or out.get("version") != version:
            raise StoreError(f"the manifest of version {version} is corrupt")
        return out

    def history(self, version: int | None = None) -> DataFrame:
        """All record writes up to a version."""
        deltas = self.manifest(self.current() if version is None else version)["deltas"]
        if not deltas:
            return self.spark.createDataFrame([], RECORD + ", version bigint")
        return self.spark.read.schema(RECORD + ", version bigint").parquet(*[f"{self.root}/data/{d}" for d in deltas])

    def state(self, version: int | None = None) -> DataFrame:
        """(kind, id, content, change, version): the last write of every record; retracted records stay, marked so."""
        latest = F.max_by(F.struct("content", "change", "version"), F.struct("version", "seq")).alias("last")
        return self.history(version).groupBy("kind", "id").agg(latest).select("kind", "id", "last.content", "last.change", "last.version")

    def read(self, kind: str, id_: str, version: int | None = None) -> DataFrame:
        """One record; the condition reaches the Parquet scan."""
        rows = self.history(version).where((F.col("kind") == kind) & (F.col("id") == id_))
        return rows.groupBy("kind", "id").agg(F.max_by("content", F.struct("version", "seq")).alias("content"), F.max("version").alias("version"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self.current() if version is None else version
        self.manifest(version)
        return Snapshot(self, version)

    def commit(self, records: DataFrame, base: int) -> int:
        """The next version with records (kind, id, content, change, seq); a base that isn't current is a conflict."""
        if self.current() != base:
            raise ConflictError(f"base {base} is not the current version {self.current()}")
        if not records.groupBy("kind", "id", "seq").count().where("count > 1").isEmpty():
            raise StoreError("a record is written twice at one place of the commit")
        version, delta = base + 1, f"{base + 1:012d}-{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in RECORD.split(", ")]
        records.select(*columns).withColumn("version", F.lit(version).cast("bigint")).write.parquet(f"{self.root}/data/{delta}")
        text = {"schema": 1, "version": version, "base": base, "deltas": [*self.manifest(base)["deltas"], delta]}
        self.files.create(f"{self.root}/manifests/{version:012d}", json.dumps(text) + "\n")
        return version

    def compact(self) -> int:
        """A version of one delta that holds the current state."""
        base = self.current()
        version, delta = base + 1, f"{base + 1:012d}-{uuid.uuid4().hex}"
        state = self.state(base).withColumn("seq", F.lit(0).cast("bigint"))
        state.select("kind", "id", "content", "change", "seq", "version").write.parquet(f"{self.root}/data/{delta}")
        text = {"schema": 1, "version": version, "base": base, "deltas": [delta]}
        self.files.create(f"{self.root}/manifests/{version:012d}", json.dumps(text) + "\n")
        return version

    def clean(self, hours: float = RETENTION_HOURS) -> list[str]:
        """Removes deltas that no manifest names and that are older than the retention time."""
        if self.mode == "development":
            return []
        named = {d for v in self.files.names(f"{self.root}/manifests") if v.isdigit() for d in self.manifest(int(v))["deltas"]}
        stale = [d for d in self.files.names(f"{self.root}/data") if d not in named and self.files.age_hours(f"{self.root}/data/{d}") > hours]
        for d in stale:
            self.files.delete(f"{self.root}/data/{d}")
        return stale


@dataclass
class Journal:
    """Prepared and committed change sets, one JSON line to a file; a torn last line is as if it weren't there."""

    spark: SparkSession
    root: str

    def prepare(self, number: int, entry: dict) -> None:
        Files(self.spark, self.root).create(f"{self.root}/journal/{number:012d}.prepare", json.dumps(entry | {"number": number}) + "\n")

    def commit(self, number: int) -> None:
        Files(self.spark, self.root).create(f"{self.root}/journal/{number:012d}.commit", json.dumps({"number": number}) + "\n")

    def committed(self) -> DataFrame:
        """(number, entry) of the prepared entries that were committed, as JSON text."""
        path = f"{self.root}/journal"
        if not Files(self.spark, self.root).names(path):
            return self.spark.createDataFrame([], "number bigint, entry string")
        lines = self.spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
        return committed(lines)


def committed(lines: DataFrame) -> DataFrame:
    """Journal lines (value, file) to committed entries: prepares that have a commit; lines that don't parse are left out."""
    parsed = lines.select("value", "file", F.get_json_object("value", "$.number").cast("bigint").alias("number")).where("number IS NOT NULL")
    prepares = parsed.where(F.col("file").endswith(".prepare")).select("number", F.col("value").alias("entry"))
    commits = parsed.where(F.col("file").endswith(".commit")).select("number").distinct()
    return prepares.join(commits, "number", "left_semi")


def recover(snapshot: DataFrame, snapshot_version: int, entries: DataFrame) -> DataFrame:
    """(kind, id, content, version): a snapshot's records with the journal's later writes over them.

    entries: (version, base, seq, kind, id, content). Commits up to the snapshot's version are skipped; a gap in the chain
    of the others is an error.
    """
    later = entries.where(F.col("version") > snapshot_version)
    chain = later.select("version", "base").distinct()
    start = chain.sparkSession.createDataFrame([(snapshot_version, None)], "version bigint, base bigint")
    if not versioning.chain_breaks(chain.unionByName(start)).isEmpty():
        raise StoreError("the journal has a gap")
    new = later.groupBy("kind", "id").agg(F.max_by("content", F.struct("version", "seq")).alias("content"), F.max("version").alias("version"))
    old = snapshot.select("kind", "id", "content", "version").join(new, ["kind", "id"], "left_anti")
    return old.unionByName(new)


@dataclass
class Transaction:
    """Stages changes and commits them once; a closed transaction accepts nothing."""

    store: VersionedStore
    base: int
    staged: list[tuple[str, str, str, str, int]] = field(default_factory=list)
    state: str = "open"

    @classmethod
    def begin(cls, store: VersionedStore) -> Transaction:
        return cls(store, store.current())

    def _open(self) -> None:
        if self.state != "open":
            raise StoreError(f"the transaction is {self.state}")

    def stage(self, kind: str, id_: str, content: str, change: str = "updated") -> None:
        self._open()
        if any(s[:2] == (kind, id_) for s in self.staged):
            raise StoreError("a record is staged already")
        self.staged.append((kind, id_, content, change, len(self.staged)))

    def validate(self) -> None:
        self._open()
        if not self.staged:
            raise StoreError("nothing is staged")

    def commit(self, synchronise=None) -> int:
        """The new version; ``synchronise`` is called with it after the commit, whose success doesn't depend on it."""
        self.validate()
        rows = self.store.spark.createDataFrame(self.staged, RECORD)
        try:
            version = self.store.commit(rows, self.base)
        except StoreError:
            self.state = "failed"
            raise
        self.state = "committed"
        if synchronise is not None:
            synchronise(self.base, version)
        return version

    def rollback(self) -> None:
        self._open()
        self.staged.clear()
        self.state = "rolled back"
