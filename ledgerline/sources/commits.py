"""Tables that change together: parts in folders, and one manifest a version that names them all.

Every commit first writes its parts into folders that nothing reads, then adds the next version's manifest, if nobody else has: that
is the moment at which all of its tables change at once. A stop before it leaves readers on the version before; a second writer from
the same version fails. Manifests and folders are reached by Spark's own file systems, so they may lie in any store.

    path/data/<token>/<table>     parts
    path/commits/<version>.json   {"version", "parts": {table: [folder...]}, "batches": {batch: version}, "state": {...}}
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of a part's rows that says which version wrote them.
VERSION = "_version"
#: Batches that a manifest remembers; retries of older ones are no longer told.
REMEMBERED = 10_000


class CommitConflict(Exception):
    """Another writer made the next version first."""


class Files:
    """Whole small files, and folders, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        p = self._path(path)
        return p.getFileSystem(self.conf).exists(p)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        fs = p.getFileSystem(self.conf)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        p = self._path(path)
        stream = p.getFileSystem(self.conf).open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a whole file under a name that isn't taken; False if it is."""
        p, aside = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}")
        fs = p.getFileSystem(self.conf)
        if fs.exists(p):
            return False
        out = fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(aside, p, options)
            return True
        except Exception as e:  # noqa: BLE001 - the JVM's exception tells what it is by its name
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(aside, False)
            return False

    def delete(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.conf).delete(p, True)


class Tables:
    """Tables under one path that are read and changed by version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.path}/commits") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": {}, "batches": {}, "state": {}}
        return json.loads(self.files.read(f"{self.path}/commits/{version:020d}.json"))

    def read(self, table: str, version: int | None = None, schema: str | None = None) -> DataFrame:
        """A table's rows as of a version; a table that has no part yet needs a schema."""
        parts = self.manifest(version)["parts"].get(table, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", True)).parquet(*[f"{self.path}/{p}" for p in parts])

    def stage(self, df: DataFrame, token: str, table: str) -> str:
        """Write a part that no version names yet; a part that was staged whole under this token stays as it is."""
        part = f"data/{token}/{table}"
        if not self.files.exists(f"{self.path}/{part}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{self.path}/{part}")
        return part

    def staged(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def publish(self, parent: int, parts: dict[str, list[str]], batch: str | None = None, state: dict | None = None) -> int:
        """Make the version after ``parent``, with these tables' parts instead of what they had; CommitConflict if there is one already."""
        old = self.manifest(parent)
        batches = dict(list(old["batches"].items())[-REMEMBERED:]) | ({batch: parent + 1} if batch else {})
        new = {"version": parent + 1, "parts": old["parts"] | parts, "batches": batches, "state": old["state"] | (state or {})}
        if not self.files.create(f"{self.path}/commits/{parent + 1:020d}.json", json.dumps(new)):
            raise CommitConflict(f"version {parent + 1} of {self.path} is there already")
        return parent + 1

    def commit(self, parent: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, batch: str | None = None, state: dict | None = None) -> int:
        """Write parts and publish them in one version, which is returned.

        A batch that an earlier version has committed changes nothing, and that version is returned. Rows that are appended
        carry the version in ``_version``.
        """
        old = self.manifest()
        if batch and batch in old["batches"]:
            return old["batches"][batch]
        if old["version"] > parent:
            raise CommitConflict(f"version {parent + 1} of {self.path} is there already")
        token, parts = uuid.uuid4().hex, {}
        for table, df in (replace or {}).items():
            parts[table] = [self.stage(df, token, table)]
        for table, df in (append or {}).items():
            parts[table] = [*old["parts"].get(table, []), self.stage(df.withColumn(VERSION, F.lit(parent + 1).cast("bigint")), token, table)]
        return self.publish(parent, parts, batch, state)

    def prune(self, keep: int = 2) -> int:
        """Delete parts that none of the newest ``keep`` versions names; returns how many. Not while a commit is under way."""
        newest = self.version()
        used = {p for v in range(max(1, newest - keep + 1), newest + 1) for parts in self.manifest(v)["parts"].values() for p in parts}
        there = [f"data/{token}/{table}" for token in self.files.names(f"{self.path}/data") for table in self.files.names(f"{self.path}/data/{token}")]
        gone = [p for p in there if p not in used]
        for p in gone:
            self.files.delete(f"{self.path}/{p}")
        return len(gone)


def newest_rows(rows: DataFrame, keys: list[str], order: tuple[str, ...] = (VERSION,)) -> DataFrame:
    """The last row of each key, of a table that is appended to; rows of one version that repeat a key are ordered by all their columns."""
    rest = [c for c in rows.columns if c not in keys]
    place = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*place)).alias("__x")).select(*keys, "__x.*").select(*rows.columns)
