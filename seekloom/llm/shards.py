"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are written as small Parquet files that never change. A manifest version lists
the files that make up the table. A file's tier is how many times its size
can be divided by ``FANOUT`` above the smallest; when a tier has ``FANOUT`` files or more,
they are merged: into files of the target size if they have so many bytes together, else into
one file of a higher tier. So a row is rewritten at most once per tier, and once only where
arrivals are many. Merging is a read and a write of the same rows without
a shuffle: the reader's tasks are coalesced to as many as there are files to make.

A version is a small file that names segments, which list shards and never change; a commit adds a segment
of the fresh shards and writes again only those that list a shard that goes. It is committed by a rename to
a name that must not exist yet, so readers see a version whole or not at all, and of two writers one loses and
raises. That needs a file system whose rename is atomic and refuses to overwrite (HDFS, local ones); on an object
store without it, only one writer may commit at a time. A job that fails before the rename leaves only files that no
manifest lists, for :meth:`Store.sweep` to find. The last ``KEPT_VERSIONS`` versions can be read at any time, during merges too.

Defined cases: an empty arrival commits a version without files; rows are kept as they
are, nulls, repeats and very long texts included; a batch whose columns differ from the table's in
names or types is refused, so that no column is lost; the ``arrival`` column's name avoids clashes.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, scratch, table

FANOUT = 4
SMALLEST, TARGET = 1 << 20, 128 << 20
#: Versions that can always be read.
KEPT_VERSIONS = 2
#: A version of more segments than this is listed in one again.
SEGMENTS = 64


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int

    @property
    def tier(self) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / SMALLEST, FANOUT)) + 1) if self.bytes > SMALLEST else 0


class Store:
    """A table of shards below ``folder``, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET) -> None:
        self.spark, self.folder, self.target = spark, folder.rstrip("/"), target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        for name in ("manifests", "segments"):
            self._fs.mkdirs(self._path(f"{self.folder}/{name}"))

    # versions

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifests/v{version:08d}.json"

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _segments(self, version: int | None = None) -> list[str]:
        known = self.versions()
        return json.loads(self._text(self._manifest(known[-1] if version is None else version)))["segments"] if known else []

    def _listed(self, segment: str) -> list[Shard]:
        return [Shard(*json.loads(line)) for line in self._text(f"{self.folder}/segments/{segment}").splitlines()]

    def shards(self, version: int | None = None) -> list[Shard]:
        """The files of a version, the latest if none is named."""
        return [x for segment in self._segments(version) for x in self._listed(segment)]

    def schema(self) -> T.StructType | None:
        """Of the table, as its first arrival had it."""
        known = self.versions()
        found = json.loads(self._text(self._manifest(known[-1])))["schema"] if known else None
        return T.StructType.fromJson(found) if found else None

    def _commit(self, version: int, segments: list[str], schema: T.StructType | None) -> None:
        fresh = f"{self.folder}/manifests/.{uuid.uuid4().hex}"
        self._put(fresh, json.dumps({"version": version, "segments": segments, "schema": schema and schema.jsonValue()}))
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails if the version exists
        files.rename(self._path(fresh), self._path(self._manifest(version)), options)

    def _segment(self, shards: list[Shard]) -> list[str]:
        if not shards:
            return []
        name = uuid.uuid4().hex
        self._put(f"{self.folder}/segments/{name}", "".join(json.dumps([x.path, x.bytes]) + "\n" for x in shards))
        return [name]

    # data

    def _written(self, folder: str) -> list[Shard]:
        found, files = [], self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            status = files.next()
            if status.getPath().getName().endswith(".parquet"):
                found.append(Shard(status.getPath().toString(), status.getLen()))
        return sorted(found, key=lambda s: s.path)

    def _checked(self, rows: DataFrame) -> T.StructType:
        """The table's schema, if ``rows`` fit it."""
        known, kinds = self.schema(), lambda s: {f.name: f.dataType.simpleString() for f in s.fields}
        if known is not None and kinds(known) != kinds(rows.schema):
            raise ValueError(f"the table has columns {kinds(known)}, the arrival {kinds(rows.schema)}")
        return known or T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])

    def append(self, rows: DataFrame) -> int:
        """Write ``rows`` as new shards and commit them as one version."""
        schema, folder = self._checked(rows), f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.publish(self._written(folder), schema=schema)

    def publish(self, fresh: list[Shard], gone: frozenset[str] = frozenset(), schema: T.StructType | None = None) -> int:
        """Commit the latest version with ``fresh`` shards and without the paths in ``gone``."""
        version, kept, loose = (self.versions() or [0])[-1] + 1, [], []
        old = self._segments()
        for segment in old:
            listed = self._listed(segment) if gone or len(old) >= SEGMENTS else []
            if len(old) >= SEGMENTS or any(x.path in gone for x in listed):
                loose += [x for x in listed if x.path not in gone]
            else:
                kept.append(segment)
        self._commit(version, [*kept, *self._segment(loose), *self._segment(fresh)], schema or self.schema())
        return version

    def append_by(self, rows: DataFrame, arrival: str) -> list[int]:
        """Append each value of a column of few values as an arrival of its own, in order of the values (null last), in one write."""
        schema, folder = self._checked(rows), f"{self.folder}/data/{uuid.uuid4().hex}"
        mark, kind = free_name(rows, "arrived"), rows.schema[arrival].dataType
        rows.withColumn(mark, F.col(arrival)).write.partitionBy(mark).parquet(folder)
        batches: dict[str, list[Shard]] = {}
        for shard in self._written(folder):
            batches.setdefault(shard.path.rsplit("/", 2)[1], []).append(shard)
        names = [(k, None if k.endswith("=__HIVE_DEFAULT_PARTITION__") else unquote(k.split("=", 1)[1])) for k in batches]
        if not names:
            return []
        ordered = self.spark.createDataFrame(names, "name string, value string").orderBy(F.col("value").cast(kind).asc_nulls_last(), "name").collect()
        return [self.publish(batches[r["name"]], schema=schema) for r in ordered]

    def due(self) -> list[list[Shard]]:
        """Groups of files of one tier that should be merged now."""
        tiers: dict[int, list[Shard]] = {}
        for shard in self.shards():
            if shard.bytes < self.target // 2:  # larger ones are as good as full
                tiers.setdefault(shard.tier, []).append(shard)
        return [group for _, group in sorted(tiers.items()) if len(group) >= FANOUT]

    def compact(self) -> int:
        """Merge until no tier is full; how many merges were committed."""
        merges = 0
        while groups := self.due():
            group, size = groups[0], sum(s.bytes for s in groups[0])
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            merged = self.spark.read.schema(self.schema()).parquet(*[s.path for s in group])
            merged.coalesce(max(1, math.ceil(size / self.target))).write.parquet(folder)
            self.publish(self._written(folder), frozenset(s.path for s in group))
            self.vacuum()
            merges += 1
        return merges

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Delete all versions but the latest few, and the files that only those listed.

        A version goes before its files do, so no version is ever left that can't be read.
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        segments = {name for v in kept for name in self._segments(v)}
        needed = {x.path for name in segments for x in self._listed(name)}
        gone = {name for v in old for name in self._segments(v)} - segments
        paths = {x.path for name in gone for x in self._listed(name)} - needed
        for version in old:
            self._fs.delete(self._path(self._manifest(version)), False)
        for path in [*sorted(paths), *[f"{self.folder}/segments/{name}" for name in sorted(gone)]]:
            self._fs.delete(self._path(path), False)

    def sweep(self, age_seconds: float = 86400.0) -> list[str]:
        """Delete data files that no version lists and that are so old that no writer is still at them; their paths."""
        listed, gone, files = {x.path for v in self.versions() for x in self.shards(v)}, [], []
        if self._fs.exists(self._path(f"{self.folder}/data")):
            found = self._fs.listFiles(self._path(f"{self.folder}/data"), True)
            while found.hasNext():
                status = found.next()
                files.append((status.getPath(), status.getModificationTime() / 1000))
        for path, changed in files:
            if path.getName().endswith(".parquet") and path.toString() not in listed and time.time() - changed >= age_seconds and self._fs.delete(path, False):
                gone.append(path.toString())
        return sorted(gone)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if it has no files."""
        shards = self.shards(version)
        return self.spark.read.schema(self.schema()).parquet(*[s.path for s in shards]) if shards else None


def shard(rows: DataFrame, arrival: Column, folder: str, target: int = TARGET) -> Store:
    """Append ``rows`` arrival by arrival (a column of few values), then compact."""
    store = Store(rows.sparkSession, folder, target)
    name = free_name(rows, "arrival")
    store.append_by(rows.withColumn(name, arrival), name)
    store.compact()
    return store


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shard(docs, F.coalesce(F.pmod(F.col("doc_id"), F.lit(8)), F.lit(0)).cast("int"), scratch(spark, "shards"))
    rows = store.read()
    if rows is None:
        rows = docs.withColumn("arrival", F.lit(0))
    return rows.select("doc_id", "arrival", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = {
    "op2_sharding": "SELECT doc_id, CAST(coalesce(((doc_id % 8) + 8) % 8, 0) AS INTEGER) AS arrival, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
}
QUERIES = {"op2_sharding": op2_sharding}
