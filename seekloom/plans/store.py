"""Generations of a catalog on disk: written whole, committed by a manifest, read with a fallback.

A generation is a folder of Parquet tables. Its manifest is written last, under a name of its own, by a rename
that fails if the name exists; so a crash leaves a folder without a manifest, which readers never see. A
reader takes the newest generation whose manifest and tables are sound.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SEMANTIC_ID
from ..operators.metadata import duplicate_ids

FORMAT = 1
#: The index may take this share of the source; above it nothing is published.
MOST_INDEX_SHARE = 0.10
KEPT = 2


class CapacityExceeded(RuntimeError):
    """The tables that support a search are too large for their source."""


class NoGeneration(RuntimeError):
    """No generation can be read."""


class Store:
    """Generations below ``root``, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._sound: dict[int, list] = {}
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        for folder in ("generations", "manifests"):
            self._fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _numbers(self, folder: str, suffix: str = "") -> list[int]:
        names = [s.getPath().getName().removesuffix(suffix) for s in self._fs.listStatus(self._path(folder))]
        return sorted(int(n) for n in names if n.isdigit())

    def generations(self) -> list[int]:
        return self._numbers("manifests", ".json")

    def next_number(self) -> int:
        """One above anything that was ever begun, committed or not."""
        return max([0, *self.generations(), *self._numbers("generations")]) + 1

    def manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"manifests/{number:010d}.json"))
        try:
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found.get("format") != FORMAT or found.get("semantic_id") != SEMANTIC_ID or found.get("generation") != number:
            raise ValueError(f"generation {number} is of another format or meaning")
        return found

    def publish(self, tables: dict[str, DataFrame], parent: int | None = None, gate: Callable[[dict[str, int]], float] | None = None, notes: dict | None = None, base: int | None = None, derived: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> int:
        """Write the tables and commit them; the new generation's number.

        ``derived`` gives further tables from those that are written: it gets them as they are stored, so what they are made of isn't made again.

        ``gate`` maps written bytes by table to the index's share of its source; ``notes`` are kept in the manifest.
        ``parent`` is the generation that this one came after, ``base`` one that it can't be read without.
        """
        if "metadata" in tables and not duplicate_ids(tables["metadata"]).isEmpty():
            raise ValueError("two records have the same id")
        number = self.next_number()
        sizes, rows, sums, stored = {}, {}, {}, {}

        def write(name: str, df: DataFrame) -> None:
            path = f"{self.root}/generations/{number:010d}/{name}"
            df.write.mode("errorifexists").parquet(path)
            sizes[name] = self._fs.getContentSummary(self._jvm.org.apache.hadoop.fs.Path(path)).getLength()
            stored[name] = self.spark.read.parquet(path)
            rows[name], sums[name] = self._summed(stored[name])

        for name, df in tables.items():
            write(name, df)
        for name, df in (derived(dict(stored)) if derived else {}).items():
            write(name, df)
        if gate is not None and (share := gate(sizes)) > MOST_INDEX_SHARE:
            self._fs.delete(self._path(f"generations/{number:010d}"), True)
            raise CapacityExceeded(f"the index takes {share:.1%} of its source")
        body = {"format": FORMAT, "semantic_id": SEMANTIC_ID, "generation": number, "parent": parent, "base": base, "rows": rows, "sums": sums, "notes": notes or {}}
        fresh = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, False)
        stream.write(bytearray(json.dumps(body).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(fresh, self._path(f"manifests/{number:010d}.json"), none)
        self._sound[number] = self._files(number)  # sums are of what was read back
        return number

    def _files(self, number: int) -> list:
        """Paths, sizes and times of a generation's files and its manifest."""
        out, found = [], self._fs.listFiles(self._path(f"generations/{number:010d}"), True)
        while found.hasNext():
            out.append(found.next())
        out.append(self._fs.getFileStatus(self._path(f"manifests/{number:010d}.json")))
        return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in out)

    @staticmethod
    def _summed(df: DataFrame) -> tuple[int, int]:
        """How many rows, and a sum of their contents that doesn't depend on their order."""
        row = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), F.lit(0)).alias("sum")).head()
        return row["n"], row["sum"]

    def load(self, number: int, contents: bool = True) -> dict[str, DataFrame]:
        """The tables of one generation; an error if any is not what the manifest says.

        ``contents`` reads all rows to compare their sum; else they are only counted. What this store has written or read whole
        isn't read again while its files have the same sizes and times.
        """
        found, files, tables = self.manifest(number), self._files(number), {}
        known = files == self._sound.get(number)
        for name, rows in found["rows"].items():
            df = self.spark.read.parquet(f"{self.root}/generations/{number:010d}/{name}")
            tables[name] = df
            if known:
                continue
            n, total = self._summed(df) if contents else (df.count(), None)
            if n != rows:
                raise ValueError(f"{name} of generation {number} has lost rows")
            if contents and total != found["sums"][name]:
                raise ValueError(f"{name} of generation {number} has other contents")
        if contents:
            self._sound[number] = files
        if found["base"] is not None:
            self.manifest(found["base"])
        return tables

    def latest(self) -> tuple[int, dict[str, DataFrame]]:
        """The newest generation that is sound."""
        for number in reversed(self.generations()):
            try:
                return number, self.load(number)
            except Exception as e:  # noqa: BLE001 - whatever is wrong with it, an older one may do
                last = e
        raise NoGeneration("no generation can be read") from locals().get("last")

    def collect_garbage(self, keep: int = KEPT) -> list[int]:
        """Delete generations but the newest ``keep`` sound ones (2 at least) and what was never committed.

        Unsound ones don't count, and stay for whoever looks into them.
        """
        keep, kept, gone, needed = max(keep, KEPT), 0, [], set()
        for number in reversed(self.generations()):
            try:
                self.load(number, contents=False)
                base = self.manifest(number)["base"]
            except Exception:  # noqa: BLE001
                continue
            kept += 1
            if kept <= keep or number in needed:  # what a kept one builds on stays too
                needed.add(base)
                continue
            self._fs.delete(self._path(f"manifests/{number:010d}.json"), False)
            self._fs.delete(self._path(f"generations/{number:010d}"), True)
            gone.append(number)
        for number in set(self._numbers("generations")) - set(self.generations()):
            self._fs.delete(self._path(f"generations/{number:010d}"), True)
        return gone
