"""A stored catalog's life: begun from a scan, searched, brought up to date by an overlay, and compacted.

A base generation has ``metadata``, ``units`` in blocks, and the index (``postings``, ``present``). An overlay generation has
``upserts``, ``tombstones`` and the ``delta`` units of files whose content changed, and names its base. Both are
committed whole by the store, so a reader sees the state before or after a change and nothing between.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import units
from ..operators import grams, metadata, overlay
from ..operators.search import Limits, hits
from .session import Request, Session
from .store import Store


#: Ids of files that a compaction leaves out by a broadcast, some 32 bytes each.
MOST_GONE = 1 << 21


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; on a local master only, of this machine if there is none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="seekloom-")
    return f"{named.rstrip('/')}/catalog-{uuid.uuid4().hex}"


@dataclass
class Loaded:
    """One generation as it was read: a base, and perhaps an overlay on it."""

    number: int
    base_number: int
    notes: dict
    base: dict[str, DataFrame]
    overlay: dict[str, DataFrame] | None

    @property
    def records(self) -> DataFrame:
        """All records as they are now, with their search keys."""
        return self.base["metadata"] if self.overlay is None else overlay.current(self.base["metadata"], self.overlay["upserts"], self.overlay["tombstones"])

    def _valid(self) -> DataFrame:
        """``file_id`` of base units that the overlay leaves valid: of files that are still there and whose content is as it was."""
        kept = overlay.live(self.base["metadata"], self.overlay["upserts"], self.overlay["tombstones"]).select("file_id")
        return kept.unionByName(self.overlay["upserts"].where("NOT content_changed").select("file_id"))

    def _live(self, units: DataFrame) -> DataFrame:
        return units if self.overlay is None else units.join(self._valid(), "file_id", "left_semi")

    def gone(self) -> DataFrame:
        """``file_id`` of the other base units, of which there are few where changes are few."""
        units = self.base["units"].select("file_id")
        return units.where(F.lit(False)) if self.overlay is None else units.distinct().join(self._valid(), "file_id", "left_anti")

    def base_units(self, literal: str = "", case_sensitive: bool = False) -> DataFrame:
        """Valid base units, only those of blocks that can have the literal. Stored units are folded, and so is the index."""
        units = self.base["units"]
        if literal and not case_sensitive:
            units = grams.Index(self.base["postings"], self.base["present"]).pruned(units, literal)
        return self._live(units)

    @property
    def units(self) -> DataFrame:
        return self.base_units() if self.overlay is None else self.base_units().unionByName(self.overlay["delta"])

    def hits(self, query: str, kind: str = "literal") -> DataFrame:
        """All hits of now: those in valid base blocks, and those in changed files."""
        found = hits(self.base_units(query if kind == "literal" else ""), query, kind)
        return found if self.overlay is None else found.unionByName(hits(self.overlay["delta"], query, kind))

    def limited_hits(self, query: str, kind: str = "literal", limits: Limits = Limits()) -> DataFrame:
        """The base's hits within the limits, and the changed files' within what is left."""
        found = hits(self.base_units(query if kind == "literal" else ""), query, kind)
        fresh = hits(self.base["units"].where(F.lit(False)) if self.overlay is None else self.overlay["delta"], query, kind)
        return overlay.limited_content(found, fresh, limits)

    def search(self, request: Request) -> DataFrame:
        return Session(self.records, self.units).search(request)

    def record(self, file_id: int) -> DataFrame:
        """The record of an id as it is now."""
        return self.records.where(F.col("file_id") == file_id)

    def owner(self, path: str) -> DataFrame:
        """``file_id`` of who has a path now."""
        return self.records.where(F.col("path") == path).select("file_id")

    def status(self) -> dict:
        counts = {name: df.count() for name, df in (self.overlay or {}).items()}
        changes = counts.get("upserts", 0) + counts.get("tombstones", 0)
        return {"generation": self.number, "base": self.base_number, "records": self.records.count(), "changes": changes, **self.notes}


class Catalog:
    """Generations below ``root``. Records have ``file_id, path, size, modified_ns`` and more; files ``file_id, text``."""

    def __init__(self, spark: SparkSession, root: str, block_bytes: int = grams.BLOCK_BYTES) -> None:
        self.spark, self.store, self.block_bytes = spark, Store(spark, root), block_bytes

    def _units(self, files: DataFrame) -> DataFrame:
        return grams.packed(units(files, text="text", file_id="file_id"), self.block_bytes)

    def _base(self, records: DataFrame, units: DataFrame, position: int) -> int:
        source = 0

        def index(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
            nonlocal source
            source = stored["units"].agg(F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).alias("n")).head()["n"]
            return grams.Index.build(stored["units"], source)

        # small sources are all headers; the gate is for those that a share can be taken of
        gate = lambda sizes: (sizes["postings"] + sizes["present"]) / max(source, 1 << 24)
        return self.store.publish({"metadata": metadata.searchable(records), "units": units}, gate=gate, notes={"kind": "base", "position": position}, derived=index)

    def initialise(self, records: DataFrame, files: DataFrame, position: int = 0) -> int:
        """The first generation. ``position`` is the journal's from before the scan, so no change is missed."""
        return self._base(records, self._units(files), position)

    def load(self) -> Loaded:
        """The newest sound generation and what it builds on."""
        number, tables = self.store.latest()
        found = self.store.manifest(number)
        if found["base"] is None:
            return Loaded(number, number, found["notes"], tables, None)
        return Loaded(number, found["base"], found["notes"], self.store.load(found["base"], contents=False), tables)

    def commit(self, upserts: DataFrame, tombstones: DataFrame, files: DataFrame, position: int) -> int:
        """An overlay on the newest base: records with ``content_changed``, gone ids, and the texts of changed files."""
        now = self.load()
        changed = files.join(upserts.where("content_changed").select("file_id"), "file_id", "left_semi")
        keyed = metadata.searchable(upserts.select(*[c for c in upserts.columns if c not in ("name_key", "path_key")]))
        tables = {"upserts": keyed, "tombstones": tombstones.select("file_id"), "delta": self._units(changed)}
        return self.store.publish(tables, parent=now.number, base=now.base_number, notes={"kind": "overlay", "position": position})

    def reconcile(self, observed: DataFrame, files: DataFrame, position: int = 0) -> int | None:
        """Bring the catalog to what a scan observed: an overlay, or a new base if changes are many; None if nothing changed since."""
        now, kept = self.load(), observed.is_cached
        observed = observed.persist()  # it is read several times, and may come from a scan or joins
        actions = overlay.reconcile(now.base["metadata"], observed).persist()
        try:
            if overlay.reconcile(now.records, observed).isEmpty():
                return None
            upserts = observed.join(actions.where("action <> 'delete'").select("file_id", "content_changed"), "file_id")
            self.commit(upserts, actions.where("action = 'delete'"), files, position)
            counts = actions.agg(F.count("*").alias("changes")).crossJoin(now.base["metadata"].agg(F.count("*").alias("base")))  # one row each
            due = counts.select(overlay.should_compact(F.col("changes"), F.col("base")).alias("due")).head()["due"]
        finally:
            actions.unpersist()
            if not kept:
                observed.unpersist()
        return self.compact() if due else self.store.generations()[-1]

    def compact(self) -> int:
        """A new base of what the newest generation shows. Units are taken over as they are stored, nothing is read from the files again.

        Units that are no longer valid are left out where they are read, so the others aren't shuffled; if they are of very many files,
        all are shuffled and sorted.
        """
        now = self.load()
        columns, gone = now.base["metadata"].columns, now.gone().persist()
        try:
            if now.overlay is None:
                units = now.units
            elif gone.count() <= MOST_GONE:
                kept = now.base["units"].where("file_id IS NOT NULL").join(F.broadcast(gone), "file_id", "left_anti")
                units = kept.unionByName(now.overlay["delta"])
            else:
                units = now.units.repartitionByRange("file_id").sortWithinPartitions("file_id", "line_number")
            return self._base(now.records.select(*columns), grams.packed(units.drop("block_id"), self.block_bytes), now.notes.get("position", 0))
        finally:
            gone.unpersist()

    def drifted(self, observed: DataFrame) -> DataFrame:
        """``file_id`` of records whose file has another size or time than is known, or is no longer there: their units can't be trusted."""
        return overlay.reconcile(self.load().records, observed).where("action = 'delete' OR content_changed").where("action <> 'create'").select("file_id")
