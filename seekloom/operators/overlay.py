"""A base catalog seen through changes: upserts, tombstones, and who owns a path now.

Base rows are never rewritten: a view leaves out those that are stale and adds live upserts. A change
log becomes such an overlay by its last event for each id, and its last owner of each path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import ORDER, Limits, metrics, snippets

# Fixed values of the compaction rule.
COMPACT_CHANGES = 50_000
COMPACT_SHARE = 0.02


def live(base: DataFrame, upserts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Base rows that are not stale: not deleted, not replaced, and whose path no other id took."""
    return (
        base.join(tombstones.select("file_id"), "file_id", "left_anti")
        .join(upserts.select("file_id"), "file_id", "left_anti")
        .join(upserts.select("path"), "path", "left_anti")
        .select(*base.columns)
    )


def current(base: DataFrame, upserts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """All records as they are now."""
    fresh = upserts.join(tombstones.select("file_id"), "file_id", "left_anti")
    return live(base, upserts, tombstones).unionByName(fresh.select(*base.columns))


def resolved(events: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserts and tombstones of a log: ``seq, file_id, action`` (upsert or delete), ``content_changed``, record columns.

    An id has the path of its last upsert until its next event or until another id takes that path; what loses its
    path is gone, and stays so whatever becomes of the other one. So an id is live if its last event is an upsert and the
    last one of that path. A base record (``file_id`` and, if there, ``path``) without events is gone once another id took its path.
    A change of content sticks until the id is gone; an id that the base never had leaves no tombstone. The result
    does not change if events come twice.
    """
    own, of_path = Window.partitionBy("file_id").orderBy("seq"), Window.partitionBy("path").orderBy("seq")
    taken = events.where("action = 'upsert'").withColumn("taker", F.lead("file_id").over(of_path)).withColumn("taken_at", F.lead("seq").over(of_path))
    gone = events.where("action <> 'upsert'").withColumn("taker", F.lit(None).cast(events.schema["file_id"].dataType)).withColumn("taken_at", F.lit(None).cast(events.schema["seq"].dataType))
    marked = taken.unionByName(gone).withColumn("next", F.lead("seq").over(own))
    lost = (F.col("taker") != F.col("file_id")) & (F.col("next").isNull() | (F.col("taken_at") < F.col("next")))
    marked = marked.withColumn("ended", (F.col("action") != "upsert") | F.coalesce(lost, F.lit(False)))
    # lives: an id's events between the ends of two of them
    marked = marked.withColumn("life", F.coalesce(F.sum(F.col("ended").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sticky = F.max(F.coalesce("content_changed", F.lit(False))).over(Window.partitionBy("file_id", "life"))
    latest = marked.withColumn("content_changed", sticky).where("next IS NULL")
    upserts = latest.where("NOT ended").select(*[c for c in events.columns if c != "action"])
    known = base.select("file_id")
    dead = latest.where("ended").select("file_id").join(known, "file_id", "left_semi")
    if "path" in base.columns:
        takers = events.where("action = 'upsert'").select("path", F.col("file_id").alias("taker"))
        without = base.select("file_id", "path").join(events.select("file_id"), "file_id", "left_anti")
        dead = dead.unionByName(without.join(takers, (without["path"] == takers["path"]) & (F.col("file_id") != F.col("taker")), "left_semi").select("file_id"))
    return upserts, dead.distinct()


def metadata_search(base: DataFrame, upserts: DataFrame, tombstones: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Matches among the upserts by id, then among live base rows by id: the first ``limit``."""
    fresh = upserts.join(tombstones.select("file_id"), "file_id", "left_anti").where(condition).select(*base.columns).withColumn("from_base", F.lit(0))
    old = live(base, upserts, tombstones).where(condition).withColumn("from_base", F.lit(1))
    return fresh.unionByName(old).orderBy("from_base", "file_id").limit(limit)


def content_hits(base_hits: DataFrame, delta_hits: DataFrame, upserts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Hits seen through the overlay: ``file_id, path, line_number, byte_offset``.

    ``base_hits`` and ``delta_hits`` have those columns. A file whose content changed is searched in the delta only;
    one that only moved keeps its hits under its new path.
    """
    changed = upserts.where("content_changed").select("file_id")
    moved = upserts.select("file_id", F.col("path").alias("new_path"))
    taken = upserts.select(F.col("path"), F.col("file_id").alias("owner"))
    base = base_hits.join(tombstones.select("file_id"), "file_id", "left_anti").join(changed, "file_id", "left_anti")
    base = base.join(taken, "path", "left").where("owner IS NULL OR owner = file_id").drop("owner")
    base = base.join(moved, "file_id", "left").withColumn("path", F.coalesce("new_path", "path")).select("file_id", "path", "line_number", "byte_offset")
    fresh = delta_hits.join(tombstones.select("file_id"), "file_id", "left_anti").select("file_id", "path", "line_number", "byte_offset")
    return base.unionByName(fresh).dropDuplicates(["file_id", "line_number", "byte_offset"])


def reconcile(known: DataFrame, observed: DataFrame) -> DataFrame:
    """``file_id, action, content_changed``: what turns the known records into the observed ones."""
    a, b = known.alias("a"), observed.alias("b")
    both = a.join(b, F.col("a.file_id") == F.col("b.file_id"), "full")
    content = (F.col("a.size") != F.col("b.size")) | (F.col("a.modified_ns") != F.col("b.modified_ns"))
    action = (
        F.when(F.col("a.file_id").isNull(), "create")
        .when(F.col("b.file_id").isNull(), "delete")
        .when(F.col("a.path") != F.col("b.path"), "rename")
        .when(content, "modify")
    )
    changed = F.when(F.col("a.file_id").isNull(), True).when(F.col("b.file_id").isNull(), False).otherwise(content)
    return both.select(F.coalesce("a.file_id", "b.file_id").alias("file_id"), action.alias("action"), changed.alias("content_changed")).where("action IS NOT NULL")


def should_compact(changes: Column, base_rows: Column) -> Column:
    share = F.greatest(F.lit(1), F.ceil(base_rows * F.lit(COMPACT_SHARE)))
    return (changes >= COMPACT_CHANGES) | (changes >= share)


def limited_content(base_hits: DataFrame, delta_hits: DataFrame, limits: Limits) -> DataFrame:
    """Hits of the base within ``limits``, then hits of the delta within what is left of them; none if a limit is 0."""
    if limits.max_files <= 0 or limits.max_matches <= 0:
        return snippets(base_hits, limits).where(F.lit(False))
    seen = metrics(base_hits, limits).head()  # three counts
    files, matches = limits.max_files - seen["files_matched"], limits.max_matches - seen["matches_seen"]
    shown = snippets(base_hits, limits)
    if files <= 0 or matches <= 0:
        return shown
    fresh = snippets(delta_hits, Limits(files, matches, limits.snippets))
    return shown.unionByName(fresh.join(shown, list(ORDER), "left_anti"))


#: A first batch that has so many hits from the base asks the delta for none.
FIRST_BATCH = 100


def first_content(base_hits: DataFrame, delta_hits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The first hits of the base; if they are fewer than ``FIRST_BATCH``, the delta's first ones fill up to that."""
    shown = snippets(base_hits, limits).withColumn("from_delta", F.lit(0))
    left = FIRST_BATCH - shown.count()
    if left <= 0:
        return shown.drop("from_delta")
    fresh = snippets(delta_hits, limits).join(shown, list(ORDER), "left_anti").orderBy(*ORDER).limit(left)
    return shown.drop("from_delta").unionByName(fresh)
