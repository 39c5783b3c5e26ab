"""Change journals: normalised events, the safe position to resume from, and paths of a file tree.

A journal row is ``file_reference, parent_reference, usn, reason, attributes, name``; reasons are bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the journal format, version 2.
DATA_OVERWRITE = 0x00000001
DATA_EXTEND = 0x00000002
DATA_TRUNCATION = 0x00000004
FILE_CREATE = 0x00000100
FILE_DELETE = 0x00000200
RENAME_OLD = 0x00001000
RENAME_NEW = 0x00002000
BASIC_INFO = 0x00008000
HARD_LINK = 0x00010000
CLOSE = 0x80000000
DIRECTORY = 0x10
HEADER_BYTES = 60
CHANGED = DATA_OVERWRITE | DATA_EXTEND | DATA_TRUNCATION | BASIC_INFO

SCHEMA = "file_reference long, parent_reference long, usn long, reason long, attributes long, name string"
EVENT_SCHEMA = "usn long, file_reference long, action string, old_name string, new_name string, is_directory boolean"


def parse(buffer: bytes) -> Iterator[tuple]:
    """Records of a binary buffer; anything malformed is an error."""
    at = 0
    while at < len(buffer):
        if len(buffer) - at < HEADER_BYTES:
            raise ValueError("a journal record is cut off")
        length, major, _, ref, parent, usn, _, reason, _, _, attributes, name_bytes, name_at = struct.unpack_from("<IHHQQqqIIIIHH", buffer, at)
        if length < HEADER_BYTES or at + length > len(buffer) or major != 2 or name_at + name_bytes > length or name_bytes % 2:
            raise ValueError("a journal record is malformed")
        name = buffer[at + name_at : at + name_at + name_bytes].decode("utf-16-le")
        yield ref - (1 << 64) * (ref >> 63), parent - (1 << 64) * (parent >> 63), usn, reason, attributes, name
        at += length


def records(buffers: DataFrame, column: str = "buffer") -> DataFrame:
    """Rows of all records in a column of binary buffers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for b in batch[column] if b is not None for r in parse(bytes(b))], columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return buffers.select(column).mapInPandas(run, SCHEMA)


def _has(bit: int, reason: str = "reason") -> Column:
    return F.col(reason).bitwiseAND(F.lit(bit)) != 0


def normalise(journal: DataFrame) -> DataFrame:
    """``usn, file_reference, action, old_name, new_name, is_directory`` of a finished batch.

    A hard-link change asks for a reconcile besides whatever else a row says. Of the rest the first that
    holds counts: the old name of a rename (kept until its new one comes), a new name, a creation, a
    deletion, a change. A new name without an old one asks for a reconcile.
    """
    earlier = Window.partitionBy("file_reference").orderBy("usn").rowsBetween(Window.unboundedPreceding, -1)
    is_old = _has(RENAME_OLD)
    is_new = ~is_old & _has(RENAME_NEW)
    marked = journal.withColumn("old_at", F.max(F.when(is_old, F.col("usn"))).over(earlier)).withColumn("new_at", F.max(F.when(is_new, F.col("usn"))).over(earlier))
    marked = marked.withColumn("kept", F.last(F.when(is_old, F.col("name")), ignorenulls=True).over(earlier))
    waits = F.col("old_at").isNotNull() & (F.col("new_at").isNull() | (F.col("old_at") > F.col("new_at")))
    main = (
        F.when(is_old, None)
        .when(_has(RENAME_NEW), F.when(waits, "rename").otherwise("reconcile"))
        .when(_has(FILE_CREATE), "create")
        .when(_has(FILE_DELETE), "delete")
        .when(_has(CHANGED), "modify")
    )
    actions = F.filter(F.array(F.when(_has(HARD_LINK), "reconcile"), main), lambda x: x.isNotNull())
    out = marked.select("usn", "file_reference", F.explode(actions).alias("action"), "kept", "name", _has(DIRECTORY, "attributes").alias("is_directory"))
    return out.select("usn", "file_reference", "action", F.when(F.col("action") == "rename", F.col("kept")).alias("old_name"), F.when(F.col("action") != "reconcile", F.col("name")).alias("new_name"), "is_directory")


def checkpoint(journal: DataFrame, observed_next: int | None = None, pending: DataFrame | None = None) -> DataFrame:
    """One row, ``next_usn``: no later than any old name of this batch or still pending from others.

    If ``observed_next`` isn't given, it is one past the batch's last row.
    """
    held = journal.select(F.when(_has(RENAME_OLD), F.col("usn")).alias("usn"), F.col("usn").alias("seen"))
    if pending is not None:
        held = held.unionByName(pending.select("usn", F.lit(None).cast("long").alias("seen")))
    after = F.max("seen") + 1 if observed_next is None else F.lit(observed_next).cast("long")
    return held.agg(F.least(F.min("usn"), after).alias("next_usn"))


def valid(checkpoint_id: Column, next_usn: Column, journal_id: Column, first: Column, last: Column) -> Column:
    """Whether reading can go on there; else the journal was reset or has a gap, and all must be reconciled."""
    return (checkpoint_id == journal_id) & (next_usn >= first) & (next_usn <= last)


def _jumps(tree: DataFrame) -> Iterator[DataFrame]:
    """``file_id, up, path, depth`` again and again: ``up`` is twice as far above as before, null at a root.

    ``path`` is from below ``up`` down to the node. A node in a cycle, or below a missing parent, is left out once that is seen.
    Each round is written or kept, and there are as many as the depth has bits.
    """
    spark = tree.sparkSession
    up = F.when(F.col("parent") != F.col("file_id"), F.col("parent"))
    now = tree.select("file_id", up.alias("up"), F.col("name").alias("path"), F.lit(1).alias("depth"))
    nodes = tree.count()
    for _ in range(max(1, nodes.bit_length()) + 1):
        now = now.checkpoint() if spark.sparkContext.getCheckpointDir() else now.persist()
        yield now
        above = now.select(F.col("file_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"), F.col("depth").alias("more"))
        done = now.where("up IS NULL")
        open_ = now.where("up IS NOT NULL").join(above, "up").where((F.col("depth") + F.col("more")) <= nodes)
        now = done.unionByName(open_.select("file_id", F.col("next").alias("up"), F.concat_ws("/", "above", "path").alias("path"), (F.col("depth") + F.col("more")).alias("depth")))


def paths(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """``file_id, path`` of each node of ``file_id, parent, name``; a root is its own parent or has none.

    Nodes in a cycle, or below a missing parent, are not reached and have no row. Ways double in each round, so a tree of any depth
    takes a few.
    """
    for now in _jumps(tree):
        if now.where("up IS NOT NULL").isEmpty():
            break
    return now.where("up IS NULL").select("file_id", "path")


def descendants(spark: SparkSession, tree: DataFrame, root: int) -> DataFrame:
    """``file_id, depth`` of all nodes below ``root``: the root's parent is cut off, and depths are those of what reaches it."""
    cut = tree.select("file_id", F.when(F.col("file_id") != F.lit(root), F.col("parent")).alias("parent"), F.lit("").alias("name"), F.lit(0).alias("n"))
    # only the wanted root counts as one: others' nodes have a parent that isn't there
    cut = cut.withColumn("parent", F.when((F.col("file_id") != F.lit(root)) & (F.col("parent").isNull() | (F.col("parent") == F.col("file_id"))), F.lit(None).cast("long")).otherwise(F.col("parent")))
    cut = cut.where((F.col("file_id") == F.lit(root)) | F.col("parent").isNotNull()).select("file_id", "parent", "name")
    for now in _jumps(cut):
        if now.where("up IS NOT NULL").isEmpty():
            break
    return now.where((F.col("up").isNull()) & (F.col("file_id") != F.lit(root))).select("file_id", (F.col("depth") - 1).alias("depth"))


def known_events(events: DataFrame, known: DataFrame, root: int) -> DataFrame:
    """The events that concern a catalog: of a known file, or of one below a known folder or below the root."""
    ids = known.select(F.col("file_id").alias("id")).unionByName(events.sparkSession.createDataFrame([(root,)], "id long")).distinct()
    own = events.join(ids, F.col("file_reference") == F.col("id"), "left_semi")
    rest = events.join(ids, F.col("file_reference") == F.col("id"), "left_anti")
    return own.unionByName(rest.join(ids, F.col("parent_reference") == F.col("id"), "left_semi"))
