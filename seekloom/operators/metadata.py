"""File records and searches on their names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, canonical_path, normalise_query, normalised, path_order

#: Results if a search names no limit.
DEFAULT_RESULTS = 100


def of_documents(docs: DataFrame) -> DataFrame:
    """A record for each document: ``file_id, path, size, modified_ns, kind, content_searchable``."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("doc_id").alias("file_id"),
        path.alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("doc_id").cast("decimal(38,0)").alias("modified_ns"),
        F.lit("File").alias("kind"),
        F.lit(True).alias("content_searchable"),
    )


def searchable(records: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Records with ``name_key`` and ``path_key``, normalised once. Paths take either separator.

    Records that have the keys already, as a stored catalog's do, stay as they are.
    """
    if not case_sensitive and {"name_key", "path_key"} <= set(records.columns):
        return records
    records = records.select(*[c for c in records.columns if c not in ("name_key", "path_key")])
    path = canonical_path(F.col("path"))
    name = basename(F.col("path"))
    made = records.withColumn("p", normalised(path, case_sensitive)).withColumn("n", normalised(name, case_sensitive))
    return made.select(*records.columns, F.col("n.folded").alias("name_key"), F.col("p.folded").alias("path_key"))


def predicate(filename: str | None = None, path: str | None = None, case_sensitive: bool = False) -> Column:
    """Both queries hold; a query that is missing or empty is no condition, but one of them must be there."""
    parts = []
    if filename:
        parts.append(F.contains("name_key", F.lit(normalise_query(filename, case_sensitive))))
    if path:
        parts.append(F.contains("path_key", F.lit(normalise_query(path.replace("\\", "/"), case_sensitive))))
    if not parts:
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))


def search(records: DataFrame, filename: str | None = None, path: str | None = None, case_sensitive: bool = False, limit: int = 0, order: tuple = ("file_id",)) -> DataFrame:
    """Matching records in order, the first ``limit`` (0: the default number)."""
    found = searchable(records, case_sensitive).where(predicate(filename, path, case_sensitive))
    return found.orderBy(*order).limit(limit or DEFAULT_RESULTS).select(*records.columns)


def numbered(records: DataFrame) -> DataFrame:
    """``path_rank``: a record's place in the order of paths by their parts, from 0.

    Ranges of paths are sorted apart; the counts of earlier ranges, one number for each, are added.
    """
    ranged = records.withColumn("k", path_order(F.col("path"))).repartitionByRange("k").sortWithinPartitions("k", "file_id")
    placed = ranged.withColumn("at", F.monotonically_increasing_id())
    placed = placed.withColumn("range", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    shared = placed.sparkSession.sparkContext.getCheckpointDir()
    placed = placed.checkpoint() if shared else placed.persist()
    counts = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}
    before, rows = 0, []
    for k in sorted(counts):
        rows.append((k, before))
        before += counts[k]
    offsets = placed.sparkSession.createDataFrame(rows, "range long, before long")
    return placed.join(F.broadcast(offsets), "range").select(*records.columns, (F.col("before") + F.col("within")).alias("path_rank"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids that more than one record has; a catalog with any is refused."""
    return records.groupBy("file_id").agg(F.count("*").alias("records")).where("records > 1")
