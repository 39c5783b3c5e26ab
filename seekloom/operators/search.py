"""Content search over normalised units: literals, patterns, and limits on hits.

Units come from :func:`seekloom.functions.text.normalised_units`, inline or read from a store. A hit is
``file_id, line_number, byte_offset``: every start of a match, overlapping ones too, as a
byte offset in the unit's own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import small_batches, trimmed
from ..functions.pattern import Pattern, compile_regex, compile_wildcard
from ..functions.text import normalise_query, starts_of

ORDER = ("file_id", "line_number", "byte_offset")


@dataclass(frozen=True)
class Limits:
    max_files: int = 100
    max_matches: int = 500
    snippets: int = 3


def _no_hits(units: DataFrame) -> DataFrame:
    return units.select("file_id", "line_number", F.lit(0).alias("byte_offset")).where(F.lit(False))


def literal_units(units: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """The units that hold the query, as they are."""
    needle = normalise_query(query, case_sensitive)
    return units.where(F.contains("folded", F.lit(needle)) if needle else F.lit(False))


def literal_hits(units: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """All hits of a literal, overlapping ones too; none of an empty one.

    Only units that hold it leave the JVM; a batch of those is searched as one run of bytes.
    """
    needle = normalise_query(query, case_sensitive).encode()
    if not needle:
        return _no_hits(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded, data, ends = batch.column(2), *text_bytes(batch.column(2))
            found, at = [], data.find(needle)
            while at >= 0:
                found.append(at)
                at = data.find(needle, at + 1)
            places = np.array(found, np.int64)
            rows = np.searchsorted(ends, places, "right") - 1
            inside = places + len(needle) <= ends[rows + 1]  # else it runs over into the next unit
            rows, offsets = rows[inside], (places - ends[rows])[inside]
            origins, kept = batch.column(3), np.ones(len(rows), bool)
            for row in np.unique(rows[~origins.is_null().to_numpy(zero_copy_only=False)[rows]]) if len(rows) else ():
                own, raw, of = np.flatnonzero(rows == row), folded[int(row)].as_py().encode(), origins[int(row)].as_py()
                moved = np.array([of[len(raw[:k].decode())] for k in offsets[own].tolist()])
                offsets[own] = moved
                kept[own[1:]] = moved[1:] != moved[:-1]  # neighbours from one character count once
            rows, offsets = pa.array(rows[kept]), pa.array(offsets[kept].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), offsets], list(ORDER))

    small_batches(units.sparkSession)
    kept = literal_units(units, query, case_sensitive).select("file_id", "line_number", "folded", "origins")
    return kept.mapInArrow(trimmed(run), T.StructType([kept.schema["file_id"], kept.schema["line_number"], T.StructField("byte_offset", T.IntegerType())]))


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a column of texts one after the other, and where each begins (and the last ends)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""), ends - ends[0]


def pattern_units(units: DataFrame, pattern: Pattern) -> DataFrame:
    """The units in which the pattern matches somewhere.

    The literal that each match must hold goes first; patterns on which Java's matcher could
    take very long, or whose classes it knows from other tables, are left to Python.
    """
    small_batches(units.sparkSession)
    if pattern.mandatory:
        units = units.where(F.contains("folded", F.lit(pattern.mandatory)))
    if pattern.in_jvm:
        return units.where(F.rlike("folded", F.lit(pattern.java)))

    @F.pandas_udf("boolean")
    def matches(folded: pd.Series) -> pd.Series:
        return folded.map(lambda t: t is not None and bool(pattern.starts(t)))

    return units.where(matches("folded"))


def pattern_hits(units: DataFrame, pattern: Pattern) -> DataFrame:
    """All starts of matches of a pattern."""
    small_batches(units.sparkSession)
    if pattern.mandatory:
        units = units.where(F.contains("folded", F.lit(pattern.mandatory)))
    if pattern.in_jvm:
        units = units.where(F.rlike("folded", F.lit(pattern.java)))  # few units reach Python

    @F.pandas_udf("array<int>")
    def starts(raw: pd.Series, folded: pd.Series, origins: pd.Series) -> pd.Series:
        return pd.Series([[] if f is None else starts_of(r, f, None if o is None else list(o), pattern.starts(f)) for r, f, o in zip(raw, folded, origins, strict=True)])

    return units.select("file_id", "line_number", F.explode(starts("raw", "folded", "origins")).alias("byte_offset"))


def regex_hits(units: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    return pattern_hits(units, compile_regex(pattern, case_sensitive))


def wildcard_hits(units: DataFrame, pattern: str, case_sensitive: bool = False) -> DataFrame:
    return pattern_hits(units, compile_wildcard(pattern, case_sensitive))


def hits(units: DataFrame, query: str, kind: str = "literal", case_sensitive: bool = False) -> DataFrame:
    """Hits of a ``literal``, ``regex`` or ``wildcard``."""
    return {"literal": literal_hits, "regex": regex_hits, "wildcard": wildcard_hits}[kind](units, query, case_sensitive)


def first_batch(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The hits a search reports that stops as soon as it has enough files or matches.

    The match that reaches a limit is kept, so the last file has one. Only the first
    ``max_matches`` hits in order matter, and a bounded sort takes those from each partition; the
    numbering then runs over no more rows than that.
    """
    if limits.max_matches <= 0 or limits.max_files <= 0:
        head = found.orderBy(*ORDER).limit(1)
    else:
        head = found.orderBy(*ORDER).limit(limits.max_matches)
    order = Window.orderBy(*ORDER)
    numbered = head.select(*ORDER, F.row_number().over(order).alias("match_number"), F.dense_rank().over(Window.orderBy("file_id")).alias("file_number"), F.row_number().over(Window.partitionBy("file_id").orderBy(*ORDER)).alias("snippet_number"))
    stop = F.min(F.when(F.col("file_number") >= limits.max_files, F.col("match_number"))).over(Window.partitionBy(F.lit(1)))
    kept = numbered.withColumn("stop", stop).where("stop IS NULL OR match_number <= stop")
    return kept.select(*ORDER, "match_number", "file_number", "snippet_number")


def snippets(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The hits of :func:`first_batch` that are shown: a few of each file."""
    return first_batch(found, limits).where(F.col("snippet_number") <= limits.snippets).select(*ORDER)


def metrics(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: matches seen, files with matches, snippets returned."""
    return first_batch(found, limits).agg(
        F.count("*").alias("matches_seen"),
        F.coalesce(F.max("file_number"), F.lit(0)).cast("long").alias("files_matched"),
        F.coalesce(F.sum(F.when(F.col("snippet_number") <= limits.snippets, 1).otherwise(0)), F.lit(0)).cast("long").alias("returned_snippets"),
    )


def hits_by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("file_id").agg(F.count("*").alias("matches"))

