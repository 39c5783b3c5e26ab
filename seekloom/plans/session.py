"""A search session: files by name or path, content, or both, as rows with their matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, location, path_order, preview
from ..operators import metadata as m
from ..operators.search import Limits, hits, snippets


@dataclass(frozen=True)
class Request:
    file: str = ""
    content: str = ""
    kind: str = "literal"
    full_path: bool = False
    case_sensitive: bool = False
    max_files: int = 100
    #: Limit first and filter by file afterwards, as an interactive search that stops early does.
    filter_after_limits: bool = False


class Session:
    """Over records (see :mod:`seekloom.operators.metadata`) and normalised units."""

    def __init__(self, records: DataFrame, units: DataFrame) -> None:
        self.records, self.units = records, units

    def _files(self, request: Request) -> DataFrame:
        query = request.file.strip()
        keyed = m.searchable(self.records, request.case_sensitive)
        condition = m.predicate(**{"path" if request.full_path else "filename": query}, case_sensitive=request.case_sensitive)
        return keyed.where(condition).select(*self.records.columns)

    def matches(self, request: Request) -> DataFrame:
        """``file_id, line_number, byte_offset, location, preview``, at most a few for each file."""
        limits = Limits(request.max_files, max(5 * request.max_files, 500))
        units = self.units
        by_file = bool(request.file.strip())
        if by_file and not request.filter_after_limits:
            units = units.join(self._files(request).select("file_id"), "file_id", "left_semi")
        found = snippets(hits(units, request.content.strip(), request.kind, request.case_sensitive), limits)
        if by_file and request.filter_after_limits:
            found = found.join(self._files(request).select("file_id"), "file_id", "left_semi")
        # at most 500 or 5 x max_files rows are joined back to their units' text
        shown = self.units.select("file_id", "line_number", "raw").join(F.broadcast(found), ["file_id", "line_number"])
        return shown.select("file_id", "line_number", "byte_offset", location(F.col("line_number"), F.col("byte_offset")).alias("location"), preview(F.col("raw"), F.col("byte_offset")).alias("preview"))

    def search(self, request: Request) -> DataFrame:
        """Result rows in order of name, path, id: record columns, ``name`` and nested ``matches``."""
        name = basename(F.col("path")).alias("name")
        if not request.content.strip():
            rows = self._files(request).select(*self.records.columns, name, F.array().cast("array<struct<line_number:int,byte_offset:int,location:string,preview:string>>").alias("matches"))
        else:
            shown = self.matches(request)
            nested = shown.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line_number", "byte_offset", "location", "preview"))).alias("matches"))
            rows = self.records.join(F.broadcast(nested), "file_id").select(*self.records.columns, name, "matches")
        return rows.orderBy(F.lower("name"), path_order(F.col("path")), "file_id").limit(request.max_files)
