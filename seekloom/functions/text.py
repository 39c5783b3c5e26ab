"""Logical units, Unicode normalisation with origins, previews and formats."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small_batches

#: What results depend on: a change makes stored units unusable.
SEMANTIC_ID = f"nfc-fullfold-unicode-{unicodedata.unidata_version}"

NORMAL = T.StructType(
    [
        T.StructField("folded", T.StringType()),
        T.StructField("identity", T.BooleanType()),
        T.StructField("origins", T.ArrayType(T.IntegerType())),
    ]
)


# --- normalisation ---------------------------------------------------------


def _recompose(chars: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Canonical composition of ``(char, origin)``; a composed character has its starter's origin."""
    apart = [(d, o) for c, o in chars for d in unicodedata.normalize("NFD", c)]
    ordered: list[tuple[str, int]] = []
    marks: list[tuple[str, int]] = []
    for d, o in apart:
        if unicodedata.combining(d):
            marks.append((d, o))
            continue
        ordered += sorted(marks, key=lambda m: unicodedata.combining(m[0]))
        marks = []
        ordered.append((d, o))
    ordered += sorted(marks, key=lambda m: unicodedata.combining(m[0]))
    out: list[tuple[str, int]] = []
    starter, previous = -1, 0
    for d, o in ordered:
        ccc = unicodedata.combining(d)
        if starter >= 0 and (starter == len(out) - 1 or previous < ccc):
            joined = unicodedata.normalize("NFC", out[starter][0] + d)
            if len(joined) == 1:
                out[starter] = (joined, out[starter][1])
                continue
        if ccc == 0:
            starter = len(out)
        previous = ccc
        out.append((d, o))
    return out


@lru_cache(maxsize=1)
def _resized() -> re.Pattern:
    """The characters whose folded form is of several characters or takes another number of bytes."""
    found = []
    for low in range(0, 0x110000, 256):
        some = "".join(map(chr, range(low, low + 256)))
        if some.casefold() != some:
            found += [c for c in some if c.casefold() != c and (len(c.casefold()) > 1 or len(c.casefold().encode()) != len(c.encode()))]
    return re.compile(f"[{re.escape(''.join(found))}]")


def _folded_origins(text: str) -> np.ndarray:
    """For each character of the folded text, where the one that it comes from begins in ``text``, in bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.int8)
    starts = np.flatnonzero(data >= -64).astype(np.int32)  # bytes that continue a character are below
    times = np.ones(len(starts), np.int64)
    for found in _resized().finditer(text):
        times[found.start()] = len(found[0].casefold())
    return np.repeat(starts, times)


def fold(text: str) -> str:
    """The text of :func:`normalise`, where no offsets are needed."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def normalise(text: str, case_sensitive: bool = False) -> tuple[str, list[int] | None]:
    """NFC text, fully case-folded unless ``case_sensitive``, and the byte offset in ``text`` of
    the character behind each of its characters. The offsets are None where each of the characters
    stands for the one at the same place and takes as many bytes.
    """
    normal, origins = _normal(text, case_sensitive)
    return normal, origins.tolist() if isinstance(origins, np.ndarray) else origins


def _normal(text: str, case_sensitive: bool) -> tuple[str, np.ndarray | list[int] | None]:
    """What :func:`normalise` gives, the offsets perhaps as an array."""
    if text.isascii():
        return (text if case_sensitive else text.lower()), None
    nfc = unicodedata.is_normalized("NFC", text)
    if nfc:
        if case_sensitive:
            return text, None
        folded = text.casefold()
        if unicodedata.is_normalized("NFC", folded):
            return folded, _folded_origins(text) if _resized().search(text) else None
    chars, at = [], 0
    for c in text:
        chars.append((c, at))
        at += len(c.encode("utf-8", "surrogatepass"))
    if not nfc:
        chars = _recompose(chars)
    if not case_sensitive:
        folded_chars = [(f, o) for c, o in chars for f in c.casefold()]
        joined = "".join(c for c, _ in folded_chars)
        chars = folded_chars if unicodedata.is_normalized("NFC", joined) else _recompose(folded_chars)
    return "".join(c for c, _ in chars), [o for _, o in chars]


def normalise_query(query: str, case_sensitive: bool = False) -> str:
    return normalise(query, case_sensitive)[0]


def starts_of(text: str, normal: str, origins: list[int] | None, places: list[int]) -> list[int]:
    """Byte offsets in ``text`` of match starts in ``normal``, given as places of characters.

    The place behind the last character is the end of ``text``. Equal neighbours count once.
    """
    if origins is None:
        out, at, size = [], 0, 0
        for p in places:
            size += len(normal[at:p].encode("utf-8", "surrogatepass"))
            at = p
            out.append(size)
        return out
    end, out = len(text.encode("utf-8", "surrogatepass")), []
    for p in places:
        o = origins[p] if p < len(origins) else end
        if not out or out[-1] != o:
            out.append(o)
    return out


def literal_places(text: str, needle: str) -> list[int]:
    """All starts of ``needle``, overlapping ones too."""
    places, at = [], text.find(needle)
    while at >= 0:
        places.append(at)
        at = text.find(needle, at + 1)
    return places


def normal_forms(raw: pa.Array, case_sensitive: bool = False) -> list[pa.Array]:
    """``folded``, ``identity`` and ``origins`` of a batch's texts."""
    made = [(None, None) if text is None else _normal(text, case_sensitive) for text in raw.to_pylist()]
    folded = pa.array([f for f, _ in made], pa.string())
    same = pa.array([None if f is None else o is None for f, o in made], pa.bool_())
    ends = np.cumsum([0, *(0 if o is None else len(o) for _, o in made)], dtype=np.int32)
    values = np.concatenate([np.zeros(0, np.int32), *(np.asarray(o, np.int32) for _, o in made if o is not None)])
    return [folded, same, pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([o is None for _, o in made], pa.bool_()))]


@lru_cache(maxsize=8)
def _normalise_udf(case_sensitive: bool):
    @F.arrow_udf(NORMAL)
    def run(raw: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(normal_forms(raw, case_sensitive), NORMAL.names)

    return run.asNondeterministic()  # else the optimizer runs it once for each use


def normalised(raw: Column, case_sensitive: bool = False) -> Column:
    """Struct of ``folded``, ``identity`` and ``origins``. ASCII never leaves the JVM."""
    plain = F.octet_length(raw) == F.length(raw)
    made = _normalise_udf(case_sensitive)(F.when(~plain, raw))
    simple = F.struct((raw if case_sensitive else F.lower(raw)).alias("folded"), F.lit(True).alias("identity"), F.lit(None).cast("array<int>").alias("origins"))
    return F.when(plain, simple).otherwise(made)


# --- units -----------------------------------------------------------------


def _without(text: Column, end: str) -> Column:
    """A text without one such character at its end; far cheaper than a pattern."""
    return F.when(F.endswith(text, F.lit(end)), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def units(files: DataFrame, text: str = "text", file_id: str = "doc_id") -> DataFrame:
    """``file_id, line_number, raw`` of each logical line; files with null text have none.

    One line end at the end makes no further line, and an empty text is one.
    """
    parts = F.split(_without(F.col(text), "\n"), "\n", -1)
    made = files.where(F.col(text).isNotNull()).select(F.col(file_id).alias("file_id"), F.posexplode(parts).alias("line_number", "raw"))
    return made.select("file_id", (F.col("line_number") + 1).alias("line_number"), _without(F.col("raw"), "\r").alias("raw"))


def normalised_units(files: DataFrame, case_sensitive: bool = False, **names: str) -> DataFrame:
    """:func:`units` with ``folded``, ``identity`` and ``origins``: what ingest stores."""
    small_batches(files.sparkSession)
    made = units(files, **names).withColumn("n", normalised(F.col("raw"), case_sensitive))
    return made.select("file_id", "line_number", "raw", "n.folded", "n.identity", "n.origins")


def unit_offsets(files: DataFrame, text: str = "text", file_id: str = "doc_id") -> DataFrame:
    """``file_id, line_number, start, end``: byte offsets in the file, line ends not included."""
    parts = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)
    made = files.where(F.col(text).isNotNull()).select(F.col(file_id).alias("file_id"), F.posexplode(parts).alias("n", "raw"))
    before = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0))
    made = made.withColumn("start", start.cast("long"))
    return made.select("file_id", (F.col("n") + 1).alias("line_number"), "start", (F.col("start") + F.octet_length(F.regexp_replace("raw", r"\r\z", ""))).cast("long").alias("end"))


def block_sizes(text: Column, limit: int) -> Column:
    """Blocks of a text's lines, packed in order up to ``limit`` bytes each: ``units, bytes``. A larger line is a block of its own."""
    sizes = F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1), lambda x: (F.octet_length(x) + 1).cast("long"))
    one = lambda n, b: F.struct(n.alias("units"), b.alias("bytes"))
    empty = F.array().cast("array<struct<units:bigint,bytes:bigint>>")

    def put(acc: Column, size: Column) -> Column:
        full = acc["filled"] + size > limit
        return F.struct(
            F.when(full & (acc["n"] > 0), F.concat(acc["done"], F.array(one(acc["n"], acc["filled"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, size).otherwise(acc["filled"] + size).alias("filled"),
        )

    start = F.struct(empty.alias("done"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("filled"))
    return F.aggregate(sizes, start, put, lambda acc: F.concat(acc["done"], F.array(one(acc["n"], acc["filled"]))))


# --- paths and presentation ------------------------------------------------


def canonical_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_order(path: Column) -> Column:
    """Paths are sorted by their parts, not as strings."""
    return F.split(path, "/")


def preview(text: Column, byte_offset: Column, width: int = 180) -> Column:
    """At most ``width`` characters around a byte offset, with an ellipsis on cut sides."""
    at = F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), byte_offset.cast("int")), "UTF-8"))
    size = F.length(text)
    start = F.greatest(F.least(at - width // 2, size - width), F.lit(0))
    return F.concat(
        F.when(start > 0, "…").otherwise(""),
        F.substring(text, start + 1, F.lit(width)),
        F.when(start + width < size, "…").otherwise(""),
    )


def location(line_number: Column, byte_offset: Column, unit: str = "Line") -> Column:
    return F.concat(F.lit(f"{unit} "), line_number.cast("string"), F.lit(" · byte "), byte_offset.cast("string"))


def file_size(size: Column) -> Column:
    units_ = [(1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")]
    out = F.concat(size.cast("string"), F.lit(" B"))
    for limit, name in reversed(units_):
        out = F.when(size >= limit, F.format_string(f"%.1f {name}", F.bround(size / F.lit(float(limit)), 1))).otherwise(out)
    return out


def modified_utc(ns: str) -> Column:
    """The UTC time of a column of nanoseconds, to the second; a dash for 0."""
    seconds = F.expr(f"CAST(`{ns}` DIV 1000000000 AS BIGINT)")  # a double would lose nanoseconds
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.col(ns) == 0, "—").otherwise(F.concat(stamp, F.lit("Z")))
