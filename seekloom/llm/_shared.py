"""Helpers that the operators of this subpackage share.

Nothing outside ``seekloom.llm`` imports this module.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Everything that is not part of a normalised word: ASCII other than digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables of at most this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is named by ``spark.checkpoint.dir``. Only on a local master, where that is unset (tests),
    a folder of this machine is taken; on a cluster that would be a folder that others can't see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seekloom-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path and what is below it, on any file system that Hadoop knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Folder:
    """Intermediate tables below a new path of the shared folder.

    A table is written as Parquet and read again, so its lineage ends there and a lost executor costs
    no more than reading its files once more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self._tables = spark, scratch(spark, name), []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self._tables)}"
        df.write.parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((held, path))
        return held

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that :meth:`cut` made and nothing reads any more."""
        for held, path in self._tables:
            if any(held is t for t in tables):
                remove(self.spark, path)


#: Rows and bytes that a Python worker is handed at a time.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on an Arrow batch, if they are higher: a batch is in memory several times, in the JVM and in Python."""
    parse = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if not 0 < parse(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)


def trim() -> None:
    """Give freed memory back to the system: a worker stays alive, idle, beside later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, and :func:`trim` after it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.

    ``lower`` is the fast path for texts that are ASCII only.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column, lower: Column | None = None) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    flat = F.regexp_replace(ascii_lower(text) if lower is None else lower, NOT_WORD, " ")
    return F.coalesce(F.array_remove(F.split(flat, " "), ""), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column, chunk: int = 256) -> Column:
    """The sum of an int array's values up to each. Sums are laid out chunk by chunk, so a long array isn't copied for each value."""
    nothing = F.array().cast("array<int>")

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), nothing.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(values, first, step, lambda acc: acc["out"])

    zero = F.lit(0).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(chunk))
    totals = F.transform(starts, lambda at: F.aggregate(F.slice(sizes, at, F.lit(chunk)), zero, lambda acc, x: acc + x))
    many = let(F.concat(F.array(zero), sums(totals, zero)), lambda before: F.flatten(F.transform(starts, lambda at, i: sums(F.slice(sizes, at, F.lit(chunk)), F.get(before, i)))))
    return F.when(F.size(sizes) > chunk, many).otherwise(sums(sizes, zero))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores added until no column of ``df`` clashes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType):
            each = F.aggregate(value, F.lit(0).cast("long"), lambda acc, x: acc + _bytes(kind.elementType, x))
        else:
            each = F.size(value).cast("long") * 16
        return F.coalesce(each, F.lit(0).cast("long")) + 24
    return F.lit(16).cast("long")


def sized(df: DataFrame, work: Folder | None = None) -> DataFrame:
    """``df``, written and read again, and marked for a broadcast if its rows are measured to be small together.

    A table of more than ``BROADCAST_BYTES`` is joined by a shuffle.
    """
    held = (work or Folder(df.sparkSession, "sized")).cut(df)
    total = held.agg(F.sum(sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16).cast("long"))).alias("n")).head()["n"]
    return F.broadcast(held) if (total or 0) <= BROADCAST_BYTES else held
