"""Tables of n-grams that prune a search without deciding any result.

Units are packed in order into blocks. A gram is so many bytes of a unit's normalised text, as a number that has
its width in the upper bits; the tables have a row per different gram and block. Grams of few blocks, as
many as a share of the source pays for, are the postings that are kept; of all grams only whether they occur is. A literal
can stand only in blocks that have all its kept grams, so a search reads a bounded list of blocks, or none at all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import small_batches, trimmed
from ..functions.text import NORMAL, fold, normal_forms, normalise_query
from .search import text_bytes

# Fixed values of the pruning layer.
BLOCK_BYTES = 1 << 20
WIDTH = 3
RARE_DF = 64
#: Shares of the source that the postings of three bytes, and those of four and five, may take.
SHARES = {3: 0.010, 4: 0.0025, 5: 0.0025}
POSTING_BYTES = 4
#: Starts of windows that are made at once, which take some sixty bytes each; grams that a task holds before it counts them, and
#: counts that it holds before it adds up those of the same gram.
PIECE, HELD = 1 << 18, 1 << 20
#: Bytes of a sieve, odd so that grams spread over all of it.
SIEVES = (8191, 131071, 2097143, 8388593, 16777213, 33554393)


def packed(units: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """``units`` with ``block_id``: each task packs its units in order; one that is larger than ``limit`` is a block of its own.

    Units that aren't normalised yet are normalised in the same pass, so one worker does both and texts leave the JVM once.
    """
    fresh = [] if "folded" in units.columns else NORMAL.fields
    at = len(units.columns) if fresh else units.columns.index("folded")
    raw = units.columns.index("raw") if fresh else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            made = np.empty(batch.num_rows, np.int64)
            if fresh:
                batch = pa.RecordBatch.from_arrays([*batch.columns, *normal_forms(batch.column(raw))], [*batch.schema.names, *NORMAL.names])
            _, ends = text_bytes(batch.column(at))
            for k, size in enumerate(np.diff(ends).tolist()):
                if filled and filled + size + 1 > limit:
                    block, filled = block + 1, 0
                filled += size + 1
                made[k] = block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], [*batch.schema.names, "block_id"])

    small_batches(units.sparkSession)
    return units.mapInArrow(trimmed(run), T.StructType([*units.schema.fields, *fresh, T.StructField("block_id", T.LongType(), False)]))


def code(data: bytes) -> int:
    """A gram as a number: its width, then its bytes."""
    return len(data) << 56 | int.from_bytes(data, "big")


def shown(gram: Column, width: int = WIDTH) -> Column:
    """A gram's bytes in hexadecimal."""
    return F.right(F.hex(gram), F.lit(2 * width))


def _different(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each comes. Sorts ``values`` in place, which is far faster than ``np.unique``."""
    values.sort()
    first = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    return values[first], np.diff(first, append=len(values))


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of grams, each in order of grams, as one: those of the same gram are added up."""
    if len(counts) == 1:
        return counts[0]
    gram, n = map(np.concatenate, zip(*counts, strict=True))
    order = np.argsort(gram, kind="stable")  # merges what is in order
    gram = gram[order]
    first = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
    return gram[first], np.add.reduceat(n[order], first) if len(first) else n


def _windows(data: bytes, ends: np.ndarray, owner: np.ndarray, narrow: int, width: int) -> Iterator[np.ndarray]:
    """The different windows of ``narrow`` to ``width`` bytes of each owner's texts, in order: :func:`_of_width` has those of one width.

    A number is, from above, the owner, ``width`` bytes from a start on, and how many of them are the text's: fewer near its end, where
    zeros follow. So one sort serves all widths. ``PIECE`` starts are taken at a time, wherever texts end, so a long text takes no
    more memory than short ones; what two pieces share comes twice.
    """
    raw = np.frombuffer(data + bytes(width), np.uint8)
    for low in range(0, len(data), PIECE):
        high = min(low + PIECE, len(data))
        value = raw[low:high].astype(np.int64)
        for k in range(1, width):
            value <<= 8
            value |= raw[low + k : high + k]
        value <<= 3
        value |= width
        first, last = np.searchsorted(ends, [low, high - 1], "right") - 1
        sizes = np.diff(np.clip(ends[first : last + 2], low, high))
        value |= np.repeat(owner[first : last + 1] << 8 * width + 3, sizes)
        near = slice(first, np.searchsorted(ends, high + width) + 1)
        begin, end = ends[near][:-1], ends[near][1:]
        for k in range(1, width):
            at = end - k
            at = at[(at >= np.maximum(begin, low)) & (at < high)] - low
            value[at] = (value[at] >> 8 * (width - k) + 3 << 8 * (width - k) + 3 | k) if k >= narrow else -1
        found = _different(value)[0]
        yield found[1:] if len(found) and found[0] < 0 else found


def _of_width(windows: np.ndarray, width: int, most: int) -> np.ndarray:
    """Of windows of up to ``most`` bytes, in order, the different ones of ``width`` bytes: the owner above the bytes, in order."""
    values = windows[windows & 7 >= width] >> 8 * (most - width) + 3
    if width == most:
        return values
    return values[np.diff(values, prepend=-1) != 0]


class _Blocks:
    """Windows of a task's blocks, each once if the rows of its block follow each other; else once for each run of them.

    The last block of a batch stays open until the next batch begins with another one.
    """

    def __init__(self, widths: tuple[int, ...]) -> None:
        self.widths, self.most, self.open, self.found = widths, max(widths), None, []

    def _merged(self) -> np.ndarray:
        """The open block's windows, which pieces may share."""
        return self.found[0] if len(self.found) == 1 else _different(np.concatenate([np.zeros(0, np.int64), *self.found]))[0]

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Blocks that have ended, places among them, and beside each place a gram."""
        if not batch.num_rows:
            return
        coded = batch.column(0).dictionary_encode("encode")
        index = coded.indices.to_numpy()
        fresh = np.diff(index, prepend=-1) != 0
        blocks, owner = coded.dictionary.take(pa.array(index[fresh])), np.cumsum(fresh) - 1
        if self.open is not None and not self.open.equals(blocks[:1]):
            yield from self.end()
        # Pieces are in the order of owners, so two share only the one that is open, and no other is sorted again
        at, last, bits, ended = 0, len(blocks) - 1, 8 * self.most + 3, []
        for windows in _windows(*text_bytes(batch.column(1)), owner, min(self.widths), self.most):
            if not len(windows):
                continue
            head, newest = np.searchsorted(windows, at + 1 << bits), int(windows[-1] >> bits)
            self.found.append(windows[:head])
            if newest > at:
                tail = np.searchsorted(windows, newest << bits)
                ended += [self._merged(), windows[head:tail]]
                at, self.found = newest, [windows[tail:]]
            elif sum(map(len, self.found)) > HELD:
                self.found = [self._merged()]
        if at < last:  # the last block has no windows
            ended.append(self._merged())
            self.found = []
        self.open, self.found = blocks[last:], [self._merged() & (1 << bits) - 1]
        if last:
            yield from self._grams(blocks[:last], np.concatenate(ended))

    def _grams(self, blocks: pa.Array, windows: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for width in self.widths:
            values, mask = _of_width(windows, width, self.most), (1 << 8 * width) - 1
            yield blocks, values >> 8 * width, values & mask | width << 56

    def end(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if self.open is not None:
            yield from self._grams(self.open, self._merged())
        self.open, self.found = None, []


def _by_block(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """What :class:`_Blocks` gives for all widths, in one pass over the batches."""
    made = _Blocks(widths)
    for batch in batches:
        if batch.schema.names[1] == "raw":
            batch = pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fold, batch.column(1).to_pylist()), pa.string())], ["block_id", "folded"])
        yield from made.add(batch)
    yield from made.end()


def _texts(units: DataFrame, widths: tuple[int, ...], block: str) -> DataFrame:
    if not all(1 <= w <= 5 for w in widths):
        raise ValueError("grams have one to five bytes")
    small_batches(units.sparkSession)
    text = "folded" if "folded" in units.columns else "raw"  # the worker that makes the windows folds the latter itself
    return units.where(F.col(text).isNotNull()).select(F.col(block).alias("block_id"), text)


def _pairs(units: DataFrame, widths: tuple[int, ...], block: str, sieve: np.ndarray | None = None) -> DataFrame:
    """``gram, block_id``: each pair once from each run of a block's rows; with a sieve, of the grams that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, which, gram in _by_block(batches, widths):
            if sieve is not None:
                for mixed in (False, True):
                    place = _place(gram, mixed, len(sieve))
                    through = (sieve[place >> 3] >> (place & 7) & 1).astype(bool)
                    which, gram = which[through], gram[through]
            yield pa.RecordBatch.from_arrays([pa.array(gram), blocks.take(pa.array(which))], ["gram", "block_id"])

    rows = _texts(units, widths, block)
    return rows.mapInArrow(trimmed(run), T.StructType([T.StructField("gram", T.LongType()), rows.schema["block_id"]]))


def _counts(units: DataFrame, widths: tuple[int, ...], block: str) -> DataFrame:
    """``gram, block_id, n``: partial counts of the runs of blocks that have a gram, and of the runs of a block where the gram is null.

    Blocks are counted where they are made, so no pair of a gram and a block is shuffled.
    """
    kind = units.schema[block].dataType
    fields = T.StructType([T.StructField("gram", T.LongType()), T.StructField("block_id", kind), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, counted, names = [], 0, [], ["gram", "block_id", "n"]

        def summed(most: int) -> Iterator[pa.RecordBatch]:
            # grams that many blocks have stay until the task ends, so few of their counts are handed on
            nonlocal held, size, counted
            counted.append(_different(np.concatenate(held)))
            held, size = [], 0
            if sum(len(gram) for gram, _ in counted) >= most:
                gram, n = _added(counted)
                counted = [(gram, n)]
                if len(gram) >= most // 2:
                    counted = []
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.nulls(len(gram), ended), pa.array(n)], names)

        for blocks, _, gram in _by_block(batches, widths):
            ended = blocks.type
            yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), pa.int64()), blocks, pa.array(np.ones(len(blocks), np.int64))], names)
            held.append(gram)
            size += len(gram)
            if size >= HELD:
                yield from summed(HELD)
        if held or counted:
            held.append(np.zeros(0, np.int64))
            yield from summed(0)

    return _texts(units, widths, block).mapInArrow(trimmed(run), fields)


def grams(units: DataFrame, width: int = WIDTH, block: str = "file_id") -> DataFrame:
    """``gram, block_id``, each pair once.

    A batch's texts are one run of bytes, whose windows are numbers; a block that comes in several places is merged by a shuffle of
    what is left. Where only counts are wanted, :func:`frequencies` does without it.
    """
    return _pairs(units, (width,), block).distinct()


def frequencies(units: DataFrame, width: int = WIDTH, block: str = "file_id", most: int | None = RARE_DF + 1) -> DataFrame:
    """``gram, df`` as of :func:`grams`: blocks with the gram, counted up to ``most`` (None: all).

    Blocks whose rows follow each other, as the lines of a file do, are counted by the task that has them. If any block comes in
    several places, which the same pass tells, pairs are shuffled.
    """
    made = _counts(units, (width,), block).groupBy("gram", "block_id").agg(F.sum("n").alias("n")).persist()
    if not made.where("gram IS NULL AND n > 1").isEmpty():
        made.unpersist()
        made = grams(units, width, block).groupBy("gram").agg(F.count("*").alias("n"))
    return made.where("gram IS NOT NULL").select("gram", (F.col("n") if most is None else F.least("n", F.lit(most))).cast("long").alias("df"))


def document_frequency(table: DataFrame, most: int = RARE_DF + 1) -> DataFrame:
    """``gram, df``: blocks with the gram, counted up to ``most``."""
    return table.groupBy("gram").agg(F.least(F.count("*"), F.lit(most)).cast("long").alias("df"))


def rarest(frequencies: DataFrame, pool: int) -> DataFrame:
    """The ``pool`` rarest grams: a bounded heap on each task."""
    return frequencies.orderBy("df", "gram").limit(pool)


def needed(query: str, width: int = WIDTH, case_sensitive: bool = False) -> list[int]:
    """The different grams that any text with the query has."""
    data = normalise_query(query, case_sensitive).encode()
    return sorted({code(data[i : i + width]) for i in range(len(data) - width + 1)})


def candidates(table: DataFrame, query: str, width: int = WIDTH, case_sensitive: bool = False) -> DataFrame | None:
    """``block_id`` of the blocks that have all grams of the query; None if it is too short to tell."""
    wanted = needed(query, width, case_sensitive)
    if not wanted:
        return None
    have = table.where(F.col("gram").isin(wanted)).groupBy("block_id").agg(F.count("*").alias("n"))
    return have.where(F.col("n") == len(wanted)).select("block_id")


def pruned(units: DataFrame, table: DataFrame, query: str, case_sensitive: bool = False, block: str = "file_id") -> DataFrame:
    """The units of candidate blocks."""
    found = candidates(table, query, case_sensitive=case_sensitive)
    return units if found is None else units.join(found.withColumnRenamed("block_id", block), block, "left_semi")


def budget(frequencies: DataFrame, limit_rows: int) -> DataFrame:
    """Rarest grams whose posting rows together fit in ``limit_rows``: whole frequency classes at a time.

    Classes are few (frequencies are capped), so running sums are over a bounded table.
    """
    classes = frequencies.where(F.col("df") <= RARE_DF).groupBy("df").agg((F.count("*") * F.col("df")).alias("rows"))
    running = classes.withColumn("total", F.sum("rows").over(Window.orderBy("df")))
    kept = running.where(F.col("total") <= limit_rows).select("df")
    return frequencies.join(F.broadcast(kept), "df", "left_semi")


def budget_greedy(frequencies: DataFrame, limit_rows: int) -> DataFrame:
    """The same, but a class that doesn't fit is left out and later ones may still fit. Classes are at most ``RARE_DF`` rows."""
    classes = frequencies.where(F.col("df") <= RARE_DF).groupBy("df").agg((F.count("*") * F.col("df")).alias("rows")).orderBy("df").collect()
    left, kept = limit_rows, []
    for row in classes:
        if row["rows"] <= left:
            left -= row["rows"]
            kept.append(row["df"])
    return frequencies.where(F.col("df").isin(kept) if kept else F.lit(False))


def _place(gram: np.ndarray, mixed: bool, size: int) -> np.ndarray:
    """The bit of each gram in a sieve of so many bytes: its remainder, or that of its bits ``mixed`` by a multiplication."""
    value = (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)).astype(np.int64) if mixed else gram
    return value % (8 * size)


def _sieve(kept: DataFrame, most: int) -> np.ndarray:
    """Bytes with the two bits of each kept gram set: few others pass while bits are many times ``most``.

    The size has a bound, and so has what comes to the driver: a row for each word of bits at most.
    """
    size = next((n for n in SIEVES if n >= 2 * most), SIEVES[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy()
            place = np.concatenate([_place(gram, mixed, size) for mixed in (False, True)])
            yield pa.RecordBatch.from_arrays([pa.array(place >> 5), pa.array(np.int64(1) << (place & 31))], ["word", "bits"])

    words = kept.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 4 + 1, "<u4")
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype("<u4")
    return bits.view(np.uint8)[:size]


class Index:
    """Kept postings and the grams that occur, for units with ``block_id``."""

    def __init__(self, postings: DataFrame, present: DataFrame) -> None:
        self.postings, self.present = postings, present

    @classmethod
    def build(cls, units: DataFrame, source_bytes: int, shares: dict[int, float] | None = None) -> dict[str, DataFrame]:
        """``postings`` (``gram, block_id``) and ``present`` (``gram, df``), in order of grams so that few of their pages are read.

        Of grams of four and five bytes only those kept are stored; of three all are, so a gram that nothing has ends a search.
        """
        # Units of a block follow each other, so a pair comes again only where a block is read by two tasks: that
        # may count a gram as a little more frequent, which costs a posting at most and never a result.
        shares = SHARES if shares is None else shares
        if WIDTH not in shares:
            raise ValueError(f"an index has grams of {WIDTH} bytes")
        widths, rows = tuple(shares), {width: int(source_bytes * share / POSTING_BYTES) for width, share in shares.items()}
        counted = _counts(units, widths, "block_id").where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("all"))
        df = counted.select("gram", F.least("all", F.lit(RARE_DF + 1)).cast("long").alias("df")).persist()
        df = df.coalesce(units.sparkSession.sparkContext.defaultParallelism)  # else each of many small tasks writes a file for each of as many others
        # as in budget(), for all widths at once: at most RARE_DF classes of each come to the driver
        classes = df.where(F.col("df") <= RARE_DF).groupBy(F.shiftright("gram", 56).alias("width"), "df").agg((F.count("*") * F.col("df")).alias("rows")).orderBy("df").collect()
        fits = F.lit(False)
        for width in widths:
            totals = itertools.accumulate(((c["rows"], c["df"]) for c in classes if c["width"] == width), lambda a, c: (a[0] + c[0], c[1]))
            most = max((at for total, at in totals if total <= rows[width]), default=0)
            fits = fits | (F.col("gram").between(width << 56, (width + 1 << 56) - 1) & (F.col("df") <= most))
        kept = df.where(fits).select("gram")
        # most pairs are of grams that aren't kept: few others leave Python, and the join takes those out
        postings = _pairs(units, widths, "block_id", _sieve(kept, sum(rows.values()))).join(kept, "gram").distinct()
        return {"postings": postings.select("gram", "block_id").orderBy("gram"), "present": df.where(F.shiftright("gram", 56) == WIDTH).orderBy("gram")}

    def blocks(self, query: str, case_sensitive: bool = False) -> list[int] | None:
        """The blocks that can have the query; None if all can. At most ``RARE_DF`` of them, as each kept gram is in no more."""
        short = needed(query, WIDTH, case_sensitive)
        if not short:
            return None
        wanted = short + needed(query, 4, case_sensitive) + needed(query, 5, case_sensitive)
        there = self.present.where(F.col("gram").isin(short)).select("gram", F.lit(None).cast("long").alias("block_id"))
        seen, found = set(), {}
        # at most one row and RARE_DF more for each gram of the query
        for gram, block in there.unionByName(self.postings.where(F.col("gram").isin(wanted))).collect():
            if block is None:
                seen.add(gram)
            else:
                found.setdefault(gram, set()).add(block)
        if len(seen) < len(short):
            return []
        return sorted(set.intersection(*found.values())) if found else None

    def pruned(self, units: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
        """The units of those blocks: a list that the scan of stored units takes as a filter."""
        blocks = self.blocks(query, case_sensitive) if query else None
        if blocks is None:
            return units
        return units.where(F.col("block_id").isin(blocks) if blocks else F.lit(False))


def capacity(units: DataFrame, share: float = SHARES[WIDTH]) -> DataFrame:
    """One row: source bytes, grams, posting rows, those that the budget keeps, and the bytes of these for each source byte."""
    source = units.agg(F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).cast("long").alias("source_bytes"))
    exact = frequencies(units, most=None)
    classes = exact.groupBy(F.least("df", F.lit(RARE_DF + 1)).alias("df")).agg(F.count("*").alias("grams"), F.sum("df").alias("postings"))
    # classes are at most RARE_DF + 1 rows
    rows = classes.join(F.broadcast(source)).withColumn("rows", F.when(F.col("df") <= RARE_DF, F.col("postings")).otherwise(0))
    total = rows.withColumn("total", F.sum("rows").over(Window.orderBy("df")))
    fits = (F.col("df") <= RARE_DF) & (F.col("total") <= F.floor(F.col("source_bytes") * F.lit(share) / POSTING_BYTES))
    summed = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("long")
    kept = total.agg(summed("grams").alias("grams"), summed(F.when(fits, F.col("rows"))).alias("kept_postings"), summed("postings").alias("postings"))
    out = source.join(F.broadcast(kept))
    return out.withColumn("ratio", F.when(F.col("source_bytes") == 0, 0.0).otherwise(F.col("kept_postings") * float(POSTING_BYTES) / F.col("source_bytes")))
