"""Near-duplicate detection by weighted Jaccard similarity with BagMinHash signatures.

A text is the multiset of its runs of ``size`` words. Weights (counts) are
discretised at 0, 1, 2, 4, 8, ... and, within a dyadic interval, at each integer.
Each element has a Poisson process for each interval up to its weight, whose points
have a time, a signature component, and a level found by halving the interval with
the bits of a hash; points above the weight are dropped. A component's value is the
time of its first point: two texts agree in a component with exactly their weighted
Jaccard similarity as probability. Points are made in order of time, and an element
stops when its next one comes after all components' values, so a text costs about one
point for each element and ``m ln m`` more.

Texts of the same words are one node at once. Bands of the signature give buckets, and two nodes are
linked if they share a bucket and their exact multisets are alike; classes are what links connect.
Members of a bucket are first compared to two hubs of it, not to each other: most of a large group is
one component after that. Only pairs of different components in one bucket are still open. Buckets that
share components make a family; small families are gathered into tasks of a bounded number of
words, a large one is cut into blocks of such a bound, and a task compares two blocks by a
product of matrices, returning which components they join. So no pair is ever a row, blocks
of one component are never compared to each other, and the result is the same however large a bucket is.

Defined cases: texts of fewer than ``size`` words, but not none, are one run; texts
without words are copies only of equal texts; a null text is in a class of its own;
repeated rows each give a row, and an id that has several texts has a node for each of them; null ids
are in no class (theirs is null); ties go to the smallest id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Folder, free_name, sized, small_batches, table, trim, trimmed, words

SIZE, SIMILARITY = 5, 0.8
#: 20 bands of 4 components: a pair at 0.8 meets in none of them once in 37,000 times.
BANDS, ROWS = 20, 4
COMPONENTS = BANDS * ROWS
#: Elements of texts that are signed in one numpy pass.
PASS = 1 << 16
#: A block holds at most about so many runs of words, and so many texts.
BLOCK_RUNS, BLOCK_TEXTS = 1 << 18, 2048
#: Columns of a block's matrix at a time.
COLUMNS = 2048
#: From so many open pairs on, two blocks are compared by matrices and not pair by pair.
MANY = 256

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Different runs of words, as 64-bit values, and their counts."""
    h = np.asarray(hashes, np.int64).view(np.uint64)
    if not len(h):
        return h, np.zeros(0, np.int64)
    n = max(1, len(h) - size + 1)
    value = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        value = _mix(value * _GOLD + h[k : k + n])
    value.sort()
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return value[first], np.diff(np.append(first, n))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """A row of ``m`` times for each non-empty bag (infinite for an empty one)."""
    best = np.full((len(bags), m), np.inf)
    element = np.concatenate([b[0] for b in bags] or [np.zeros(0, np.uint64)])
    weight = np.concatenate([b[1] for b in bags] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    # one process for each element and dyadic interval (low, low + width] that its weight reaches
    parts = []
    low, width, level = 0, 1, 0
    rows = np.arange(len(element))
    while len(rows):
        parts.append((rows, np.full(len(rows), low), np.full(len(rows), width), np.full(len(rows), level)))
        low, width, level = low + width, max(1, low + width), level + 1
        rows = rows[weight[rows] > low]
    if not parts:
        return best
    rows, low, width, level = (np.concatenate([p[k] for p in parts]) for k in range(4))
    seed = _mix(element[rows] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    owner, limit = owner[rows], weight[rows]
    slow = 1.0 / (m * width.astype(np.float64))
    time, latest = np.zeros(len(rows)), np.full(len(bags), np.inf)
    flat, step = best.reshape(-1), 0
    while len(seed):
        draw = _mix(seed + np.uint64(step * int(_GOLD) % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * slow
        alive = time <= latest[owner]
        if not alive.all():
            seed, owner, limit, low, width, slow, time, draw = (a[alive] for a in (seed, owner, limit, low, width, slow, time, draw))
        mark = _mix(draw ^ _M2)
        component = ((mark & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        # the upper bits halve the interval again and again: their number is the point's level
        at = low + 1 + ((mark >> np.uint64(32)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        kept = at <= limit
        np.minimum.at(flat, (owner * m + component)[kept], time[kept])
        latest = best.max(1)
        step += 1
    return best


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays (empty for null), without copying."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, same, bands, runs``: hash of the text, a key that texts of the same words share,
    the bands' keys (null without words), and the number of runs of words."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", words(F.col("text"), lower=F.lower(F.col("text"))).alias("w"))
    same = F.when(F.size("w") > 0, F.md5(F.array_join("w", " ").cast("binary"))).otherwise(F.md5(F.concat(F.lit(" "), F.col("text")).cast("binary")))
    ready = split.select("doc_id", "text_key", F.unhex(same).alias("same"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bands, start = _lists(batch.column(3)), np.zeros((batch.num_rows, BANDS), np.int64), 0
            while start < len(hashes):
                end, size = start, 0
                while end < len(hashes) and (end == start or size + len(hashes[end]) <= PASS):
                    size += len(hashes[end])
                    end += 1
                bits = signatures([shingles(h) for h in hashes[start:end]]).view(np.uint64).reshape(end - start, BANDS, ROWS)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2])
                for k in range(ROWS):
                    key = _mix(key * _GOLD + bits[:, :, k])
                bands[start:end] = key.view(np.int64)
                start = end
            sizes = np.array([len(h) for h in hashes], np.int64)
            ends = np.arange(len(hashes) + 1, dtype=np.int32) * BANDS
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()), mask=pa.array(sizes == 0))
            runs = pa.array(np.maximum(1, sizes - SIZE + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made, runs], ["doc_id", "text_key", "same", "bands", "runs"])

    kinds = [docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("runs", T.IntegerType())]
    return ready.mapInArrow(trimmed(run), T.StructType(kinds))


def _jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets as :func:`shingles` gives them."""
    (xa, na), (xb, nb) = a, b
    _, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    both = np.minimum(na[ia], nb[ib]).sum()
    total = na.sum() + nb.sum() - both
    return both / total if total else 0.0


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of the multisets of runs of two texts given as word hashes."""
    return _jaccard(shingles(a), shingles(b))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those ``a, b`` of nodes whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags: dict[int, tuple] = {}
            a, b, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for x, y, hx, hy in zip(a, b, _lists(batch.column(2)), _lists(batch.column(3)), strict=True):
                short, long = sorted((max(1, len(hx) - SIZE + 1), max(1, len(hy) - SIZE + 1)))
                if short < (similarity - 1e-9) * long:
                    good.append(False)
                    continue
                for k, h in ((x, hx), (y, hy)):
                    if k not in bags:
                        bags[k] = shingles(h)
                good.append(_jaccard(bags[x], bags[y]) >= similarity - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(texts.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    return joined.select("a", "b", "ha", "hb").mapInArrow(trimmed(run), "a long, b long")


def _overlaps(bags: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the multisets at ``left`` with those at ``right``."""
    # a multiset's k-th copy of an element is an element of its own: weighted Jaccard becomes plain Jaccard
    copies = [np.concatenate([np.arange(n) for n in b[1]]) if len(b[1]) and b[1].max() > 1 else np.zeros(len(b[0]), np.int64) for b in bags]
    elements = [_mix(np.repeat(b[0], b[1]) + c.astype(np.uint64) * _GOLD) for b, c in zip(bags, copies, strict=True)]
    sizes = np.array([len(e) for e in elements], np.int64)
    flat, owner = np.concatenate(elements), np.repeat(np.arange(len(bags)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    shared = np.bincount(column) > 1  # an element of one text only is in no intersection
    place, kept = (np.cumsum(shared) - 1)[column], shared[column]
    place, owner = place[kept], owner[kept]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # counts stay exact
    common = np.zeros((len(left), len(right)), kind)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(place, [start, start + COLUMNS])
        matrix = np.zeros((len(bags), COLUMNS), kind)
        matrix[owner[a:b], place[a:b] - start] = 1
        common += matrix[left] @ matrix[right].T
    return common


def _links(texts: list[np.ndarray], bands: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels that a link of a left and a right text joins, as few as do.

    A link is a pair that shares a band's key and is alike.
    """
    runs = np.array([max(1, len(h) - SIZE + 1) for h in texts], np.float64)
    open_ = np.zeros((len(left), len(right)), bool)
    for k in range(bands.shape[1]):
        open_ |= bands[left, k][:, None] == bands[right, k][None, :]
    open_ &= labels[left][:, None] != labels[right][None, :]
    open_ &= np.minimum(runs[left][:, None], runs[right][None, :]) >= (similarity - 1e-9) * np.maximum(runs[left][:, None], runs[right][None, :])
    rows, columns = np.nonzero(open_)
    if not len(rows):
        return []
    needed = np.unique(np.concatenate([left[rows], right[columns]]))
    bags = {int(k): shingles(texts[k]) for k in needed}
    if len(rows) <= MANY:
        alike = [_jaccard(bags[int(left[i])], bags[int(right[k])]) >= similarity - 1e-12 for i, k in zip(rows, columns, strict=True)]
    else:
        place = np.searchsorted(needed, np.arange(len(texts)))
        one, two = np.unique(rows), np.unique(columns)
        common = _overlaps([bags[int(k)] for k in needed], place[left[one]], place[right[two]])[np.searchsorted(one, rows), np.searchsorted(two, columns)].astype(np.float64)
        alike = common >= (similarity - 1e-12) * (runs[left[rows]] + runs[right[columns]] - common)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, k in zip(rows[alike], columns[alike], strict=True):
        x, y = find(int(labels[left[i]])), find(int(labels[right[k]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((x, y))
    return out


def _in_blocks(work: Folder, open_: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` between labels of different components that links in a family join.

    ``open_`` has ``node, label, family, bands, runs``.
    """
    weight = [F.sum("runs").alias("runs"), F.count("*").alias("n")]
    parts = F.greatest(F.ceil(F.col("runs") / BLOCK_RUNS), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int")
    families = work.cut(open_.groupBy("family").agg(*weight).withColumn("parts", parts))
    # small families are dealt into as many tasks as their words need
    small = families.where("parts = 1")
    total = small.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    bins = max(1, -(-total["runs"] // BLOCK_RUNS), -(-total["n"] // BLOCK_TEXTS))
    columns = ["node", "label", "family", "bands"]
    none, zero = F.lit(-1).cast("long"), F.lit(0).cast("int")
    bin_ = F.pmod(F.xxhash64("family"), F.lit(bins)).cast("int")
    gathered = open_.join(small.select("family"), "family").select(*columns, none.alias("of"), none.alias("one"), bin_.alias("part_one"), none.alias("two"), bin_.alias("part_two"), zero.alias("side"))
    # a large family's blocks: those of a large component hold nothing else and are not compared to each other
    large = open_.join(families.where("parts > 1").select("family"), "family")
    components = work.cut(large.groupBy("family", "label").agg(*weight).withColumn("parts", parts))
    pure = components.where("parts > 1").select("family", F.col("label").alias("pure"), "parts")
    mixed = components.where("parts = 1").groupBy("family").agg(F.sum("runs").alias("runs"), F.sum("n").alias("n")).select("family", none.alias("pure"), parts.alias("parts"))
    cuts = work.cut(pure.unionByName(mixed))
    blocks = cuts.select("family", "pure", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"))
    other = blocks.select("family", F.col("pure").alias("pure_two"), F.col("part").alias("part_two"))
    ordered = F.struct("pure", "part") <= F.struct(F.col("pure_two").alias("pure"), F.col("part_two").alias("part"))
    pairs = work.cut(blocks.join(other, "family").where(ordered & ((F.col("pure") != F.col("pure_two")) | (F.col("pure") < 0))))
    owner = components.select("family", "label", F.when(F.col("parts") > 1, F.col("label")).otherwise(none).alias("pure"))
    placed = large.join(owner, ["family", "label"]).join(cuts, ["family", "pure"])
    placed = work.cut(placed.select(*columns, "pure", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    whole = (F.col("pure") == F.col("pure_two")) & (F.col("part") == F.col("part_two"))
    task = [F.col("family").alias("of"), F.col("pure").alias("one"), F.col("part").alias("part_one"), F.col("pure_two").alias("two"), "part_two"]
    first = placed.join(pairs.withColumn("side", F.when(whole, 0).otherwise(1)), ["family", "pure", "part"]).select(*columns, *task, "side")
    swapped = pairs.where(~whole).select("family", F.col("pure_two").alias("at"), F.col("part_two").alias("at_part"), "pure", "part", "pure_two", "part_two")
    seconds = placed.select(*columns, F.col("pure").alias("at"), F.col("part").alias("at_part")).join(swapped, ["family", "at", "at_part"]).select(*columns, *task, F.lit(2).alias("side"))
    dealt = gathered.unionByName(first).unionByName(seconds).join(texts, "node")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        take = lambda name: rows.column(name).to_numpy()
        column = lambda name: rows.column(name).chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        texts_, bands = _lists(column("h")), column("bands").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        family, label, side = take("family"), take("label"), take("side")
        found, order = [], np.argsort(family, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            found += _links(texts_, bands, label, own[side[own] != 2], own[side[own] != 1], similarity)
        trim()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("of", "one", "part_one", "two", "part_two").applyInArrow(run, "a long, b long")


def _components(work: Folder, edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each end of ``a, b`` reaches."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = work.cut(edges.where("a <> b").select(F.explode(ways).alias("e")).select("e.*").distinct())
    roots = work.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"), F.lit(True).alias("moved")))
    while not roots.where("moved").isEmpty():
        # neighbours' smallest root, then the root's own root: paths halve each time
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        root = F.least("root", "near", "up")
        new = work.cut(roots.drop("moved").join(near, "node").join(up, "root", "left").select("node", root.alias("root"), (F.col("root") != root).alias("moved")))
        work.drop(roots)
        roots = new
    work.drop(both)
    return roots.select("node", "root")


def _classified(work: Folder, docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and the nodes: ``node, same, doc_id, text_key, class_id, first`` (whether it stands for its class).

    A node is all rows of the same words; its ``doc_id`` is the smallest.
    """
    small_batches(docs.sparkSession)
    signed = work.cut(_signed(docs.select("doc_id", "text")))
    known = signed.where("same IS NOT NULL AND doc_id IS NOT NULL")
    row = F.struct("doc_id", "text_key", "bands", "runs")
    nodes = known.groupBy("same").agg(F.min_by(row, F.struct("doc_id", "text_key")).alias("r"))
    nodes = work.cut(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "r.*"))
    buckets = nodes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    # a bucket's hubs are first by one of two orders that hold for all buckets, so members of several share them
    hub = lambda seed: F.min_by("node", F.xxhash64(F.lit(seed), "node"))
    hubs = work.cut(buckets.groupBy("bucket").agg(F.count("*").alias("n"), hub(1).alias("one"), hub(2).alias("two")).where("n > 1").drop("n"))
    members = work.cut(buckets.join(hubs, "bucket"))
    work.drop(hubs)
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("of"), F.col("text_key").alias("key")), "node")
    wanted = sized(wanted, work)
    found = docs.select("doc_id", "text").join(wanted, (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("key")))
    hashes = F.transform(words(F.col("text"), lower=F.lower(F.col("text"))), lambda w: F.xxhash64(w))
    texts = work.cut(found.groupBy("node").agg(F.min("text").alias("text")).select("node", hashes.alias("h")))
    pairs = members.select("node", F.explode(F.array("one", "two")).alias("hub")).where("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    roots = _components(work, _verified(pairs, texts, similarity))
    # what is still in several components of one bucket is open
    placed = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label"))
    several = work.cut(placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").drop("high"))
    open_ = work.cut(placed.join(several, "bucket").select("node", "label", "low"))
    work.drop(members, several)
    families = _components(work, open_.select(F.col("label").alias("a"), F.col("low").alias("b")))
    open_ = open_.select("node", "label").distinct().join(families.select(F.col("node").alias("label"), F.col("root").alias("family")), "label")
    open_ = work.cut(open_.join(nodes.select("node", "bands", "runs"), "node"))
    joined = _components(work, _in_blocks(work, open_, texts, similarity))
    work.drop(open_, texts)
    # a node's class is that of its component
    linked = roots.unionByName(joined.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    linked = linked.join(joined.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("class"))
    linked = work.cut(linked.join(nodes.select("node", "doc_id", "text_key"), "node"))
    least = work.cut(linked.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min_by("node", F.struct("doc_id", "text_key")).alias("first")))
    linked = linked.join(least, "class").select(F.col("node").alias("of"), "class_id", (F.col("node") == F.col("first")).alias("first"))
    named = nodes.select("node", "same", "doc_id", "text_key").join(linked, F.col("node") == F.col("of"), "left")
    named = named.select("same", "doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("first", F.lit(True)).alias("first"))
    return signed, named


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, same_as``: of each row, its class (the smallest id in it) and the
    smallest id of those with the very same words."""
    signed, named = _classified(Folder(docs.sparkSession, "neardup"), docs, similarity)
    named = named.select(F.col("same").alias("of"), F.col("doc_id").alias("same_as"), "class_id")
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same"))
    return rows.join(named, F.col("same") == F.col("of"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("same_as", "doc_id").alias("same_as"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id (rows of null id all stay).

    Of repeated rows of the same id and text one stays, the least by its columns.
    """
    work = Folder(docs.sparkSession, "neardup")
    signed, named = _classified(work, docs, similarity)
    id_, key, n = (free_name(docs, name) for name in ("kept_id", "kept_key", "kept_rows"))
    counts = signed.where("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    # null texts are in no node: each id's is a class of its own
    firsts = named.where("first").select("doc_id", "text_key").unionByName(signed.where("same IS NULL AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct())
    kept = firsts.join(counts, ["doc_id", "text_key"]).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("n").alias(n))
    kept = sized(kept, work)
    alike = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(key))
    single = docs.join(kept.where(F.col(n) == 1), alike, "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    again = kept.where(F.col(n) > 1)
    if again.isEmpty():
        return single
    rest = docs.join(sized(again, work), alike, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return single.unionByName(rest.groupBy(F.col("doc_id"), F.xxhash64("text")).agg(F.min(row).alias("r")).select("r.*"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


_W = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = {
    "op10_neardup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT doc_id, g, count(*) AS n FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE common >= 0.8 * (ta.total + tb.total - common)
  UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT doc_id, min(root) AS class_id, min(root) = doc_id AS kept FROM documents JOIN r ON r.id = doc_id GROUP BY doc_id"""
}
QUERIES = {"op10_neardup": op10_neardup}
