"""Document fingerprints by spot signatures.

A common word (an anchor) and the chain of the next content words make a signature; a
text's fingerprint is the set of its signatures, in order, as hexadecimal numbers. In a text
with fewer anchors than one in ``SPARSE`` words (another language, a list, code) each content
word is an anchor besides, so the whole text counts; characters of scripts without spaces are words there.
Two fingerprints are compared by Jaccard similarity; a wanted least similarity
prunes by set length first and then stops a merge that can't reach it. :func:`partitions`
gives the length ranges outside which no partner lies. The query wants exact values, so it
uses neither, and nothing here compares a whole table by them.

The next document in descending order of ids is found without a global sort into
one task: ids are cut at approximate quantiles, each range is sorted by itself,
and the head of the following range is added to each as its last row's successor.

Defined cases: a null text counts as empty, and an empty or wordless text has an empty
fingerprint, which is like another empty one (1.0) and unlike all else (0.0); the
start of a text is an anchor too, and a text of common words only has one signature of
them all, so every text with a word has a signature; chains at the end are shorter; rows that
repeat an id are ordered by their text's hash; null ids come after all others;
a single row is its own successor; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import table

CHAIN = 2
#: Ranges that rows of null ids are dealt into, and ids that are collected for each range to cut a table of string ids.
NULL_RANGES, SAMPLED_IDS = 16, 100
#: Common words of English, German, French and Spanish.
COMMON = frozenset(
    "a an and are as at be been but by can could did do for from had has have he her his if in into is it its no not of on or our "
    "she so than that the their there they this to was we were which who will with would you "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach "
    "nicht noch nur oder sein sich sie sind um und von vor war wie wir zu zum zur über "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui "
    "sa se ses son sont sur un une vous "
    "al como con del el ella era es esta este fue ha las lo los más me mi muy para pero por se ser si sin sobre su sus también una y".split()
)

#: A text with fewer common words before others than one in so many has too few anchors.
SPARSE = 16

_words = re.compile(r"[^\W_]+").findall
#: Thai to Burmese, Khmer, kana and Chinese characters, which are written without spaces.
_BARE = r"\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff"
_pieces = re.compile(rf"[{_BARE}]|[^\W_{_BARE}]+").findall


def signatures(text: str | None) -> frozenset[int]:
    words = _words(text.lower()) if text else []
    if not words:
        return frozenset()
    content = [w for w in words if w not in COMMON]
    if not content:
        return frozenset([xxhash.xxh32_intdigest(" ".join(words))])
    chains, at, anchors = {"^ " + " ".join(content[:CHAIN])}, 0, 0
    for word in words:
        if word in COMMON:
            if at < len(content):
                anchors += 1
                chains.add(f"{word} {' '.join(content[at : at + CHAIN])}")
        else:
            at += 1
    if anchors * SPARSE < len(words):
        pieces = [w for w in _pieces(text.lower()) if w not in COMMON]
        chains |= {" ".join(pieces[k : k + 1 + CHAIN]) for k in range(len(pieces))}
    return frozenset(map(xxhash.xxh32_intdigest, chains))


def fingerprint(marks: frozenset[int]) -> str:
    return "".join([f"{x:08x}" for x in sorted(marks)])


def partitions(size: int, least: float) -> tuple[int, int]:
    """The range of sizes of sets that can have a similarity of ``least`` with one of ``size``."""
    return math.ceil(size * least - 1e-9), math.floor(size / least + 1e-9)


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard similarity; 0.0 as soon as it is known to be below ``least``."""
    if not a and not b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if least and len(a) < partitions(len(b), least)[0]:
        return 0.0
    if not least:
        both = len(a & b)
        return both / (len(a) + len(b) - both)
    needed, both, left = least * (len(a) + len(b)) / (1 + least) - 1e-9, 0, len(a)
    for x in a:
        left -= 1
        both += x in b
        if both + left < needed:
            return 0.0
    return both / (len(a) + len(b) - both)


def _part(cuts: list[int]) -> Column:
    """How many cuts lie above the id: found in two steps, so many cuts cost little."""
    cuts = sorted(cuts, reverse=True)
    step = max(1, math.isqrt(len(cuts)))
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    key = F.col("doc_id")
    if not cuts:
        return F.lit(0)
    firsts = F.array(*[F.lit(r[-1]) for r in runs])  # a run is passed if its last cut is above the id
    passed = F.size(F.filter(firsts, lambda c: c > key))
    within = F.get(F.array(*[F.array(*[F.lit(c) for c in r]) for r in runs]), F.least(passed, F.lit(len(runs) - 1)))
    inside = F.when(passed < len(runs), F.size(F.filter(within, lambda c: c > key))).otherwise(0)
    return passed * step + inside


def _quantiles(ids: DataFrame, ranges: int) -> list:
    """Ids that cut the table into about as many ranges of equal size; none for types that aren't numbers or strings."""
    kind = ids.schema["doc_id"].dataType
    if ranges < 2:
        return []
    if isinstance(kind, T.NumericType):
        marks = F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)
        return sorted(set(ids.agg(marks.alias("q")).head()["q"] or []))
    if isinstance(kind, T.StringType):  # from a sample whose size doesn't depend on the table's
        known = ids.where("doc_id IS NOT NULL")
        wanted, total = SAMPLED_IDS * ranges, known.count()
        sample = sorted(r[0] for r in (known.sample(wanted / total, seed=5) if total > wanted else known).limit(2 * wanted).collect())
        return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    return []


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses.

    The edited text has the last half of the code points replaced by as many of the next
    document's first ones. ``ranges`` is the number of id ranges (the session's
    number of shuffle partitions, if not given); rows of null ids are dealt into ranges of their texts' hashes.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    cuts = _quantiles(rows.select("doc_id"), ranges)
    parts = len(cuts) + 1 + NULL_RANGES
    blank = F.lit(len(cuts) + 1) + (F.shiftright("key", 60) + NULL_RANGES // 2).cast("int")
    placed = rows.withColumn("part", F.when(F.col("doc_id").isNull(), blank).otherwise(_part(cuts)).cast("int"))
    # one row for each range, however long the table is: its first id, and of rows that repeat it the least hash
    first = F.max(F.struct("doc_id", F.bitwise_not("key").alias("back")))
    heads = {r["part"]: (r["head"]["doc_id"], ~r["head"]["back"]) for r in placed.groupBy("part").agg(first.alias("head")).collect()}
    order = sorted(heads)
    follows = [(*heads[order[(k + 1) % len(order)]], p) for k, p in enumerate(order)]
    after = spark.createDataFrame(follows, T.StructType([T.StructField("of", docs.schema["doc_id"].dataType), T.StructField("of_key", T.LongType()), T.StructField("part", T.IntegerType())]))
    seconds = rows.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))).select("doc_id", "text", "key", "part")
    # a repeated row may come several times as a range's successor, and any of them does
    both = placed.withColumn("last", F.lit(False)).unionByName(seconds.withColumn("last", F.lit(True)))
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("last", F.desc_nulls_last("doc_id"), "key").select("doc_id", "text", "last")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor: (id, text, signatures)
        for batch in batches:
            made = []
            for id_, text, last in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if last and held is None:
                    continue
                text = text or ""
                marks = signatures(text)
                if held is not None:
                    made.append(_row(*held, text, marks))
                held = None if last else (id_, text, marks)
            if made:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)], names)

    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    return dealt.mapInArrow(run, T.StructType([docs.schema["doc_id"], *[T.StructField(n, kind) for n, kind in zip(names[1:], kinds, strict=True)]]))


def _row(id_, text: str, marks: frozenset[int], next_text: str, next_marks: frozenset[int]) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    edited_marks = signatures(edited)
    sha = hashlib.sha256(edited.encode()).hexdigest()
    return id_, len(text), sha, fingerprint(marks), fingerprint(edited_marks), likeness(marks, edited_marks), likeness(marks, next_marks)


def op8_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))


QUERIES = {"op8_spots": op8_spots}
SQL: dict[str, str] = {}
