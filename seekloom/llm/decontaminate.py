"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of ``size`` normalised words form a table keyed by a hash
of a few words of the window. The windows of a training text probe that table
(a broadcast hash join while the table is of a proven size, a shuffled join
beyond it); each candidate is verified word by word. The positions that verified
windows cover are then counted, cut out of the text, or used to drop documents.

Defined cases: a null, empty or wordless text has no hits; a benchmark item
without words is never found; an item of fewer than ``size`` words is one window
of its own length; repeated rows each give a row; equal windows of several items
count for all of them; null ids are kept as they are and, among items, are not
reported. Extra columns are carried through by :func:`decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, free_name, sized, table, words

#: So many words of a window are hashed to find candidates; all are compared after that.
PROBES = 4


def _probe(all_words: Column, start: Column, length: int) -> Column:
    """Hash of a few words of the window of ``length`` words at 0-based ``start``."""
    at = sorted({round(k * (length - 1) / (PROBES - 1)) for k in range(PROBES)})
    return F.xxhash64(F.lit(length), *[F.get(all_words, start + F.lit(k)) for k in at])


def benchmark_windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """One row per different window: ``probe, win_words, win_len, items``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = F.size("w") < size
    spans = items.select(
        "item",
        F.explode(
            F.when(short, F.array(F.col("w"))).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))
            )
        ).alias("win_words"),
    )
    merged = spans.groupBy("win_words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    merged = merged.withColumn("win_len", F.size("win_words"))
    probe = F.lit(None).cast("long")
    for length in range(1, size + 1):
        probe = F.when(F.col("win_len") == length, _probe(F.col("win_words"), F.lit(0), length)).otherwise(probe)
    return merged.withColumn("probe", probe)


def _probes_of(starts: Column, length: int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), _probe(F.col("w"), i, length).alias("probe")))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document text: ``doc_id, text_key, copies, n_words, spans, items``.

    ``spans`` are sorted ``(start, end)`` word positions, end exclusive, of verified
    windows; ``copies`` says how many equal rows there are. Windows of over ``limit`` bytes are not broadcast.
    """
    windows = benchmark_windows(benchmark, size)
    stats = windows.agg(
        F.sort_array(F.collect_set("win_len")).alias("lengths"),
        F.sum(F.lit(64) + F.length(F.array_join("win_words", " ")) * 2 + F.length(F.array_join("items", " "))).alias("bytes"),
    ).head()
    lengths, weight = list(stats["lengths"] or []), stats["bytes"] or 0
    prepared = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    found = []
    for length in lengths:
        starts = F.when(F.col("n_words") >= length, F.sequence(F.lit(0), F.greatest(F.col("n_words") - length, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        found.append(_probes_of(starts, length))
    build = windows.select("probe", "win_words", "win_len", "items")
    joined = _broadcast(prepared, found, build) if weight <= limit else _shuffled(prepared, found, build)
    real = F.col("at") >= 0
    return joined.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum("copies").alias("copies"),
        F.array_sort(F.collect_set(F.when(real, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(real, F.col("items")))))).alias("items"),
    )


def _broadcast(prepared: DataFrame, found: list[Column], build: DataFrame) -> DataFrame:
    """A row for each verified window, ``at, len, items``, and one of ``at`` -1 that counts as a copy for each row of ``prepared``."""
    # That row is from a sentinel that all rows probe, so a single pass over the texts does.
    sentinel = build.sparkSession.createDataFrame([(0, 0)], "probe long, win_len int").select("probe", F.lit(None).cast("array<string>").alias("win_words"), "win_len", F.lit(None).cast("array<string>").alias("items"))
    first = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("probe")))
    probes = prepared.select("doc_id", "text_key", "n_words", "w", F.explode(F.concat(first, *found)).alias("p")).select("doc_id", "text_key", "n_words", "w", "p.*")
    same = F.when(F.col("at") < 0, F.col("win_len") == 0).otherwise((F.col("win_len") == F.col("len")) & (F.slice("w", F.col("at") + 1, F.greatest(F.col("len"), F.lit(1))) == F.col("win_words")))
    matched = probes.join(F.broadcast(build.unionByName(sentinel)), "probe").where(same)
    return matched.withColumn("copies", F.when(F.col("at") < 0, 1).otherwise(0))


def _shuffled(prepared: DataFrame, found: list[Column], build: DataFrame) -> DataFrame:
    """The same without a broadcast. What is shuffled for each window of a text has a bounded size."""
    key = ["doc_id", "text_key", "n_words"]
    rows = prepared.groupBy(*key).agg(F.count("*").alias("copies"))
    nothing = [F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("array<string>").alias("items")]
    if not found:
        return rows.select(*key, "copies", *nothing)
    probes = prepared.select(*key, F.explode(F.concat(*found)).alias("p")).select(*key, "p.*")
    likely = probes.join(build.select("probe").distinct(), "probe", "left_semi")
    # the words of likely windows only: places are brought back to their text, which is cut there
    places = likely.groupBy(*key).agg(F.collect_set(F.struct("at", "len", "probe")).alias("places"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key"))
    texts = prepared.alias("l").join(places.alias("r"), same).select("l.*", "r.places").dropDuplicates(["doc_id", "text_key"])
    windows = texts.select(*key, F.explode(F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["probe"].alias("probe"), F.slice("w", x["at"] + 1, x["len"]).alias("win_words")))).alias("p"))
    matched = windows.select(*key, "p.*").join(build.select("probe", "win_words", "items"), ["probe", "win_words"])
    return rows.select(*key, "copies", *nothing).unionByName(matched.select(*key, F.lit(0).cast("long").alias("copies"), "at", "len", "items"))


def covered(spans: Column) -> Column:
    """How many positions sorted spans cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs``: how many of its words lie in benchmark windows, and of which items.

    A document is contaminated if at least one word in ``share`` is hit.
    """
    found = hits(docs, benchmark, size, limit).select("doc_id", "text_key", "copies", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"), "items", "spans")
    full = found.select(
        "doc_id",
        "text_key",
        "copies",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )
    return full.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words at the positions of ``spans`` and the separators after them."""
    tail = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all(text, F.lit(tail), F.lit(0))
    # spans are sorted: what lies between their union is kept, as slices of the pieces
    kept = F.aggregate(
        F.concat(spans, F.array(F.struct(F.size(pieces).alias("start"), F.size(pieces).alias("end")))),
        F.struct(F.lit(0).alias("end"), lead.alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(s["start"] > acc["end"], F.concat(acc["out"], F.array_join(F.slice(pieces, acc["end"] + 1, s["start"] - acc["end"]), ""))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return kept


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents and without hit spans in the others.

    All columns stay; ``text`` and, if there is one, ``n_chars`` follow the cut.
    Clean documents, null and empty texts included, stay as they are.
    """
    id_, key, spans, out_, clean = (free_name(docs, name) for name in ("hit_id", "hit_key", "hit_spans", "hit_out", "clean_text"))
    found = hits(docs, benchmark, size).where(F.size("spans") > 0)
    found = found.select(
        F.col("doc_id").alias(id_),
        F.col("text_key").alias(key),
        F.col("spans").alias(spans),
        (covered(F.col("spans")) * share >= F.col("n_words")).alias(out_),
    )
    found = sized(found)
    kept = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left").where(~F.coalesce(F.col(out_), F.lit(False)))
    cleaned = F.when(F.col(spans).isNotNull(), without_spans(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    kept, out = kept.withColumn(clean, cleaned), {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(spans).isNotNull(), F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_key")


_WORDS_SQL = "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, len, array_to_string(w[i:i + len - 1], ' ') AS g FROM (
    SELECT item, w, least(len(w), 13) AS len, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM win),
dw AS (
  SELECT doc_id, len, i, array_to_string(w[i:i + len - 1], ' ') AS g FROM (
    SELECT doc_id, w, lens.len AS len, unnest(range(1, len(w) - lens.len + 2)) AS i FROM d, lens WHERE len(w) >= lens.len)),
m AS (SELECT doc_id, dw.len, i, item FROM dw JOIN win USING (len, g)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + len)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
}
QUERIES = {"op1_decontamination": op1_decontamination}
