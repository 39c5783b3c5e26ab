"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; whatever is not a letter counts as a space; bigrams and
trigrams of what results are hashed into ``BUCKETS``. Counts per language come
from a sample of the labelled rows (about ``per_language`` rows of each, chosen by
a hash of the id, so the bound does not depend on the size of the table). The matrix of
log-probabilities is broadcast; a batch's texts are scored at once in numpy by
gathering the rows of their n-grams and summing them text by text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows
with a null language or a null id are not learned from; with no labelled row at all every
text is ``und``; equal scores go to the language that sorts first; repeated rows each
give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, table

BUCKETS = 1 << 16
PER_LANGUAGE = 4000
#: Code points that are put into one numpy pass.
PASS = 1 << 19
#: A matrix has a column of 256 KB for each language.
MOST_LANGUAGES = 256

_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _alpha


def _passes(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of texts of about PASS code points together."""
    start, size, run = 0, 0, []
    for k, text in enumerate(texts):
        lowered = text.lower() if text else ""
        if run and size + len(lowered) > PASS:
            yield start, run
            start, size, run = k, 0, []
        run.append(lowered)
        size += len(lowered)
    if run:
        yield start, run


def _grams(run: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the offsets where each text's begin, and whether it has a letter.

    Each text stands between separators of its own, and no n-gram that counts spans two texts.
    """
    joined = "".join(f"\n{t}\n" for t in run) + "\n\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[codes]
    codes = np.where(alpha, codes, 32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in run])]).astype(np.int64)
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    two = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + third * np.uint64(0x165667B19E3779F9) + np.uint64(0x27D4EB2F165667C5)
    mix = np.uint64(0xD6E8FEB86659FD93)
    two = ((two ^ (two >> np.uint64(32))) * mix >> np.uint64(48)).astype(np.int32)
    three = ((three ^ (three >> np.uint64(32))) * mix >> np.uint64(48)).astype(np.int32)
    blank = ~alpha
    void = blank[:-2] & blank[1:-1]
    two[void] = three[void] = BUCKETS  # a column that no language scores
    buckets = np.stack([two, three], 1)[: starts[-1]]
    lettered = np.add.reduceat(alpha[: starts[-1]], starts[:-1]) > 0
    return buckets, starts, lettered


def sample(docs: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` labelled rows of each language (all, if there are fewer): ``lang, text``.

    More languages than a matrix may have are an error, before anything of theirs is collected or broadcast.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError("too many languages for a broadcast matrix")
    share = docs.sparkSession.createDataFrame([(r["lang"], per_language / r["count"]) for r in counts], T.StructType([T.StructField("__lang", docs.schema["lang"].dataType), T.StructField("__share", T.DoubleType())]))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(share), rows["lang"] == share["__lang"]).where(place < F.col("__share")).select("lang", "text")


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities: a row per bucket, the last row all 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, codes = np.unique(batch["lang"].astype(str), return_inverse=True)
            total = np.zeros(len(names) * (BUCKETS + 1), np.int64)
            for at, run in _passes(batch["text"].tolist()):
                buckets, starts, _ = _grams(run)
                owner = np.repeat(codes[at : at + len(run)], np.diff(starts))
                total += np.bincount((owner[:, None] * (BUCKETS + 1) + buckets).ravel(), minlength=len(total))
            seen = np.flatnonzero(total)
            seen = seen[seen % (BUCKETS + 1) < BUCKETS]
            yield pd.DataFrame({"lang": names[seen // (BUCKETS + 1)], "bucket": (seen % (BUCKETS + 1)).astype(np.int32), "n": total[seen]})

    counts = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.limit(MOST_LANGUAGES * BUCKETS + 1).toArrow().to_pandas()
    names = sorted(counts["lang"].unique())
    if len(names) > MOST_LANGUAGES or len(counts) > MOST_LANGUAGES * BUCKETS:
        raise ValueError("too many languages for a broadcast matrix")
    matrix = np.full((BUCKETS, len(names)), 0.5)
    matrix[counts["bucket"].to_numpy(), np.searchsorted(names, counts["lang"]) if names else []] += counts["n"].to_numpy()
    if names:
        matrix = np.log(matrix / matrix.sum(0))
        matrix -= matrix.mean(1, keepdims=True)  # only differences between languages count
    return names, np.vstack([matrix, np.zeros((1, len(names)))]).astype(np.float32)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language."""
    model = docs.sparkSession.sparkContext.broadcast((names, matrix))
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    at_text = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        for batch in batches:
            best, sure = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for at, texts in _passes(batch.column(at_text).to_pylist()) if langs else ():
                buckets, starts, lettered = _grams(texts)
                sums = np.empty((len(texts), len(langs)))
                for k in range(len(langs)):
                    column_logs = np.ascontiguousarray(logs[:, k])
                    each = column_logs[buckets[:, 0]] + column_logs[buckets[:, 1]]
                    sums[:, k] = np.add.reduceat(each, starts[:-1], dtype=np.float64)
                top = sums.argmax(1)
                posterior = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for i in np.flatnonzero(lettered):
                    best[at + i], sure[at + i] = langs[top[i]], posterior[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(sure)], [*batch.schema.names, pred, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    names, matrix = learn(sample(docs, held_out))
    scored = predict(docs.select("doc_id", "text", held_out.alias("held_out")), names, matrix)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
SQL: dict[str, str] = {}
