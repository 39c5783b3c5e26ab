"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of one row of each of four tables, picked by hashes
of the lower-cased word and of its first four, five and six letters
(so that forms of a word share what is learned of one). Filters of ``WIDTHS`` words slide over the whole text,
each filter's largest activation is kept (max pooling), and a logistic unit reads
those. Training takes a bounded sample of labelled rows; a held-back part of the
sample calibrates the score (Platt scaling, which also undoes the sample's class
balance) and picks a threshold for each language.

Inference is cheap because a filter is linear in the embeddings: for each position
in the filter the product of a word's embedding is looked up, summed and pooled.

Defined cases: null and wordless texts pool to zero and get the score of that;
labels other than 0 and 1 and null ids are not learned from; a label that is repeated
counts once, and of rows that repeat an id the one of the least text is learned from; with no usable row of either class every
score is the share of toxic labels seen (0 if none); other columns, whatever their
names, pass through; a language without enough labels gets the common threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free_name, small_batches, table, trim, words

BUCKETS, HASHES, DIM = 1 << 16, 4, 8
PREFIXES = (4, 5, 6)
WIDTHS, FILTERS = (1, 2, 3), 8
#: The bound of the training sample: rows of each class, and words of a sampled row.
PER_CLASS, SAMPLE_WORDS = 2500, 3000
EPOCHS = 6
#: A hash bucket is learned if so many texts of the sample have it.
LEAST_TEXTS = 4
#: The contract's common threshold; languages get their own in :attr:`Model.thresholds`.
THRESHOLD = 0.3
LEAST_PER_LANGUAGE = 30
#: Words that are scored in one numpy pass.
PASS = 1 << 17


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) for each width
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def hashed(text: Column) -> Column:
    """One long for each lower-cased word: 16 bits each of the word's hash and its prefixes'."""

    def packed(word: Column) -> Column:
        bits = F.xxhash64(word).bitwiseAND(F.lit(0xFFFF))
        for k, size in enumerate(PREFIXES, 1):
            bits = bits.bitwiseOR(F.shiftleft(F.hash(F.substring(word, 1, size)).cast("long").bitwiseAND(F.lit(0xFFFF)), 16 * k))
        return bits

    return F.transform(words(text, lower=F.lower(text)), packed)


def _buckets(hashes: np.ndarray) -> list[np.ndarray]:
    bits = hashes.astype(np.int64).view(np.uint64)
    return [((bits >> np.uint64(16 * k)) & np.uint64(BUCKETS - 1)).astype(np.int32) for k in range(HASHES)]


def _pool(model: Model, at: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Pooled activations of one text, where each filter was largest, and its embeddings."""
    emb = sum(t[a] for t, a in zip(model.tables, at, strict=True))
    pooled, best, n = [], [], len(emb)
    for width, w, b in zip(WIDTHS, model.filters, model.offsets, strict=True):
        if n < width:
            pooled.append(np.zeros(FILTERS))
            best.append(np.full(FILTERS, -1))
            continue
        out = sum(emb[k : n - width + 1 + k] @ w[k] for k in range(width)) + b
        where = out.argmax(0)
        pooled.append(np.maximum(out[where, np.arange(FILTERS)], 0))
        best.append(np.where(pooled[-1] > 0, where, -1))
    return np.concatenate(pooled), best, emb


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list, prior: float, seed: int = 7) -> Model:
    """Fit on hashed texts; every fifth row is held back to calibrate. ``prior``: the share of toxic rows."""
    random = np.random.default_rng(seed)
    model = Model(
        [np.zeros((BUCKETS, DIM), np.float32) for _ in range(HASHES)],
        [(random.normal(0, 0.5, (w, DIM, FILTERS))).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS],
        random.normal(0, 0.3, FILTERS * len(WIDTHS)),
        0.0,
    )
    every = [_buckets(t) for t in texts]
    # What few texts have can only be learned by heart: such rows stay at zero.
    known = []
    for k in range(HASHES):
        seen = np.zeros(BUCKETS, np.int32)
        for at in every:
            seen[np.unique(at[k])] += 1
        known.append(seen >= LEAST_TEXTS)
    held = np.arange(len(texts)) % 5 == 4
    fit = np.flatnonzero(~held)
    square = {"tables": [np.full(BUCKETS, 1e-3, np.float32) for _ in range(HASHES)], "filters": [np.full_like(w, 1e-3) for w in model.filters], "weights": np.full_like(model.weights, 1e-3), "bias": 1e-3}
    rate = 0.1
    for _ in range(EPOCHS):
        random.shuffle(fit)
        for i in fit:
            x, best, emb = _pool(model, every[i])
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
            error = p - labels[i]
            if abs(error) < 0.02:
                continue
            into = error * model.weights  # what each pooled value should change by
            step = error * x
            square["weights"] += step**2
            model.weights -= rate * step / np.sqrt(square["weights"])
            square["bias"] += error**2
            model.bias -= rate * error / np.sqrt(square["bias"])
            for k, width in enumerate(WIDTHS):
                part = into[k * FILTERS : (k + 1) * FILTERS]
                for f in np.flatnonzero(best[k] >= 0):
                    w, at = model.filters[k], best[k][f]
                    change = part[f] * emb[at : at + width]
                    to_words = part[f] * w[:, :, f]
                    square["filters"][k][:, :, f] += change**2
                    w[:, :, f] -= rate * 0.3 * change / np.sqrt(square["filters"][k][:, :, f])
                    for table_, seen, rows, known_ in zip(model.tables, square["tables"], every[i], known, strict=True):
                        for j in range(width):
                            row = rows[at + j]
                            if known_[row]:
                                seen[row] += (to_words[j] ** 2).mean()
                                table_[row] -= rate * to_words[j] / np.sqrt(seen[row])
    back = np.flatnonzero(held)
    raw = np.array([_pool(model, every[i])[0] @ model.weights + model.bias for i in back])
    y = labels[back].astype(float)
    # The sample takes as many of either class as there are, so rows weigh what they stand for.
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)) if len(y) else y
    model.scale, model.shift = _platt(raw, y, weight)
    score = 1 / (1 + np.exp(-np.clip(model.scale * raw + model.shift, -30, 30)))
    names = np.array([str(langs[i]) for i in back])
    for lang in sorted(set(names)):
        own = names == lang
        if own.sum() >= LEAST_PER_LANGUAGE and 0 < y[own].sum() < own.sum():
            model.thresholds[lang] = _threshold(score[own], y[own], weight[own])
    return model


def _platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    if not 0 < y.sum() < len(y):
        return a, b
    for _ in range(50):  # Newton steps, with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-6
        grad = np.array([(g * raw).sum() + 0.01 * (a - 1), g.sum() + 0.01 * b])
        hess = np.array([[(h * raw * raw).sum() + 0.01, (h * raw).sum()], [(h * raw).sum(), h.sum() + 0.01]])
        da, db = np.linalg.solve(hess, grad)
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -1, 1)
    return float(a), float(b)


def _threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the best cut by weighted F1, nearest to the common threshold."""
    cuts = np.unique(np.concatenate([score, [0.0, 1.0]]))
    middles = np.append((cuts[1:] + cuts[:-1]) / 2, THRESHOLD)
    hit = np.array([(weight * y)[score >= c].sum() for c in middles])
    f1 = 2 * hit / np.maximum([(weight * (score >= c)).sum() + (weight * y).sum() for c in middles], 1e-9)
    good = middles[f1 >= f1.max() - 1e-12]
    return float(good[np.abs(good - THRESHOLD).argmin()])


def scores(model: Model, texts: list) -> np.ndarray:
    """Scores of texts given as arrays of hashes (None: no words)."""
    # products of embeddings and filters, once per call and bucket table: BUCKETS x FILTERS per filter position
    texts = [np.asarray([] if t is None else t, np.int64) for t in texts]
    out = np.empty((len(texts), len(WIDTHS) * FILTERS))
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= PASS):
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[start:end]])
        flat = np.concatenate([*texts[start:end], np.zeros(1, np.int64)])
        emb = sum(t[a] for t, a in zip(model.tables, _buckets(flat), strict=True))
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for k, (width, w, b) in enumerate(zip(WIDTHS, model.filters, model.offsets, strict=True)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            out[start:end, cols] = 0
            able = np.flatnonzero(lengths >= width)
            if not len(able):
                continue
            n = len(flat) - width
            act = sum(emb[j : n + j] @ w[j] for j in range(width)) + b
            # windows over a text's end are cut off by reducing from its first to one past its last window
            edges = np.stack([begin[able], begin[able] + lengths[able] - width + 1], 1).ravel()
            act = np.vstack([act, np.full((1, FILTERS), -np.inf, act.dtype)])
            out[start + able, cols] = np.maximum(np.maximum.reduceat(act, edges)[::2], 0)
        start = end
    raw = out @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(model.scale * raw + model.shift, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = PER_CLASS) -> Model:
    """Sample labelled rows of ``docs`` (ids with null or true ``held_out`` never) and train."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    known = known.where(~F.coalesce(held_out, F.lit(True))).distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, per_class / max(counts.get(1, 0), 1)).otherwise(per_class / max(counts.get(0, 0), 1))
    # about per_class rows of each class, whatever the table's size, and never more than this
    chosen = known.withColumn("place", place).where(F.col("place") < share).orderBy("place", "doc_id", "toxic").limit(3 * per_class)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # the sample is taken before its words are hashed
    rows = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("r"))
    rows = rows.select("doc_id", "toxic", "r.lang", hashed(F.col("r.text")).alias("h")).where(F.size("h") <= SAMPLE_WORDS)
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    labels_ = rows.column("toxic").to_numpy().astype(np.int64)
    if len(set(labels_.tolist())) < 2:
        model = train([], np.zeros(0), [], prior)
        model.weights[:], model.bias = 0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        return model
    hashes = [h.values.to_numpy() for h in rows.column("h")]
    return train(hashes, labels_, rows.column("lang").to_pylist(), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``toxic_here``: the score is at least its language's threshold.

    Only the words' hashes go to Python; all columns of ``docs`` stay where they are.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * HASHES * DIM floats: 8 MB, whatever the input
    out, here = free_name(docs, "score"), free_name(docs, "toxic_here")

    @F.arrow_udf("double")
    def run(hashes: pa.Array) -> pa.Array:
        flat, ends = hashes.values.to_numpy(zero_copy_only=False), hashes.offsets.to_numpy()
        made = pa.array(scores(shared.value, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]))
        trim()
        return made

    limit = F.lit(THRESHOLD)
    if "lang" in docs.columns:
        for lang, own in sorted(model.thresholds.items()):
            limit = F.when(F.col("lang").cast("string") == str(lang), F.lit(float(own))).otherwise(limit)
    made = docs.withColumn(out, run.asNondeterministic()(hashed(F.col("text"))))  # else it runs once for each use
    return made.withColumn(here, F.col(out) >= limit)


def held_out_rows() -> Column:
    """The rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels, held_out_rows())
    narrow = docs.select("doc_id", F.coalesce(held_out_rows(), F.lit(False)).alias("held_out"), "text", "lang")
    made = score(narrow, model)
    return made.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxic_here").cast("int").alias("predicted_by_language"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
