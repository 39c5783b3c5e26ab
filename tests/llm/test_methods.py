"""Operators against independent brute force, and the frames that all of them must take."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seekloom.llm import bpe, decontaminate, html, language, neardup, privacy, shards, spots, toxicity, warc
from seekloom.llm._shared import running

from .common import SF
from .test_corpus_operators import _classes
from .test_text_operators import PLAIN, _brute, _codec, _near_words, _ok, _words

LARGE = 2**53 + 1
CLASHING = ["id", "__base", "__out", "__spans", "__hit_id", "base", "spans", "hit_id", "hit_spans", "hit_out", "hit_doc", "hit_terms", "clean_text", "copies", "kept_id", "kept_key", "kept_rows", "class_id", "node", "score", "place", "part", "key", "last", "label", "probe"]


def _odd_frame(spark):
    """A large id beside a null one, and columns of every name that an operator could use itself."""
    rows = [(LARGE, "the cat sat on the mat and then it ran away from all of us"), (LARGE - 1, "Hund und Katze"), (None, "the cat sat on the mat and then it ran away from all of us"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return df.select("*", *[F.lit(k).alias(name) for k, name in enumerate(CLASHING)])


OPERATORS = {
    "decontaminate": lambda df, spark, tmp: decontaminate.decontaminate(df, spark.createDataFrame([(1, "hund und katze")], "item_id long, text string")),
    "report": lambda df, spark, tmp: decontaminate.report(df, spark.createDataFrame([(1, "hund und katze")], "item_id long, text string")),
    "shards": lambda df, spark, tmp: shards.shard(df, F.lit(0), str(tmp / "s")).read(),
    "toxicity": lambda df, spark, tmp: toxicity.score(df, toxicity.learn(df, spark.createDataFrame([(LARGE, 1), (3, 0)], "doc_id long, toxic int"), F.lit(False))),
    "privacy": lambda df, spark, tmp: privacy.sanitise(df),
    "spans": lambda df, spark, tmp: privacy.find(df),
    "tokens": lambda df, spark, tmp: bpe.decode(bpe.encode(df)),
    "digests": lambda df, spark, tmp: bpe.digests(df),
    "language": lambda df, spark, tmp: language.predict(df, *language.learn(spark.createDataFrame([("en", "the cat"), ("de", "der Hund")], "lang string, text string"))),
    "fingerprints": lambda df, spark, tmp: spots.compared(df),
    "classes": lambda df, spark, tmp: neardup.classes(df),
    "keep_one": lambda df, spark, tmp: neardup.keep_one(df),
    "pages": lambda df, spark, tmp: html.extract(df.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))).withColumnRenamed("page_id", "doc_id"),
    "archives": lambda df, spark, tmp: warc.read(warc.write(df.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u")), str(tmp / "w")), "bigint").withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_large_ids_beside_null_and_clashing_names(spark, tmp_path, name):
    df = _odd_frame(spark)
    out = OPERATORS[name](df, spark, tmp_path)
    got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    gone = {"decontaminate": {LARGE - 1}}.get(name, set())
    assert got == collections.Counter({k: 1 for k in (LARGE, LARGE - 1, None, 3) if k not in gone})
    if set(CLASHING) <= set(out.columns):
        row = out.where(F.col("doc_id") == LARGE).head().asDict()
        assert [row[c] for c in CLASHING] == list(range(len(CLASHING)))


def test_string_ids(spark, tmp_path):
    rows = [(f"k{i:03d}", f"the cat {i} sat on the mat and saw dog number {i * i}") for i in range(50)] + [("null", "one"), (None, "two"), ("a/b c>", "three")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: r[0], reverse=True) + [(None, "two")]
    for ranges in (1, 5):
        got = {r.doc_id: r for r in spots.compared(df, ranges).collect()}
        for (one, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
            half = len(text) // 2
            assert got[one].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert sorted(str(r.doc_id) for r in neardup.classes(df).collect()) == sorted(str(r[0]) for r in rows)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    back = warc.read(warc.write(pages, str(tmp_path / "w")), "string").collect()
    assert sorted(str((r.page_id, r.payload_bytes)) for r in back) == sorted(str((k, len(t))) for k, t in rows)


def test_running_sums(spark):
    r = random.Random(1)
    rows = [([r.randrange(50) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 512, 3000)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", running(F.col("x")).alias("s")).collect()
    assert all(x.s == np.cumsum(x.x, dtype=int).tolist() for x in got)


# --- decontamination -------------------------------------------------------


def test_windows_without_a_broadcast(spark):
    r = random.Random(15)
    word = lambda: r.choice(["a", "B", "c", "é", "d1"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(1, text(3)), (2, text(15)), (3, None), (4, ""), (5, text(14)), (6, "b c"), (7, "b c")]
    docs = [(k, text(r.randint(0, 60))) for k in range(40)] + [(40, items[1][1]), (41, None), (41, None), (None, items[4][1]), (42, text(400))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.report(frame, bench, limit=0)
    assert sorted(repr(tuple(x)) for x in got.select(*columns).collect()) == _brute(docs, items)
    assert decontaminate.report(frame, bench.limit(0), limit=-1).count() == len(docs)


# --- shards ----------------------------------------------------------------


def test_arrivals_are_in_order_of_their_values(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(k, k) for k in (10, 2, 11, 0, 1, None)], "id long, day long")
    versions = store.append_by(df, "day")
    seen = [sorted((r.id is None, r.id) for r in store.read(v).collect()) for v in versions]
    assert [new[-1][1] for new in seen] == [0, 1, 2, 10, 11, None]


def test_other_columns_are_refused(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([(1,)], "id long"))
    for other in ("id long, extra int", "id int", "other long"):
        with pytest.raises(ValueError, match="columns"):
            store.append(spark.createDataFrame([], other))
    assert store.versions() == [1] and store.read().collect() == [(1,)]


def test_two_versions_stay_readable_through_a_merge(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "s"), target=1 << 22)
    for k in range(6):
        store.append(spark.range(k * 100, k * 100 + 100).coalesce(1))
    before = store.read()  # a reader of the version that the merge replaces
    version = store.versions()[-1]
    assert store.compact() == 1 and store.versions()[-2:] == [version, version + 1]
    assert before.count() == store.read(version).count() == store.read().count() == 600
    assert len(store.shards()) == 1 and len(store.shards(version)) == 6
    store.append(spark.range(5).coalesce(1))
    store.vacuum()
    assert store.versions() == [version + 1, version + 2] and store.read().count() == 605
    assert store.sweep(0.0) == []


def test_files_that_no_version_lists_are_swept(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "s"))
    store.append(spark.range(5))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "s/data/lost"))  # a job that failed before its commit
    assert store.sweep(3600.0) == [] and len(store.sweep(0.0)) == 1
    assert store.read().count() == 5


def test_many_segments_are_listed_in_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SEGMENTS", 3)
    store = shards.Store(spark, str(tmp_path / "s"))
    for k in range(5):
        store.append(spark.range(k, k + 1).coalesce(1))
    assert len(store._segments()) <= 3 and sorted(r.id for r in store.read().collect()) == list(range(5))


# --- toxicity --------------------------------------------------------------


def test_scores_are_those_of_plain_loops():
    r = np.random.default_rng(5)
    texts = [r.integers(-(2**62), 2**62, n) for n in (0, 1, 2, 3, 40, 7, 12, 5, 9, 30)]
    model = toxicity.train(texts * 8, np.tile([0, 1], 40), ["en"] * 80, 0.5)
    for text in texts:
        words = [sum(model.tables[k][(int(h) >> (16 * k)) & 0xFFFF].astype(float) for k in range(4)) for h in text]
        pooled = []
        for width, filters, offsets in zip(toxicity.WIDTHS, model.filters, model.offsets, strict=True):
            for f in range(toxicity.FILTERS):
                acts = [sum(float(words[at + j] @ filters[j, :, f]) for j in range(width)) + float(offsets[f]) for at in range(len(words) - width + 1)]
                pooled.append(max([0.0, *acts]))
        raw = float(np.dot(pooled, model.weights)) + model.bias
        assert toxicity.scores(model, [text])[0] == pytest.approx(1 / (1 + math.exp(-(model.scale * raw + model.shift))), abs=1e-5)


def test_thresholds_and_calibration_are_the_best_of_all():
    r = np.random.default_rng(3)
    for _ in range(20):
        y = (r.random(60) < 0.4).astype(float)
        score, weight = np.round(np.clip(0.3 * y + 0.7 * r.random(60), 0, 1), 2), np.where(y == 1, 0.5, 2.0)
        f1 = lambda c: 2 * (weight * y)[score >= c].sum() / ((weight * (score >= c)).sum() + (weight * y).sum())  # noqa: B023, E731
        best = max(f1(c) for c in np.linspace(0, 1, 401))
        assert f1(toxicity._threshold(score, y, weight)) == pytest.approx(best)
        raw = 4 * (score - 0.5)
        loss = lambda a, b: -(weight * np.log(np.where(y == 1, 1, -1) * (1 / (1 + np.exp(-(a * raw + b))) - 0.5) + 0.5)).sum() + 0.005 * ((a - 1) ** 2 + b * b)  # noqa: B023, E731
        a, b = toxicity._platt(raw, y, weight)
        assert loss(a, b) <= min(loss(x, z) for x in np.linspace(0.05, 5, 60) for z in np.linspace(-5, 5, 60)) + 1e-6


def test_the_query_gives_both_decisions(spark):
    docs = spark.createDataFrame([(1, "good day", "en"), (2, "bad bad", "de")], "doc_id long, text string, lang string")
    model = toxicity.train([], np.zeros(0), [], 0.5)
    model.weights[:], model.bias, model.thresholds = 0, -0.5, {"de": 0.9, "en": 0.1}
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert out[1].score == out[2].score == pytest.approx(1 / (1 + math.exp(0.5))) and out[1].toxic_here and not out[2].toxic_here


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(k % 50, f"word{k % 7} some text") for k in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 50, k % 50 % 2) for k in range(5000)], "doc_id long, toxic int")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "train", lambda texts, y, langs, prior: seen.append((len(texts), prior)))
        toxicity.learn(docs, labels, F.lit(False), per_class=10)
    assert seen[0][0] <= 30 and seen[0][1] == pytest.approx(0.5)


# --- privacy ---------------------------------------------------------------


def _all_spans(docs):
    """Base spans and disclosing terms, by loops over all documents."""
    base = {k: sorted((m.start(), rank, m.end(), m.group()) for rank, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, t or "") if _ok(kind, m.group())) for k, t in docs}
    near, in_docs, vocabulary = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for k, text in docs:
        vocabulary.update({w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if len(w) >= 3})
        for start, rank, end, value in base[k]:
            entity = (rank, value.lower() if rank == 0 else value if rank == 1 else re.sub("[^0-9]", "", value))
            in_docs[entity].add(k)
            for w in _near_words(text, start, end):
                near[entity, w].add(k)
    total, terms = len(docs), set()
    for (entity, w), found in near.items():
        n_e = len(in_docs[entity])
        chance = n_e / total
        share = (len(found) + privacy.PRIOR * chance) / (vocabulary[w] + privacy.PRIOR)
        if n_e < total and math.log(share / chance) / -math.log(chance) >= privacy.DISCLOSURE:
            terms.add(w)
    out = {}
    for k, text in docs:
        low = (text or "").lower()
        words = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]+", low) if m.group() in terms]
        free = [w for w in words if not any(b[0] < w[2] and w[0] < b[2] for b in base[k])]
        out[k] = ",".join(f"{[*[p for p, _ in PLAIN], 'term'][rank]}:{a}:{b}" for a, rank, b in sorted([(a, rank, b) for a, rank, b, _ in base[k]] + free))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_disclosing_terms_are_those_of_all_counts(spark, seed):
    r = random.Random(seed)
    common = [f"{a}{b}" for a in ("lo", "mi", "sa", "té", "ru") for b in ("ram", "nek", "dos", "ül")]
    rare = [f"qu{a}x{b}" for a in "abcdefgh" for b in "aeiou"]
    entities = ["ann@mail.example.org", "Bob@mail.example.org", "+1 555 010 0100", "10.1.2.3", "4111 1111 1111 1111"]
    docs = []
    for k in range(160):
        words = [r.choice(common if r.random() < 0.99 else rare) for _ in range(r.randint(0, 30))]
        if r.random() < 0.25:
            entity = r.choice(entities)
            words.insert(r.randint(0, len(words)), entity if r.random() < 0.8 else entity.upper())
            if r.random() < 0.7:
                words.insert(r.randint(0, len(words)), rare[entities.index(entity)].title())
        docs.append((k, " ".join(words) if words or k % 2 else None))
    docs.append((160, "a\x01b ann@mail.example.org \x01 quaxa"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.s for x in privacy.find(df).select("doc_id", privacy._listed(F.col("spans")).alias("s")).collect()}
    want = _all_spans(docs)
    assert got == want and any("term:" in s for s in want.values())


def test_texts_with_very_many_matches(spark):
    text = " ".join(f"u{k}@mail.example.org" for k in range(6000))
    (row,) = spark.createDataFrame([(text,)], "t string").select(privacy.matches(F.col("t"), F.lit(privacy.PATTERNS["email"])).alias("m")).collect()
    assert [(x.start, x.end) for x in row.m] == [m.span() for m in re.finditer(PLAIN[0][1], text)]


# --- language --------------------------------------------------------------


def test_language_scores_are_those_of_plain_counts(spark):
    rows = [("en", "the cat sat on a mat"), ("en", "This, that!"), ("de", "der Hund und die Katze"), ("de", "über Straße 12"), ("fr", "le chat est là"), ("fr", None)]
    names, matrix = language.learn(spark.createDataFrame(rows, "lang string, text string"))

    def grams(text):
        """Bigrams and trigrams of letters and single blanks, with their buckets."""
        t = "".join(c if c.isalpha() else " " for c in f"\n{(text or '').lower()}\n\n\n")
        for k in range(len(t) - 2):
            if t[k] == " " and t[k + 1] == " ":
                continue
            yield t[k : k + 2]
            yield t[k : k + 3]

    bucket = {}
    for _, text in [*rows, ("", "the dog is über alles là"), ("", "x")]:
        for gram in grams(text):
            buckets, _, _ = language._grams([gram])
            bucket[gram] = int(buckets[1][0 if len(gram) == 2 else 1]) if not (gram[0] == " ") else None
    counts = {n: collections.Counter() for n in names}
    for lang, text in rows:
        buckets, starts, _ = language._grams([(text or "").lower()])
        assert len(buckets) == starts[-1]
        counts[lang].update(int(b) for b in buckets.ravel() if b < language.BUCKETS)
    # buckets of one text are those of its grams, one for each place and width
    for _, text in rows:
        buckets, _, _ = language._grams([(text or "").lower()])
        assert sum(int(b) < language.BUCKETS for b in buckets.ravel()) == sum(1 for _ in grams(text))
    for text in ("the dog is über alles là", "Katze", "x", "le mat"):
        buckets, _, _ = language._grams([text.lower()])
        logs = []
        for n in names:
            total = sum(counts[n].values()) + 0.5 * language.BUCKETS
            logs.append(sum(math.log((counts[n][int(b)] + 0.5) / total) for b in buckets.ravel() if b < language.BUCKETS))
        best = max(range(len(names)), key=lambda k: logs[k])
        (got,) = language.predict(spark.createDataFrame([(text,)], "text string"), names, matrix).collect()
        assert got.lang_pred == names[best]
        assert got.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs), abs=1e-4)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), F.col("id")).alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language.sample(docs, F.lit(False))
    with pytest.raises(ValueError, match="languages"):
        language.learn(docs.select("lang", "text"))
    names, _ = language.learn(language.sample(docs.where("doc_id < 3"), F.lit(False)))
    assert names == ["l0", "l1", "l2"]


# --- fingerprints ----------------------------------------------------------


def test_signatures_are_those_of_plain_loops():
    import xxhash

    r = random.Random(12)
    pool = ["the", "and", "der", "und", "cat", "dog", "Haus", "été", "x1", "of", "日本", "語"]
    for _ in range(300):
        text = r.choice([" ", ", ", " - "]).join(r.choice(pool) for _ in range(r.randint(0, 40)))
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        chains, anchors = set(), 0
        content = [w for w in words if w not in spots.COMMON]
        if words and not content:
            chains = {" ".join(words)}
        elif words:
            chains = {"^ " + " ".join(content[:2])}
            for k, w in enumerate(words):
                after = [x for x in words[k + 1 :] if x not in spots.COMMON]
                if w in spots.COMMON and after:
                    anchors += 1
                    chains.add(" ".join([w, *after[:2]]))
            if anchors * spots.SPARSE < len(words):
                parts = [p for p in re.findall(r"[一-龯]|[^\W_一-龯]+", text.lower()) if p not in spots.COMMON]
                chains |= {" ".join(parts[k : k + 3]) for k in range(len(parts))}
        assert spots.signatures(text) == {xxhash.xxh32(c).intdigest() for c in chains}


# --- pages -----------------------------------------------------------------


def _quality(model, pages):
    right = wrong = missed = 0
    for page in pages:
        nodes, labels = html.parse(page), []
        for n in nodes:
            labels.append((labels[n.parent] if n.parent >= 0 else 1) if n.label is None else int(n.label))
        for n, y, p in zip(nodes, labels, model.marginals(nodes), strict=True):
            if n.tag == "#text":
                right += y == 1 and p >= 0.5
                wrong += y == 0 and p >= 0.5
                missed += y == 1 and p < 0.5
    return right / (right + wrong), right / (right + missed)


def test_names_that_were_never_seen():
    """Every name of an element is either in the training pages or in the tested ones."""
    for part in (0, 1):
        precision, recall = _quality(html.TreeModel(html.labelled_pages(part=part)), html.labelled_pages(120, seed=5, part=1 - part))
        assert precision > 0.75 and recall > 0.75, (part, precision, recall)


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("Let <math><mi>x</mi></math> be a number.", "Let x be a number."),
        ("See <object data='f'>the fallback text</object> here.", "See the fallback text here."),
        ("An <svg><svg><text>no</text></svg><text>nor this</text></svg> icon is here.", "An icon is here."),
        ("An <svg/> icon is here.", "An icon is here."),
        ("One <template><p>a</p><template>b</template><p>c</p></template>two words here.", "One\n\ntwo words here."),
        ("A <noframes>frame less</noframes> text of words.", None),
        ("Some <xmp>shown as it is</xmp> words.", None),
    ],
)
def test_nothing_of_an_article_is_lost_or_leaks(inner, text):
    got = html.default_model().extract(f"<body><article><h1>A long enough title</h1><p>{inner}</p><p>Some more words of the article stand here.</p></article></body>")
    kept = got.removeprefix("A long enough title\n\n").removesuffix("\n\nSome more words of the article stand here.")
    if text is None:
        assert re.sub(r"\s+", " ", kept) == re.sub(r"<[^>]*>", "", inner)
    else:
        assert kept == text


# --- tokens ----------------------------------------------------------------


def test_most_texts_go_through_the_tree(spark):
    sizes = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.length("text")).collect()]
    assert sum((n or 0) > bpe.LEAF for n in sizes) / len(sizes) > 0.8


# --- pipeline --------------------------------------------------------------


def _cut(text, items):
    """A text without benchmark windows; None if they are a twentieth of it or more."""
    windows = collections.defaultdict(set)
    for _, body in items:
        b = _words(body)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            windows[n].add(tuple(b[i : i + n]))
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    w, hit = _words(text), set()
    for n, known in windows.items():
        for at in range(len(w) - n + 1):
            if tuple(w[at : at + n]) in known:
                hit.update(range(at, at + n))
    if not hit:
        return text
    if 20 * len(hit) >= len(w):
        return None
    ends = [a for a, _ in places[1:]] + [len(text)]
    return text[: places[0][0]] + "".join(text[a:b] for k, ((a, _), b) in enumerate(zip(places, ends, strict=True)) if k not in hit)


def test_the_pipeline_is_its_stages_by_loops(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(frame, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.held_out_rows())
    rows = frame.select("doc_id", "text", "lang", toxicity.hashed(F.col("text")).alias("h")).collect()
    score = {r.doc_id: toxicity.scores(model, [np.array(r.h or [], np.int64)])[0] for r in rows}
    docs = [(r.doc_id, r.text) for r in rows if score[r.doc_id] < model.thresholds.get(str(r.lang), toxicity.THRESHOLD)]
    classes = _classes(docs)
    docs = [d for d in docs if classes[d[0]] == d[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(k, _cut(text, items)) for k, text in docs if text is None or _cut(text, items) is not None]
    spans, want = _all_spans(docs), {}
    _, plain = _codec(64)
    for k, text in docs:
        at, out = 0, ""
        for span in spans[k].split(",") if spans[k] else []:
            kind, start, end = span.split(":")
            if int(start) >= at:
                out += text[at : int(start)] + (f"[{kind.upper()}]" if kind != "term" else "[LONG WORD]" if int(end) - int(start) > 6 else "[WORD]")
            at = max(at, int(end))
        want[k] = plain.encode_ordinary(out + (text or "")[at:])
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(want) and got == want and len(got) < len(rows)
