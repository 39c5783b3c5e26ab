"""Shards, archives, fingerprints, pages, near-duplicates and the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from seekloom.llm import html, neardup, shards, spots, warc
from seekloom.llm._shared import Folder

from .common import SF, edge_docs, empty_docs, write

# --- shards ----------------------------------------------------------------


def test_compaction_keeps_all_rows(spark, tmp_path):
    docs = edge_docs(spark).repartition(3)
    store = shards.Store(spark, str(tmp_path / "store"), target=1 << 22)
    assert store.read() is None
    for _ in range(5):
        store.append(docs)
    before = len(store.shards())
    assert store.versions()[-1] == 5 and store.compact() > 0
    assert len(store.shards()) < before and store.due() == []
    assert store.read().count() == 5 * docs.count()
    want = sorted(map(repr, docs.collect())) * 5
    assert sorted(map(repr, store.read().collect())) == sorted(want)


def test_a_version_is_committed_once(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "store"))
    store.append(edge_docs(spark))
    with pytest.raises(Exception, match="exist"):
        store._commit(1, [], None)
    assert store.read(1).count() == edge_docs(spark).count()
    store.append(empty_docs(spark).limit(0))
    assert store.versions() == [1, 2]


def test_files_of_half_the_target_are_left(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path / "store"), target=100)
    for _ in range(6):
        store.append(edge_docs(spark).coalesce(1))
    assert store.due() == [] and store.compact() == 0


# --- archives --------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(3)
    pages = [(k, f"http://x/{k}", "<html>" + " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(5, 400)))) for k in range(300)]
    pages += [(300, None, None), (301, "u\r\nv", ""), (302, "u", pages[4][2]), (303, "u", pages[4][2]), (None, "u", pages[5][2]), (304, "ü", "ß" * 50000), (7, "again", pages[7][2])]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write(df, str(tmp_path / "w"))
    made = manifest.collect()
    assert sum(m.records for m in made) == len(pages) and all(m.dictionary_bytes for m in made if m.records > 50)
    out = warc.read(manifest).collect()
    payload = {}
    for k, _, body in pages:
        payload.setdefault((body or "").encode(), []).append(k)
    want = []
    for k, _, body in pages:
        data = (body or "").encode()
        first = min((x for x in payload[data] if x is not None), default=None)
        kind = "response" if k == first else "revisit"
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if k == first else first))
    assert sorted(map(repr, want)) == sorted(repr((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in out)
    large = warc.read(warc.write(df, str(tmp_path / "w2"), least=10**6)).collect()
    assert {x.record_type for x in large} == {"response"}
    assert warc.read(warc.write(df.limit(0), str(tmp_path / "w3"))).count() == 0


def test_an_archive_begins_with_its_dictionary(tmp_path):
    records = [warc.record(str(k), "http://x", f"<p>{k} common words in all of them {k * k}".encode() * 5, "D", None, False) for k in range(500)]
    path = str(tmp_path / "a.warc.zst")
    _, raw = warc.write_archive(path, records)
    with open(path, "rb") as f:
        assert raw and f.read(4) == (0x184D2A5D).to_bytes(4, "little")
    assert [h["WARC-Record-ID"] for h, _ in warc.read_archive(path)] == [f"<urn:x-page:{k}>" for k in range(500)]


# --- fingerprints ----------------------------------------------------------


def _spot_rows(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(spots.signatures, (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), spots.fingerprint(a), spots.fingerprint(b), spots.likeness(a, b), spots.likeness(a, c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_next_documents_over_any_ranges(spark, ranges):
    r = random.Random(ranges)
    docs = [(r.randint(-(10**12), 10**12) if k % 2 else k, r.choice([None, "", "The cat sat on the mat and the dog ran", "🙂 der Hund und die Katze " * k])) for k in range(61)]
    docs = list({d[0]: d for d in docs}.values())
    got = spots.compared(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), ranges).collect()
    assert sorted(repr(tuple(x)) for x in got) == _spot_rows(docs)


def test_spots_edges(spark):
    out = spots.compared(edge_docs(spark)).collect()
    assert len(out) == edge_docs(spark).count() and sum(r.doc_id is None for r in out) == 1
    assert spots.compared(empty_docs(spark)).count() == 0
    one = spots.compared(spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_texts_without_anchors_count_as_a_whole():
    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdfgklmnprstvz") for _ in range(7))
    start = [word(), word()]
    for one, two in (([word() for _ in range(60)], [word() for _ in range(60)]), (["the"] + [word() for _ in range(60)], [word() for _ in range(60)])):
        one, two = " ".join(start + one), " ".join(start + two)
        assert spots.likeness(*map(spots.signatures, (one, two))) < 0.1
        for k in (0, 1, 30):  # near copies: one word differs
            copy = one.split()
            copy[k] = word()
            assert 0.8 < spots.likeness(spots.signatures(one), spots.signatures(" ".join(copy))) < 1.0
    ends = [" ".join(start + [word() for _ in range(20)] + ["the"] * 20) for _ in range(2)]  # common words with nothing after them
    assert spots.likeness(*map(spots.signatures, ends)) < 0.1
    chinese = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(200))
    assert 0.9 < spots.likeness(spots.signatures(chinese), spots.signatures(chinese[:100] + "一二" + chinese[100:])) < 1.0


def test_pruned_likeness_is_exact_above_the_least():
    r = random.Random(1)
    for _ in range(500):
        a, b = (frozenset(r.sample(range(30), r.randint(0, 20))) for _ in range(2))
        full = spots.likeness(a, b)
        low, high = spots.partitions(len(a), 0.5) if a else (0, 0)
        if full >= 0.5:
            assert spots.likeness(a, b, 0.5) == full and low <= len(b) <= high
        else:
            assert spots.likeness(a, b, 0.5) == 0.0


# --- pages -----------------------------------------------------------------


def test_marginals_are_exact():
    model = html.TreeModel(html.labelled_pages(40))
    nodes = html.parse("<body><nav><a href=x>Home</a></nav><article><h1>Title words</h1><p>A sentence here.</p></article></body>")
    got = model.marginals(nodes)
    features = html.features(nodes)
    total = np.zeros((len(nodes), 2))
    for bits in range(2 ** len(nodes)):
        label = [(bits >> k) & 1 for k in range(len(nodes))]
        log = 0.0
        for k, node in enumerate(nodes):
            kind = "#text" if node.tag == "#text" else "other"
            log += sum(model._seen[kind, f][label[k]] for f in features[k] if (kind, f) in model._seen)
            if k:
                log += model._edges.get(html._edge(node), model._unseen)[label[node.parent]][label[k]]
        for k in range(len(nodes)):
            total[k, label[k]] += np.exp(log)
    assert np.allclose(got, total[:, 1] / total.sum(1))


def test_extraction_on_unseen_layouts():
    model = html.default_model()
    right = wrong = missed = 0
    for page in html.labelled_pages(120, seed=77):
        nodes, labels = html.parse(page), []
        for n in nodes:
            labels.append((labels[n.parent] if n.parent >= 0 else 1) if n.label is None else int(n.label))
        for n, y, p in zip(nodes, labels, model.marginals(nodes), strict=True):
            if n.tag == "#text":
                right += y == 1 and p >= 0.5
                wrong += y == 0 and p >= 0.5
                missed += y == 1 and p < 0.5
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_extraction_of_a_page():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
        '<div class="ad">Buy this now.</div><article><h1>A title &amp; more</h1><p><b>First   words\nof it.<br>Then<p>Second &#233;t&eacute;.</p><!-- no --></article>'
        '<aside class="sidebar"><p>Other things to read.</p></aside><section id="comments"><p>Nice one.</p></section><footer>&copy; x</footer></body></html>'
    )
    assert html.default_model().extract(page) == "A title & more\n\nFirst words of it. Then\n\nSecond été."
    assert html.default_model().extract(None) == html.default_model().extract("") == ""
    deep = "<div>" * 5000 + "<p>text</p>"
    assert isinstance(html.default_model().extract(deep), str)
    assert isinstance(html.default_model().extract('<p class="<a <b \'>x</p' + "<" * 5000), str)


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article><p>Some words here.</p></article>", "y"), (2, "u", "", "z"), (2, "u", "", "z")], "page_id long, url string, html string, text string")
    out = html.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "Some words here.", 16), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


# --- near-duplicates -------------------------------------------------------


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        n = int(r.integers(1, 60))
        element = r.integers(1, 2**63, n).astype(np.uint64)
        a, b = r.integers(0, 12, n), r.integers(0, 12, n)
        bags = [(element[w > 0], w[w > 0]) for w in (a, b)]
        if not (a.sum() and b.sum()):
            continue
        s = neardup.signatures(bags, 400)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_signatures_do_not_depend_on_the_batch():
    r = np.random.default_rng(2)
    bags = [(r.integers(1, 2**63, n).astype(np.uint64), r.integers(1, 9, n)) for n in (1, 5, 300, 2)]
    together = neardup.signatures(bags)
    assert all(np.array_equal(neardup.signatures([b])[0], t) for b, t in zip(bags, together, strict=True))


def _family(r, base, edits, vocabulary):
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(vocabulary)
    return " ".join(w)


def _classes(docs):
    """Connected components of similarity 0.8 and more, by all pairs."""
    import re

    bags = []
    for _, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
        bags.append(w)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    from collections import Counter

    grams = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in bags]
    for i in range(len(docs)):
        for k in range(i):
            both, total = sum((grams[i] & grams[k]).values()), sum((grams[i] | grams[k]).values())
            if (total and both / total >= 0.8) or (not total and docs[i][1] is not None and docs[i][1] == docs[k][1]):
                root[max(find(i), find(k))] = min(find(i), find(k))
    least = {}
    for k, (doc, _) in enumerate(docs):
        least[find(k)] = min(doc, least.get(find(k), doc))
    return {doc: least[find(k)] for k, (doc, _) in enumerate(docs)}


@pytest.mark.parametrize(("texts", "runs", "many"), [(neardup.BLOCK_TEXTS, neardup.BLOCK_RUNS, neardup.MANY), (12, neardup.BLOCK_RUNS, 0), (neardup.BLOCK_TEXTS, 900, 5)])
def test_classes_are_those_of_all_pairs(spark, texts, runs, many, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(neardup, "BLOCK_RUNS", runs)
    monkeypatch.setattr(neardup, "MANY", many)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    r = random.Random(6)
    vocabulary = [f"v{k}" for k in range(300)]
    docs = []
    for _ in range(4):
        base = [r.choice(vocabulary) for _ in range(120)]
        docs += [_family(r, base, r.randint(0, 5), vocabulary) for _ in range(30)]
    docs += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(40)]
    docs += ["", "", None, None, "one two", "One, two!", "##", "##", "#", "again " * 50, "again " * 55]
    docs = list(enumerate(docs, 1))
    r.shuffle(docs)
    got = {x.doc_id: x.class_id for x in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _classes(docs)


def test_blocks_join_what_their_links_join(spark, tmp_path):
    """Blocks over families of one and many components, against all pairs that share a band."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(2)
    rows, texts = [], {}
    for family in range(5):
        base = [r.randrange(1000) for _ in range(60)]
        for _ in range([3, 40, 90, 7, 60][family]):
            words = [w if r.random() > 0.02 else r.randrange(1000) for w in base]
            texts[len(rows)] = np.array(words, np.int64)
            label = r.choice([1000 * family, 1000 * family + 1, 1000 * family + 2 + len(rows)])
            rows.append((len(rows), label, family, [r.randrange(2) + 10 * family, r.randrange(4) + 100 * family + 1000], len(words) - 4))
    open_ = spark.createDataFrame(rows, "node long, label long, family long, bands array<long>, runs int")
    hashed = spark.createDataFrame([(k, t.tolist()) for k, t in texts.items()], "node long, h array<long>")
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    def joined(edges):
        root.clear()
        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {label: find(label) for _, label, *_ in rows}

    want = joined([(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and any(x == y for x, y in zip(a[3], b[3], strict=True)) and neardup.weighted_jaccard(texts[a[0]], texts[b[0]]) >= 0.8])
    for size in (8, 25, 2048):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(neardup, "BLOCK_TEXTS", size)
            found = neardup._in_blocks(Folder(spark, "blocks"), open_, hashed, 0.8).collect()
        assert joined([(e.a, e.b) for e in found]) == want and all(e.a != e.b for e in found)


def test_an_id_with_several_texts_loses_no_link(spark):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b, "end"])), (3, " ".join([*a, "end"])), (4, "alone")]
    df = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, id string, class_id int")
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r)[:2] for r in kept.collect()) == sorted([docs[0], docs[1], docs[4]])


def test_one_of_each_class_stays(spark):
    docs = edge_docs(spark)
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert neardup.keep_one(empty_docs(spark)).count() == 0


# --- pipeline --------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "privacy", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        write(stage(spark, docs, SF), str(tmp_path), f"{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        if name != "tokens":
            assert docs.columns == columns
        assert 0 < docs.count() <= kept
        kept = docs.count()
    assert docs.select("doc_id").distinct().count() == kept
    assert "pipeline" in __spark_entry__.queries()


def test_the_languages_thresholds_decide_in_the_pipeline(spark, monkeypatch):
    marked = "CASE doc_id WHEN 1 THEN 0.4D WHEN 2 THEN 0.2D ELSE 0.0D END AS score", "doc_id = 2 AS toxic_here"
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *a: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda docs, model: docs.selectExpr("*", *marked))
    docs = spark.createDataFrame([(1, "over 0.3"), (2, "under 0.3"), (3, "none")], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()) == [(1, "over 0.3"), (3, "none")]


def test_pipeline_takes_empty_and_odd_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        write(spark.read.parquet(f"{SF}/{name}.parquet"), str(tmp_path), name)
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge_docs(spark).select(*plain), empty_docs(spark).select(*plain)):
        write(docs, str(tmp_path), "documents")
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert len(out) <= docs.count()


