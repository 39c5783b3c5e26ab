"""What must not grow with the input: memory of a Python worker, rows of a shuffle, passes over the texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from seekloom import suite
from seekloom.functions import batches
from seekloom.functions import text as t
from seekloom.operators import grams, overlay, search
from seekloom.plans import catalog as plans
from seekloom.plans.catalog import Catalog
from seekloom.plans.store import Store

BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture
def wide(spark):
    """A session whose batches are as large as by default, and afterwards again as they were."""
    before = {k: spark.conf.get(k) for k in BATCH}
    for k in BATCH:
        spark.conf.unset(k)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _batch(blocks, texts):
    return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(texts)], ["block_id", "folded"])


def _plain(blocks, texts, width):
    return sorted({(b, grams.code(x.encode()[k : k + width])) for b, x in zip(blocks, texts, strict=True) if x for k in range(len(x.encode()) - width + 1)}, key=str)


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 18])
def test_grams_of_pieces_are_those_of_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(grams, "PIECE", piece)
    r = random.Random(piece)
    blocks = sorted(r.choice([1, 2, 3, 9, None]) or 0 for _ in range(60))
    texts = [None if r.random() < 0.1 else "".join(r.choice("abé ") for _ in range(r.choice([0, 1, 2, 3, 30]))) for _ in blocks]
    blocks = [b or None for b in blocks]
    whole = _batch(pa.array(blocks, pa.int64()), texts)
    for step in (1, 2, 11, 60):
        made = grams._by_block([whole.slice(k, step) for k in range(0, 60, step)], (2, 5))
        got = [(blocks_[int(k)].as_py(), int(x)) for blocks_, which, value in made for k, x in zip(which, value, strict=True)]
        assert len(got) == len(set(got))
        assert sorted(got, key=str) == sorted(_plain(blocks, texts, 2) + _plain(blocks, texts, 5), key=str)


@pytest.mark.parametrize("width", [3, 5])
def test_a_long_line_takes_bounded_memory(width):
    long = _batch([7], ["abcdefgh" * (1 << 20)])
    tracemalloc.start()
    try:
        assert sum(len(v) for *_, v in grams._by_block([long], (width,))) == 8
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20  # the line itself is 8 MB, its windows as numbers 64


# the worker's batch
@pytest.mark.parametrize("name", ["gram_candidates", "overlay_limits", "first_batch"])
def test_workers_get_small_batches(wide, name):
    suite.QUERIES[name](wide, "/root/testdata/sf0.001")
    assert int(wide.conf.get(BATCH[0])) <= batches.BATCH_ROWS
    assert int(wide.conf.get(BATCH[1]).rstrip("b")) <= batches.BATCH_BYTES


# F5, F6, F8, F12: no pair of a gram and a file is shuffled where files are whole
@pytest.mark.parametrize("name", ["gram_df", "gram_df_five", "gram_budget", "gram_rare", "capacity_report"])
def test_frequencies_come_without_pairs(spark, monkeypatch, name):
    want = sorted(map(repr, suite.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(grams, "grams", lambda *a, **b: pytest.fail("pairs were made"))
    assert sorted(map(repr, suite.QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want


@pytest.mark.parametrize("parts", [1, 3])
def test_frequencies_are_exact_wherever_rows_of_a_file_stand(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice([1, 2, 3, 4, None]), "".join(r.choice("abc") for _ in range(9))) for _ in range(40)]
    for own in (rows, sorted(rows, key=str)):  # in several places, and each file in one
        units = t.normalised_units(spark.createDataFrame(own, "doc_id long, text string").coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(own, "doc_id long, text string").coalesce(1))
        want = sorted(map(tuple, grams.document_frequency(grams.grams(units), 3).collect()))
        assert sorted(map(tuple, grams.frequencies(units, most=3).collect())) == want
        assert sum(x.df for x in grams.frequencies(units, most=None).collect()) == grams.grams(units).count()


# pairs of frequent grams stay in the worker
def test_the_index_makes_no_pairs_of_frequent_grams(spark):
    docs = [(k, f"every line has this, and number {k:05d}") for k in range(800)]
    units = grams.packed(t.normalised_units(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)), 256).persist()
    kept = grams.Index.build(units, 10**7)["postings"].select("gram").distinct().persist()
    sieve = grams._sieve(kept, 10**4)
    through = grams._pairs(units, (3, 4, 5), "block_id", sieve).distinct()
    assert through.join(kept, "gram", "left_semi").count() == grams._pairs(units, (3, 4, 5), "block_id").distinct().join(kept, "gram", "left_semi").count()
    assert through.count() < 0.5 * grams._pairs(units, (3, 4, 5), "block_id").distinct().count()


# units are made once and read as they are stored
def test_a_base_makes_its_units_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches_):
        for batch in batches_:
            made.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([(k, f"line {k}\nother {k}") for k in range(50)], "file_id long, text string")
    records = spark.createDataFrame([(k, f"f/{k}", 9, 5) for k in range(50)], "file_id long, path string, size long, modified_ns long")
    catalog = Catalog(spark, str(tmp_path / "c"), 256)
    units = catalog._units(files)
    cached = len(list(spark.sparkContext._jsc.getPersistentRDDs().keySet()))
    catalog._base(records, units.mapInArrow(counted, units.schema), 0)
    assert made.value == 100
    assert len(list(spark.sparkContext._jsc.getPersistentRDDs().keySet())) <= cached + 1  # the counts of grams, not the units
    assert sorted(tuple(x) for x in catalog.load().hits("other 7").collect()) == [(7, 2, 0)]


def test_limits_hold_over_small_batches(wide, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_ROWS", 3)
    docs = wide.createDataFrame([(k, "\n".join(["idiot idiot"] * 7)) for k in range(10)], "doc_id long, text string")
    found = search.literal_hits(t.normalised_units(docs), "idiot")
    got = sorted(tuple(x) for x in overlay.limited_content(found.where("file_id % 5 <> 2"), found.where("file_id % 5 = 2"), search.Limits(9, 10, 30)).collect())
    assert got == [(0, n, b) for n in range(1, 6) for b in (0, 6)]


# one sort of the windows for all widths
def test_windows_are_made_once_for_all_widths(monkeypatch):
    made, windows = [], grams._windows
    monkeypatch.setattr(grams, "_windows", lambda *a: made.append(1) or windows(*a))
    texts = ["a\0\0b", "a", "", "ab\0", "ab", "\0\0\0\0\0\0", "abcdef"]
    got = [(b[int(k)].as_py(), int(x)) for b, which, value in grams._by_block([_batch([1, 1, 2, 2, 3, 3, 4], texts)], (3, 4, 5)) for k, x in zip(which, value, strict=True)]
    assert sorted(got) == sorted(x for width in (3, 4, 5) for x in _plain([1, 1, 2, 2, 3, 3, 4], texts, width))
    assert len(made) == 1


# where a twentieth of the bits is set, far less than a twentieth of the other grams passes
def test_a_sieve_lets_few_others_through(spark):
    r = np.random.default_rng(1)
    kept = r.choice(1 << 40, 3000, replace=False) | 5 << 56
    sieve = grams._sieve(spark.createDataFrame([(int(x),) for x in kept], "gram long"), 4000)
    texts = ["".join(chr(97 + c) for c in r.integers(0, 26, 3000)) for _ in range(20)]
    units = t.normalised_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert grams._pairs(units, (5,), "file_id", sieve).count() < 0.015 * grams._pairs(units, (5,), "file_id").count()
    ours = [grams.code(texts[3][k : k + 5].encode()) for k in range(500)]
    sieve = grams._sieve(spark.createDataFrame([(x,) for x in ours], "gram long"), 4000)
    assert grams._pairs(units, (5,), "file_id", sieve).where(f"gram IN ({', '.join(map(str, ours))})").select("gram").distinct().count() == len(set(ours))


# a compaction leaves out what is gone where it is read, and what was written isn't read again to be summed
@pytest.mark.parametrize("most", [1 << 21, 0])
def test_a_compaction_shuffles_no_units(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(plans, "MOST_GONE", most)
    frame = type(spark.range(0))
    ranged, summed, sums, sort = [], [], Store._summed, frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: ranged.append(1) or sort(self, *a))
    monkeypatch.setattr(Store, "_summed", staticmethod(lambda df: summed.append(1) or sums(df)))
    files = spark.createDataFrame([(k, f"line {k}\nother {k % 9}") for k in range(60)], "file_id long, text string")
    records = spark.createDataFrame([(k, f"f/{k}", 9, 5) for k in range(60)], "file_id long, path string, size long, modified_ns long")
    catalog = Catalog(spark, str(tmp_path / "c"), 256)
    catalog.initialise(records, files)
    seen = records.where("file_id <> 7").selectExpr("file_id", "path", "CASE WHEN file_id = 16 THEN 10L ELSE size END AS size", "modified_ns")
    texts = files.selectExpr("file_id", "CASE WHEN file_id = 16 THEN 'new\nline\nother 7' ELSE text END AS text")
    catalog.reconcile(seen, texts)
    now = catalog.load()
    assert now.overlay is None and len(ranged) == (0 if most else 1)
    assert len(summed) == 4 + 3 + 4  # tables of a base, an overlay and a base
    assert sorted(tuple(x) for x in now.hits("other 7").collect()) == [(16, 3, 0), *((k, 2, 0) for k in (25, 34, 43, 52))]
    assert now.units.count() == 58 * 2 + 3


def test_files_that_changed_are_read_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for k in (1, 2):
        store.publish({"x": spark.range(k * 10).coalesce(1)})
    assert store.latest()[0] == 2
    part = next((tmp_path / "s" / "generations" / f"{2:010d}" / "x").glob("*.parquet"))
    spark.range(20, 40).coalesce(1).write.parquet(str(tmp_path / "other"))
    part.unlink()
    next((tmp_path / "other").glob("*.parquet")).rename(part.with_name("part-9.parquet"))
    assert store.latest()[0] == 1


# F4-F9, F12: lines leave the JVM once, for the one worker that folds them and makes their windows or blocks
@pytest.mark.parametrize("name", ["gram_df", "gram_df_five", "gram_budget", "gram_candidates", "capacity_report", "gram_rare_hits", "source_drift"])
def test_lines_are_folded_where_they_are_used(spark, monkeypatch, name):
    monkeypatch.setattr(t, "normalised", lambda *a: pytest.fail("a worker of its own was asked to fold"))
    suite.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_raw_lines_give_the_grams_and_blocks_of_normalised_ones(spark):
    texts = ["Straße\nSTRASSE\r\nab", "éÉ İͅᾷ", "", None, "Kſﬃ plain", "Weiß " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    raw, normal = t.units(docs), t.normalised_units(docs)
    for width in (1, 3, 5):
        assert sorted(map(tuple, grams.grams(raw, width).collect())) == sorted(map(tuple, grams.grams(normal, width).collect()))
    assert grams.packed(raw, 64).columns == grams.packed(normal, 64).columns
    assert sorted(map(repr, grams.packed(raw, 64).collect())) == sorted(map(repr, grams.packed(normal, 64).collect()))


# windows of a piece are in order already; only those of the block that two pieces share are sorted again
def test_pieces_are_not_sorted_again(monkeypatch):
    monkeypatch.setattr(grams, "PIECE", 1 << 12)
    r, again, different, windows, inside = random.Random(5), [], grams._different, grams._windows, []

    def marked(*a):
        found = windows(*a)
        while True:
            inside.append(1)
            value = next(found, None)
            inside.pop()
            if value is None:
                return
            yield value

    monkeypatch.setattr(grams, "_windows", marked)
    monkeypatch.setattr(grams, "_different", lambda v: (None if inside else again.append(len(v))) or different(v))
    blocks, texts = [k // 4 for k in range(400)], ["".join(r.choice("abcdefghij") for _ in range(60)) for _ in range(400)]
    got = [(b[int(k)].as_py(), int(x)) for b, which, value in grams._by_block([_batch(blocks, texts)], (5,)) for k, x in zip(which, value, strict=True)]
    assert sorted(got) == sorted(_plain(blocks, texts, 5))
    assert sum(again) < 0.2 * len(got)


# F6, F8: a task hands on the count of a frequent gram once, however many blocks have it
def test_a_task_hands_on_each_count_once(wide, monkeypatch):
    monkeypatch.setattr(grams, "HELD", 200)
    monkeypatch.setattr(batches, "BATCH_ROWS", 20)
    docs = wide.createDataFrame([(k, f"the same words, {k % 7}") for k in range(300)], "doc_id long, text string").coalesce(1)
    made = grams._counts(t.units(docs), (3,), "file_id").where("gram IS NOT NULL").persist()
    got = {x.gram: x.n for x in made.groupBy("gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    want = {x.gram: x.df for x in grams.document_frequency(grams.grams(t.units(docs)), 10**9).collect()}
    assert got == want
    assert made.where(f"gram = {grams.code(b'the')}").count() == 1
