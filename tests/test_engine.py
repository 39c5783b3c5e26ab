"""Search, metadata, grams, overlays, journals, sessions, generations, sources."""

import io
import random
import struct
import zipfile

import pytest

from seekloom.functions import text as t
from seekloom.operators import grams, journal, metadata, overlay, search
from seekloom.plans.session import Request, Session
from seekloom.plans.store import CapacityExceeded, NoGeneration, Store
from seekloom.sources import files
from seekloom.streaming.journal import normalise_stream, watch


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def naive(texts, query, case_sensitive=False):
    out = []
    needle = t.normalise_query(query, case_sensitive)
    for k, text in enumerate(texts):
        parts = text.split("\n")
        parts = parts[:-1] if len(parts) > 1 and not parts[-1] else parts
        for n, line in enumerate(parts, 1):
            line = line.removesuffix("\r")
            normal, origins = t.normalise(line, case_sensitive)
            out += [(k, n, o) for o in t.starts_of(line, normal, origins, t.literal_places(normal, needle))] if needle else []
    return sorted(out)


TEXTS = ["CreateFileW alpha beta\nABC\nDEF\n日本語テキスト\naaaaa\n", "createfilew alphabet soup\r\nrare-sentinel-123\n", "xxStraße yy é zz é Σςσ Ａ A\nSTRASSE ß", "", "H̱ J̌ ﬀ"]


@pytest.mark.parametrize("case_sensitive", [True, False])
@pytest.mark.parametrize("query", ["a", "ab", "abc", "File", "rare-sentinel-123", "日本語テキスト", "never", "aaa", "s", "ß", "é", "σ", "H", "ff", "CDE", ""])
def test_literal_hits_are_the_naive_ones(spark, query, case_sensitive):
    units = t.normalised_units(docs(spark, TEXTS), case_sensitive)
    got = sorted(tuple(r) for r in search.literal_hits(units, query, case_sensitive).collect())
    assert got == naive(TEXTS, query, case_sensitive)
    pruned = grams.pruned(units, grams.grams(units), query, case_sensitive)
    assert sorted(tuple(r) for r in search.literal_hits(pruned, query, case_sensitive).collect()) == got


def test_limits(spark):
    found = spark.createDataFrame([(f, n, b) for f in range(4) for n in (1, 2) for b in range(5)], "file_id int, line_number int, byte_offset int")
    rows = lambda limits: [tuple(r) for r in search.snippets(found, limits).orderBy(*search.ORDER).collect()]
    assert rows(search.Limits(2, 500, 3)) == [(0, 1, 0), (0, 1, 1), (0, 1, 2), (1, 1, 0)]
    assert rows(search.Limits(9, 2, 3)) == [(0, 1, 0), (0, 1, 1)]
    assert tuple(search.metrics(found, search.Limits(2, 500, 3)).head()) == (11, 2, 4)
    assert tuple(search.metrics(found.limit(0)).head()) == (0, 0, 0)


RECORDS = [(3, "/Music/Größe 7/Lied.OGG"), (5, "/Music/Été/note.ogg"), (8, "/写真/旅行.png"), (11, "/Attic/music/lied.txt"), (14, "/Music/Größe 7/cover.png")]


@pytest.mark.parametrize(
    ("name", "path", "case_sensitive", "want"),
    [("LIED", None, False, [3, 11]), ("Lied", None, True, [3]), (None, "GRÖSSE", False, [3, 14]), (None, "Größe", True, [3, 14]), (None, "grösse", True, []), ("旅行", None, False, [8]), (None, "music\\größe 7", False, [3, 14]), ("lied", "attic", False, [11]), ("png", "/", False, [8, 14]), (None, None, False, []), ("", "", False, [])],
)
def test_metadata(spark, name, path, case_sensitive, want):
    records = spark.createDataFrame(RECORDS, "file_id long, path string")
    assert [r.file_id for r in metadata.search(records, name, path, case_sensitive).collect()] == want


def test_path_order(spark):
    records = spark.createDataFrame([(1, "a.txt"), (2, "a/b"), (3, "a/a/c")], "file_id long, path string")
    assert {r.file_id: r.path_rank for r in metadata.numbered(records).collect()} == {3: 0, 2: 1, 1: 2}


BASE = "file_id long, path string, size long, modified_ns long"


def base(spark):
    return spark.createDataFrame([(1, "ink.md", 40, 5), (2, "pens/nib.md", 41, 5), (3, "pens/cap.md", 42, 5)], BASE)


EVENTS = "seq int, file_id long, action string, path string, content_changed boolean"


def _state(spark, events):
    """What a log leaves, one event after the other."""
    known = {r.file_id: r.path for r in base(spark).collect()}
    ups, dead = {}, set()
    for _, x, action, path, changed in sorted(set(events)):
        if action == "delete":
            ups.pop(x, None)
            dead.add(x)
            continue
        for other in [y for y, (p, _) in ups.items() if p == path and y != x] + [y for y, p in known.items() if p == path and y != x and y not in ups and y not in dead]:
            ups.pop(other, None)
            dead.add(other)
        dead.discard(x)
        ups[x] = (path, changed or (x in ups and ups[x][1]))
    return ups, dead & set(known)


def test_overlay(spark):
    events = [(1, 7, "upsert", "new.md", True), (2, 2, "upsert", "box/nib.md", False), (3, 3, "delete", None, None), (4, 9, "upsert", "ink.md", True), (5, 11, "upsert", "x", True), (6, 11, "delete", None, None)]
    log = spark.createDataFrame(events, EVENTS)
    ups, gone = overlay.resolved(log, base(spark))
    now = overlay.current(base(spark).select("file_id", "path"), ups, gone)
    assert {r.file_id: r.path for r in now.collect()} == {7: "new.md", 2: "box/nib.md", 9: "ink.md"}
    again, gone_again = overlay.resolved(log.unionByName(log), base(spark))
    assert again.distinct().count() == ups.count() and sorted(r.file_id for r in gone_again.collect()) == [1, 3]


def test_what_lost_its_path_stays_gone(spark):
    events = [(1, 4, "upsert", "ink.md", True), (2, 4, "delete", None, None), (3, 5, "upsert", "p", True), (4, 6, "upsert", "p", False), (5, 6, "delete", None, None)]
    ups, gone = overlay.resolved(spark.createDataFrame(events, EVENTS), base(spark))
    assert ups.collect() == [] and [r.file_id for r in gone.collect()] == [1]
    r = random.Random(4)
    for _ in range(6):
        events = [(k, r.randint(1, 6), *r.choice([("upsert", r.choice(["ink.md", "p", "q", "pens/cap.md"]), r.random() < 0.3), ("upsert", "p", False), ("delete", None, None)])) for k in range(r.randint(1, 25))]
        ups, gone = overlay.resolved(spark.createDataFrame(events, EVENTS), base(spark))
        got = {x.file_id: (x.path, x.content_changed) for x in ups.collect()}, {x.file_id for x in gone.collect()}
        assert got == _state(spark, events), events


def test_reconcile(spark):
    seen = spark.createDataFrame([(1, "old-ink.md", 40, 5), (2, "pens/nib.md", 99, 9), (77, "new.md", 1, 1)], BASE)
    got = {r.file_id: (r.action, r.content_changed) for r in overlay.reconcile(base(spark), seen).collect()}
    assert got == {1: ("rename", False), 2: ("modify", True), 3: ("delete", False), 77: ("create", True)}
    counts = spark.createDataFrame([(19, 1000), (20, 1000), (50000, 10**9), (0, 0), (1, 0)], "c long, n long")
    assert [r[0] for r in counts.select(overlay.should_compact(counts.c, counts.n)).collect()] == [False, True, True, False, True]


JOURNAL = [(99, 5, 20, journal.RENAME_OLD, 0, "old.txt"), (99, 5, 21, journal.RENAME_NEW | journal.CLOSE, 0, "new.txt"), (7, 5, 22, journal.RENAME_NEW, 0, "lost"), (8, 5, 23, journal.HARD_LINK | journal.FILE_CREATE, 0x10, "both"), (8, 5, 24, journal.FILE_DELETE, 0, "both"), (9, 5, 25, journal.CLOSE, 0, "none")]
WANT = [(20 + 1, 99, "rename", "old.txt", "new.txt"), (22, 7, "reconcile", None, None), (23, 8, "create", None, "both"), (23, 8, "reconcile", None, None), (24, 8, "delete", None, "both")]


def _binary(rows):
    out = b""
    for ref, parent, usn, reason, attributes, name in rows:
        data = name.encode("utf-16-le")
        out += struct.pack("<IHHQQqqIIIIHH", 60 + len(data), 2, 0, ref, parent, usn, 0, reason, 0, 0, attributes, len(data), 60) + data
    return out


def test_journal(spark):
    rows = journal.records(spark.createDataFrame([(_binary(JOURNAL),), (None,)], "buffer binary"))
    assert [tuple(r) for r in rows.collect()] == JOURNAL
    got = sorted(tuple(r)[:5] for r in journal.normalise(rows).collect())
    assert sorted(map(repr, got)) == sorted(map(repr, WANT))
    assert journal.checkpoint(rows, 31).head().next_usn == 20
    assert journal.checkpoint(rows.where("usn > 21"), 31).head().next_usn == 31
    with pytest.raises(ValueError, match="journal record"):
        list(journal.parse(_binary(JOURNAL)[:-3]))


def test_journal_stream(spark, tmp_path):
    schema = journal.SCHEMA
    for k, part in enumerate((JOURNAL[:1], JOURNAL[1:])):  # the old name waits in the state for the next batch
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = normalise_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None, k
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, WANT))


def test_watch(spark, tmp_path):
    spark.createDataFrame(JOURNAL, journal.SCHEMA).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(journal.SCHEMA).parquet(str(tmp_path / "in"))
    watch(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c"), once=True).awaitTermination(120)
    assert sum(seen) == len(JOURNAL)


def test_tree(spark):
    tree = spark.createDataFrame([(1, 1, "root"), (2, 1, "moved"), (3, 2, "file.txt"), (8, 9, "loop"), (9, 8, "loop")], "file_id long, parent long, name string")
    assert {r.file_id: r.path for r in journal.paths(spark, tree).collect()} == {1: "root", 2: "root/moved", 3: "root/moved/file.txt"}
    assert [tuple(r) for r in journal.descendants(spark, tree, 2).collect()] == [(3, 1)]


def test_session(spark):
    texts = ["ALPHA_ONLY_SENTINEL ERROR_1234 SharedContentToken\n" + "filler\n" * 50, "BRAVO_ONLY_SENTINEL ERROR_5678 SharedContentToken\n"]
    records = spark.createDataFrame([(0, "notes/alpha.txt"), (1, "notes/bravo.txt")], "file_id long, path string")
    session = Session(records, t.normalised_units(docs(spark, texts)).cache())
    ids = lambda **k: [r.file_id for r in session.search(Request(**k)).collect()]
    assert ids(file="alpha") == [0] and ids(file="notes\\bravo", full_path=True) == [1]
    assert ids(content="SharedContentToken", max_files=1) == [0] and ids(content="SharedContentToken", max_files=2) == [0, 1]
    row = session.search(Request(file="alpha", content="SharedContentToken")).head()
    assert row.matches[0].location == "Line 1 · byte 31"
    assert ids(content="ERROR_[0-9]{4}", kind="regex") == ids(content="*ONLY_SENTINEL*", kind="wildcard") == [0, 1]
    assert ids(file="ALPHA.TXT") == [0] and ids(file="ALPHA.TXT", case_sensitive=True) == [] and ids() == []
    late = {"file": "bravo", "content": "SharedContentToken", "max_files": 1}
    assert ids(**late) == [1] and ids(**late, filter_after_limits=True) == []


def test_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(NoGeneration):
        store.latest()
    one = {"metadata": base(spark)}
    assert [store.publish(one), store.publish(one, 1), store.publish(one, 2)] == [1, 2, 3]
    (tmp_path / "s/manifests/0000000003.json").write_text("{broken")
    (tmp_path / "s/manifests/.0000000003.json.crc").unlink(missing_ok=True)
    assert store.latest()[0] == 2
    with pytest.raises(CapacityExceeded):
        store.publish(one, gate=lambda sizes: 0.11)
    with pytest.raises(ValueError, match="same id"):
        store.publish({"metadata": base(spark).unionByName(base(spark))})
    assert store.publish(one, 2) == 4 and store.publish(one, 4) == 5
    assert store.collect_garbage() == [2, 1]
    assert store.generations() == [3, 4, 5] and store.latest()[1]["metadata"].count() == 3


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = _zip({"word/footer1.xml": "<w:ftr><w:p><w:t>Foot</w:t></w:p></w:ftr>", "word/document.xml": "<?xml version='1.0'?><w:document><w:p><w:r><w:t>DOCX </w:t><w:tab/><w:t>Alpha</w:t></w:r></w:p><w:p><w:t>DOCX Beta &amp; Café</w:t></w:p><w:p/></w:document>"})
XLSX = _zip({"xl/sharedStrings.xml": "<sst><si><t>XLSX </t><t>Shared</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><c t="s"><v>0</v></c><c t="inlineStr"><is><t>XLSX Inline</t></is></c><c><f>SUM(A1:B1)</f><v>42</v></c><c t="b"><v>1</v></c><c t="s"><v>9</v></c></s>'})
PPTX = _zip({"ppt/slides/slide10.xml": "<a:p><a:t>ten</a:t></a:p>", "ppt/slides/slide2.xml": "<a:p><a:t>two</a:t></a:p>", "ppt/notesSlides/notesSlide1.xml": "<a:p><a:t>note</a:t></a:p>"})


def test_documents(spark):
    df = spark.createDataFrame([("a.docx", DOCX), ("b.XLSX", XLSX), ("c.pptx", PPTX), ("d.docx", b"no"), ("e.txt", b"x")], "path string, content binary")
    got = {}
    for r in files.extracted(df).orderBy("path", "line_number").collect():
        got.setdefault(r.path, []).append(r.raw)
    assert got == {"a.docx": ["DOCX Alpha", "DOCX Beta & Café", "Foot"], "b.XLSX": ["XLSX Shared", "XLSX Inline", "SUM(A1:B1) 42", "TRUE"], "c.pptx": ["note", "two", "ten"], "d.docx": [None]}
    assert files.paragraphs(files.decode_xml(b"\xff\xfe" + "<w:p><w:t>日本語</w:t></w:p>".encode("utf-16-le"))) == ["日本語"]
    with pytest.raises(ValueError, match="entity"):
        files.paragraphs("<w:p><w:t>&what;</w:t></w:p>")
    assert files.pdf_paragraphs("PDF Alpha\nsoft\n\nPDF Beta\fNext\n") == ["PDF Alpha soft", "PDF Beta", "Next"]


def test_directory(spark, tmp_path):
    for name, data in {"a.txt": b"one\n", "b/c d.MD": b"two", "b/x.bin": b"no", "target/t.txt": b"no", "README": b"three", "bad.txt": b"\xff\xfe\xff", "b/readme": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.text_files(spark, str(tmp_path))
    assert sorted((r.path, r.text) for r in found.collect()) == [("README", "three"), ("a.txt", "one\n"), ("b/c d.MD", "two")]
    assert {r.path: r.doc_id for r in files.numbered(found).collect()} == {"README": 0, "a.txt": 1, "b/c d.MD": 2}
    records = files.metadata_table(spark, str(tmp_path)).collect()
    assert {(r.path, r.kind) for r in records} >= {("b", "Directory"), ("b/x.bin", "File")} and len({r.file_id for r in records}) == len(records)


def test_deep_trees(spark):
    n = 700
    tree = spark.createDataFrame([(0, None, "r"), *[(k, k - 1, f"n{k}") for k in range(1, n)], (5000, 5001, "a"), (5001, 5000, "b"), (6000, 9999, "lost"), (7000, 7000, "own")], "file_id long, parent long, name string")
    got = {r.file_id: r.path for r in journal.paths(spark, tree).collect()}
    assert len(got) == n + 1 and got[7000] == "own" and got[3] == "r/n1/n2/n3" and got[n - 1].count("/") == n - 1
    below = {r.file_id: r.depth for r in journal.descendants(spark, tree, 100).collect()}
    assert below == {k: k - 100 for k in range(101, n)}


def test_an_index_prunes_and_loses_nothing(spark):
    from seekloom.functions import text as t
    from seekloom.operators import grams

    r = random.Random(8)
    words = ["ink", "pen", "nib", "Größe", "été", "paper", "日本"]
    docs = [(k, "\n".join(" ".join(r.choice(words) for _ in range(8)) for _ in range(20)) + ("\nrareword here" if k == 77 else "")) for k in range(200)]
    units = grams.packed(t.normalised_units(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)), 4096).persist()
    sizes = units.groupBy("block_id").agg({"folded": "count"}).count()
    assert sizes > 10
    index = grams.Index(**grams.Index.build(units, 10**7))
    assert len(index.blocks("RareWord")) == 1 and index.blocks("qqq") == [] and index.blocks("ra") is None
    for query in ("rareword", "größe été", "pen", "ink 日本 pen", "absent"):
        want = sorted(tuple(x) for x in search.literal_hits(units, query).collect())
        assert sorted(tuple(x) for x in search.literal_hits(index.pruned(units, query), query).collect()) == want
    small = grams.Index.build(units, 1000, {3: 0.4})
    assert small["postings"].count() * grams.POSTING_BYTES <= 400


def test_exact_percentiles(spark):
    from seekloom.operators.stats import percentiles

    r = random.Random(3)
    for n in (0, 1, 2, 999):
        values = sorted(r.choice([1.5, 2.0, r.random() * 100]) for _ in range(n))
        got = {x.name: x.value for x in percentiles(spark.createDataFrame([(v,) for v in [*values, None]], "value double"), {"a": 50, "b": 95, "c": 100}).collect()}
        assert got == ({k: values[-(-(n - 1) * q // 100)] for k, q in (("a", 50), ("b", 95), ("c", 100))} if n else {})


def test_a_catalogs_life(spark, tmp_path):
    from seekloom.plans.catalog import Catalog

    r = random.Random(6)
    words = ["ink", "pen", "nib", "paper", "quill"]
    files = {k: "\n".join(" ".join(r.choice(words) for _ in range(6)) for _ in range(4)) for k in range(100)}
    records = {k: (k, f"f/{k}.md", len(t), 5) for k, t in files.items()}
    kinds = "file_id long, path string, size long, modified_ns long"
    frame = lambda rows: spark.createDataFrame(list(rows), kinds)
    texts = lambda d: spark.createDataFrame(list(d.items()), "file_id long, text string")
    want = lambda d, needle: sorted((k, n, o) for k, t in d.items() for n, line in enumerate(t.split("\n"), 1) for o in range(len(line)) if line.startswith(needle, o))
    catalog = Catalog(spark, str(tmp_path / "c"), 512)
    assert catalog.initialise(frame(records.values()), texts(files), 3) == 1
    now = catalog.load()
    assert now.status() == {"generation": 1, "base": 1, "records": 100, "changes": 0, "kind": "base", "position": 3}
    assert sorted(map(tuple, now.hits("quill pen").collect())) == want(files, "quill pen")
    assert catalog.reconcile(frame(records.values()), texts(files)) is None
    files[7] += "\nanother quill pen"
    records[7] = (7, "f/7.md", len(files[7]), 6)
    assert [x.file_id for x in catalog.drifted(frame(records.values())).collect()] == [7]
    assert catalog.reconcile(frame(records.values()), texts(files), 8) == 2
    now = catalog.load()
    assert (now.number, now.base_number) == (2, 1) and now.status()["position"] == 8 and now.overlay["delta"].count() == 5
    assert sorted(map(tuple, now.hits("quill pen").collect())) == want(files, "quill pen")
    assert {x.file_id for x in now.search(Request(file="f/7", full_path=True, content="another")).collect()} == {7}
    assert [x.file_id for x in now.owner("f/7.md").collect()] == [7] and now.record(7).head().size == len(files[7])
    few = now.limited_hits("pen", limits=search.Limits(3, 500, 1)).collect()
    assert len({x.file_id for x in few}) == 3
    del files[0], records[0]
    records[1] = (1, "moved/1.md", records[1][2], 5)
    catalog.reconcile(frame(records.values()), texts(files), 9)  # three changes of a hundred: compacted
    now = catalog.load()
    assert now.overlay is None and now.status()["records"] == 99 and now.number == 4
    assert sorted(map(tuple, now.hits("quill pen").collect())) == want(files, "quill pen")
    assert sorted(x.path for x in now.records.collect()) == sorted(v[1] for v in records.values())
    assert catalog.store.collect_garbage() == [2] and catalog.store.generations() == [1, 3, 4]


def test_changed_contents_are_noticed(spark, tmp_path):
    from seekloom.plans.store import Store

    made = Store(spark, str(tmp_path / "s"))
    for k in (1, 2):
        made.publish({"t": spark.createDataFrame([(k, "x")], "id long, v string").coalesce(1)})
    assert made.latest()[0] == 2
    spark.createDataFrame([(2, "y")], "id long, v string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "s/generations/0000000002/t"))
    assert made.load(2, contents=False) and made.latest()[0] == 1
    with pytest.raises(ValueError, match="contents"):
        made.load(2)
