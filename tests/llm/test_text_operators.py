"""Decontamination, privacy, tokens, language and toxicity."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seekloom import llm
from seekloom.llm import bpe, decontaminate, language, privacy, toxicity

from .common import SF, edge_docs, empty_docs


def rows(df):
    return sorted(map(repr, df.collect()))


def test_every_query_has_its_operator_number():
    names = llm.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(llm.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = llm.queries()[name](spark, SF)
    want = con.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


# --- decontamination -------------------------------------------------------


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, size=13):
    out = {}
    for k, (doc, text) in enumerate(docs):
        w, hit, ids = _words(text), set(), set()
        for item, body in items:
            b = _words(body)
            n = min(size, len(b))
            for i in range(len(b) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[i : i + n]:
                        hit.update(range(at, at + n))
                        ids.add(str(item))
        out[k] = (doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return sorted(map(repr, out.values()))


def test_decontamination_is_brute_force(spark):
    r = random.Random(5)
    word = lambda: r.choice(["a", "B", "c", "é", "É", "d1"])
    text = lambda n: r.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(1, text(3)), (2, text(15)), (3, None), (4, ""), (5, text(14)), (6, "b c"), (7, "b c"), (10, text(1) + " zz")]
    docs = [(k, text(r.randint(0, 60))) for k in range(40)] + [(40, items[1][1]), (41, None), (41, None), (None, items[4][1]), (42, "x " * 300 + "B, C")]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(repr(tuple(x)) for x in got.select(*columns).collect()) == _brute(docs, items)


def test_decontaminate_cuts_or_drops(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, passage, 9), (2, "x " * 400 + passage + ". And y", 9), (3, "clean", 5), (4, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(out) == {2, 3, 4}
    assert out[2].text == "x " * 400 + "And y" and out[2].n_chars == len(out[2].text)
    assert (out[3].text, out[3].n_chars, out[4].text) == ("clean", 5, None)


def test_decontaminate_edges(spark):
    benchmark = spark.createDataFrame([(1, None), (2, "unrelated words")], "item_id long, text string")
    docs = edge_docs(spark)
    assert rows(decontaminate.decontaminate(docs, benchmark)) == rows(docs)
    assert decontaminate.report(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.decontaminate(empty_docs(spark), benchmark).count() == 0


# --- privacy ---------------------------------------------------------------

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _ok(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) // 10 + 2 * int(c) % 10 for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def _spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if _ok(kind, m.group())]
    return ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    r = random.Random(8)
    bits = ["a", "@", ".", "-", "x.y@z.w", "1", "22", "255", "256", "+1", "(", ")", " ", "4111 1111 1111 1111", "10.0.0.1", "🙂", "é", "+1 (555) 555-0100", "_", "4111111111111111", "0000", "1.2.3.4.5.6.7.8", "\n", "99999999999999999999"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["9" * 30000, "a" * 30000 + "@", "a@b" + ".c" * 20000, "+1" + "(" * 20000, None, "1." * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.s for x in df.select("doc_id", privacy._listed(privacy.base_spans(df.text)).alias("s")).collect()}
    assert [k for k, t in enumerate(texts) if got[k] != _spans(t)] == []


def test_disclosing_terms_are_found_everywhere(spark):
    docs = [(k, f"common words here Zorblatt wrote from secret{'x'}@mail.example.com about common things") for k in range(5)]
    docs += [(k, "common words here and nothing else of note about things") for k in range(5, 200)] + [(200, "also ZORBLATT alone"), (201, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in privacy.find(df).collect()}
    names = {k: [s.value for s in r.spans if s.rank == 4] for k, r in out.items()}
    assert "zorblatt" in names[0] and names[200] == ["zorblatt"] and names[7] == [] and "common" not in names[0]
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert "@" not in clean[0] and "[EMAIL]" in clean[0] and clean[200] == "also [LONG WORD] alone" and clean[7] == docs[7][1] and clean[201] is None


def test_entities_of_one_and_two_documents_have_disclosing_terms(spark):
    docs = [(0, "Common words here, Qwertling wrote from once@mail.example.com about common things")]
    docs += [(k, "common words here Zorblatt wrote from twice@mail.example.com about common things") for k in (1, 2)]
    docs += [(k, "common words wrote from here about things") for k in range(3, 200)] + [(200, "also qwertling alone"), (201, "a common word, and things of Zorblatt")]
    out = {r.doc_id: [s.value.lower() for s in r.spans if s.rank == 4] for r in privacy.find(spark.createDataFrame(docs[:200], "doc_id long, text string")).collect()}
    assert out[0] == ["qwertling"] and out[1] == out[2] == ["zorblatt"] and not any(out[k] for k in range(3, 200))
    # another document with the word weakens it: one of two isn't enough here, two of three are not either
    out = {r.doc_id: [s.value.lower() for s in r.spans if s.rank == 4] for r in privacy.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not any(out.values())


def _near_words(text, start, end):
    plain = lambda side: re.findall(r"[^\W\d_]{3,}", re.sub(r"[^ \t\n\x0b\f\r]*[@0-9][^ \t\n\x0b\f\r]*", " ", side).lower())
    return set(plain(text[:start])[-privacy.WINDOW :] + plain(text[end:])[: privacy.WINDOW])


def test_the_words_near_an_entity_are_as_many_as_the_window(spark):
    r = random.Random(5)
    words = ["to", "one", "Two", "w" * 30, "v" * 170, "日本語" * 70, "長" * 3000, "a1b", "x@y.example.org", "foo,bar", "\n"]
    texts = [" ".join(r.choice(words[: r.choice([3, 4, 6, 11])]) for _ in range(r.randint(0, 60))) + r.choice([" ", ""]) + "me@mail.example.com" + r.choice(["", " ", ", "]) + " ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += ["語" * 400 + " me@mail.example.com " + "字" * 200, " ".join(f"{chr(97 + k) * 40}" for k in range(20)) + " me@mail.example.com"]
    df = spark.createDataFrame([(k, t, t.index("me@"), t.index("me@") + 19) for k, t in enumerate(texts)], "doc_id int, text string, start int, end int")
    got = {x.doc_id: set(x.n) for x in df.select("doc_id", privacy._near(F.col("text"), F.struct("start", "end")).alias("n")).collect()}
    assert [k for k, t in enumerate(texts) if got[k] != _near_words(t, t.index("me@"), t.index("me@") + 19)] == []


def test_privacy_edges(spark):
    docs = edge_docs(spark)
    out = privacy.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert privacy.sanitise(empty_docs(spark)).count() == 0
    text = {r.doc_id: r for r in out.collect() if r.doc_id}[6]
    assert text.text == "Ünïcode 日本語 🙂 mail me at [EMAIL] or [PHONE]" and text.n_chars == len(text.text)


# --- tokens ----------------------------------------------------------------


def _codec(leaf):
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        blob = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in blob.splitlines())}
    return bpe.Codec(blob, leaf), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_tree_encoding_is_one_pass(leaf):
    codec, plain = _codec(leaf)
    r = random.Random(leaf)
    bits = ["a", "b", " ", "  ", "'", "s", "re", "1", "23", "é", "\n", "\t", "!", "..", "日本", "́", "🙂", "'ve", "\x1c", " ", "　", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    assert codec.encode(None) == [] and codec.decode([]) == b""
    assert codec.encode("a" * 3000) == plain.encode_ordinary("a" * 3000)


def test_checked_ids(monkeypatch):
    """A decoder that loses a byte is found out."""
    right = bpe.Codec.decode
    with open(public_tokenizers.path(bpe.RANKS), "rb") as file:
        codec = bpe.Codec(file.read())
    assert bpe.ids_of(codec, ["some words", None, ""], checked=True)[1:] == [[], []]
    monkeypatch.setattr(bpe.Codec, "decode", lambda self, ids: right(self, ids)[:-1])
    assert len(bpe.ids_of(codec, ["some words"], checked=False)[0]) > 0
    with pytest.raises(ValueError, match="differs"):
        bpe.ids_of(codec, ["some words"], checked=True)


def test_encode_and_decode_frames(spark):
    docs = edge_docs(spark)
    made = bpe.encode(docs)
    assert made.columns[-1] == "_token_ids"
    back = bpe.decode(made, column="_token_ids").collect()
    assert len(back) == docs.count() and all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.encode(empty_docs(spark)).count() == 0
    assert bpe.encode(docs, checked=True).select("_token_ids").collect() == made.select("_token_ids").collect()
    digest = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert digest[3].n_tokens == 0 and digest[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


# --- language --------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    out = llm.queries()["op7_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = [(r.lang_pred, r.lang) for r in out.join(docs, "doc_id").where("held_out").collect()]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.97


def test_language_edges(spark):
    docs = edge_docs(spark)
    names, matrix = language.learn(docs.where("lang IS NOT NULL").select("lang", "text"))
    assert names == ["de", "en"]  # the French text has no letter
    out = [(r.doc_id, r.text, r.lang_pred, r["_score"]) for r in language.predict(docs, names, matrix).collect()]
    assert len(out) == docs.count() and all(0 <= s <= 1 for *_, s in out)
    assert all((p == "und") == (not t or not any(c.isalpha() for c in t)) for _, t, p, _ in out)
    none = language.learn(docs.limit(0).select("lang", "text"))
    assert {r.lang_pred for r in language.predict(docs, *none).collect()} == {"und"}
    assert language.predict(empty_docs(spark), names, matrix).count() == 0


def test_language_batches_do_not_matter():
    texts = ["abc déf", "", None, "Straße über", "x", "12 ..", "İstanbul"]
    joined, starts, _ = language._grams([(t or "").lower() for t in texts])
    for k, t in enumerate(texts):
        alone, _, _ = language._grams([(t or "").lower()])
        assert np.array_equal(joined[starts[k] : starts[k + 1]], alone)


# --- toxicity --------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = llm.queries()["op3_toxicity"](spark, sf)
    held = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit / sum(r.predicted for r in held) > 0.85 and hit / sum(r.toxic for r in held) > 0.85  # some 300 toxic rows to learn from, in four languages
    assert all(0 <= r.score <= 1 for r in held)


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (None, 1), (6, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, toxicity.held_out_rows())
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["_score"] <= 1 for r in out)
    one = toxicity.learn(docs, labels.where("toxic = 0"), toxicity.held_out_rows())
    assert all(r["_score"] < 0.01 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(empty_docs(spark), toxicity.learn(empty_docs(spark), labels.limit(0), toxicity.held_out_rows())).count() == 0


def test_toxicity_batches_do_not_matter():
    r = np.random.default_rng(0)
    texts = [r.integers(-(2**62), 2**62, n) for n in (0, 1, 2, 3, 50, 7)]
    y = np.array([0, 1, 0, 1, 0, 1])
    model = toxicity.train(texts * 10, np.tile(y, 10), ["en"] * 60, 0.5)
    alone = np.concatenate([toxicity.scores(model, [t]) for t in texts])
    assert np.allclose(alone, toxicity.scores(model, texts)) and np.allclose(toxicity.scores(model, [None]), alone[0])
