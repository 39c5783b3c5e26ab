"""Units, normalisation and the pattern dialect."""

import random
import time
import unicodedata

import pytest

from seekloom.functions import pattern as p
from seekloom.functions import text as t

MIXED = "Größe \u00e9 / e\u0301 ΩΩς maß Ｋ K ﬁn"


def starts(query, text, kind="literal", case_sensitive=False):
    normal, origins = t.normalise(text, case_sensitive)
    if kind == "literal":
        return t.starts_of(text, normal, origins, t.literal_places(normal, t.normalise_query(query, case_sensitive)))
    made = {"regex": p.compile_regex, "wildcard": p.compile_wildcard}[kind](query, case_sensitive)
    return t.starts_of(text, normal, origins, made.starts(normal))


@pytest.mark.parametrize(("text", "lines"), [("", [""]), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\r\nb\r\r\n", ["a", "b\r"]), ("a\nb", ["a", "b"])])
def test_lines(spark, text, lines):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.raw for r in t.units(df).orderBy("line_number").collect()] == lines


def test_unit_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "ä\r\nb")], "doc_id long, text string")
    assert [tuple(r) for r in t.unit_offsets(df).orderBy("line_number").collect()] == [(2, 1, 0, 2), (2, 2, 4, 5)]
    assert t.units(df).where("file_id = 1").count() == 0


def test_normalised_forms_are_those_of_the_standard():
    r = random.Random(3)
    for _ in range(5000):
        x = "".join(r.choice("aeH̱̣́ßÅ각가ςΣJ̌İıﬀͅαA Ａ日ẞ") for _ in range(r.randint(0, 8)))
        nfc = unicodedata.normalize("NFC", x)
        assert t.normalise(x, True)[0] == nfc
        text, origins = t.normalise(x)
        assert text == unicodedata.normalize("NFC", nfc.casefold())
        assert origins is None or len(origins) == len(text)


def test_literals():
    assert starts("GRÖSSE", MIXED) == [0] and starts("fin", MIXED) == [35]
    assert starts("s", MIXED) == [4, 26]
    assert starts("e\u0301", MIXED, case_sensitive=True) == starts("\u00c9", MIXED) == [8, 13]
    assert starts("ω", MIXED) == [17, 19] and starts("σ", MIXED) == [21]
    assert starts("k", MIXED) == [33] and starts("ｋ", MIXED) == [29]
    assert starts("xx", "xxxx") == [0, 1, 2]
    assert starts("H", "H\u0331", case_sensitive=True) == [0]


@pytest.mark.parametrize(
    ("query", "text", "kind", "case_sensitive", "want"),
    [
        ("Open(Door|Window)s", "--OpenWindows--", "regex", True, [2]),
        ("code-[a-f]{3}", "code-abc code-xyz", "regex", True, [0]),
        ("^ink$", "ink", "regex", True, [0]),
        ("k.*t", "knit", "regex", True, [0]),
        (r"o\u{308}", "\u00f6", "regex", True, [0]),
        ("$", "e\u0301", "regex", True, [3]),
        ("page?.PDF", "--PAGE7.pdf--", "wildcard", False, [2]),
        (r"two\*three", "two*three", "wildcard", True, [0]),
        ("GR*E", "Größe", "wildcard", False, [0]),
        ("*nk", "ink", "wildcard", True, [0, 1]),
        ("i**k", "ink", "wildcard", True, [0]),
        (r"[^\w\s]+", "a !? b", "regex", True, [2, 3]),
        (r"\d", "1Ⅷ½x", "regex", True, [0, 1, 4]),
    ],
)
def test_patterns(query, text, kind, case_sensitive, want):
    assert starts(query, text, kind, case_sensitive) == want


@pytest.mark.parametrize("bad", [r"(a)\1", "(?=a)", r"\bword\b", "a+?", "a*+", "[ß]", "", "a**", "{2}", "a{2", "(a", "a)", "[a", "[z-a]", r"[a-\d]", r"\u{110000}", r"\q", "a{3,2}", "a{5000}", "(" * 70 + ")" * 70, "(a{4096}){5}", "a" * 9000])
def test_refused(bad):
    with pytest.raises(p.PatternError):
        p.compile_regex(bad)


@pytest.mark.parametrize("bad", ["", "dangling\\"])
def test_refused_wildcards(bad):
    with pytest.raises(p.PatternError):
        p.compile_wildcard(bad)


def test_mandatory_literals():
    get = lambda x: p.compile_regex(x, True).mandatory
    assert (get("code-[a-f]{3}"), get("Open(Door|Window)s"), get("[A-Z]{8}"), get("(ab|ab)+x?"), get("a?")) == ("code-", "Open", None, "ab", None)


def test_the_automaton_agrees_with_the_matcher():
    r = random.Random(9)
    atoms = ["a", "b", ".", "[ab]", "[^a]", "(ab|b)", "a{1,3}", "b*", "(a|bc)?", "^", "$", "c+"]
    for _ in range(400):
        made = p.compile_regex("".join(r.choice(atoms) for _ in range(r.randint(1, 4))), True)
        made.linear = False
        other = p._Automaton(made.tree)
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        assert other.starts(text) == made.starts(text)


def test_hard_patterns_take_linear_time():
    made = p.compile_regex("(a*)*b", True)
    assert made.linear and made.starts("a" * 3000) == []
    for query, compile_ in (("a.*a.*a.*[xy]", p.compile_regex), ("*a*a*a*x", p.compile_wildcard), ("[a-c]*[b-d]*[a-d]+z", p.compile_regex)):
        made, begin = compile_(query, True), time.perf_counter()
        assert made.linear and made.starts("a" * 100_000) == [] and time.perf_counter() - begin < 5
        assert made.starts("a" * 50 + "xaz")


def test_classes_of_characters_are_looked_up_in_one_table():
    assert not p.compile_regex(r"\d+").in_jvm and not p.compile_regex(r"a[\w-]").in_jvm and p.compile_regex("[a-z]+x").in_jvm


def test_presentation(spark):
    df = spark.createDataFrame([(0, 0, "x" * 300, 150), (1536, 1_700_000_000_123_456_789, "äb", 2), (5 << 30, 5, "short", 0)], "size long, ns long, text string, at int")
    got = [tuple(r) for r in df.select(t.file_size(df["size"]), t.modified_utc("ns"), t.preview(df["text"], df["at"]), t.location(df["at"], df["at"])).collect()]
    assert got[0] == ("0 B", "—", "…" + "x" * 180 + "…", "Line 150 · byte 150")
    assert got[1][:3] == ("1.5 KiB", "2023-11-14 22:13:20Z", "äb") and got[2][0] == "5.0 GiB"
