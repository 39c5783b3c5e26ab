"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Emails, addresses, card and phone numbers are found by pattern; their values are the
protected entities. For a word near an entity, document frequencies over the whole
corpus estimate how much it tells of the entity: the pointwise mutual information
``ln(N n(t,e) / (n(t) n(e)))``, where ``n(t,e)`` counts documents in which the word stands
within ``WINDOW`` words of the entity. A word discloses the entity if that is at least
``DISCLOSURE`` of the entity's own information ``ln(N / n(e))``. The share ``n(t,e) / n(t)`` in it is
shrunk towards chance, ``n(e) / N``, by ``PRIOR`` documents, so few documents weigh less than
many and yet decide, for an entity of one document too. Such words are found in all
documents and generalised to whether they are long; the entities are replaced by their kind.

Positions come from cutting a text at its matches: the gaps and matches alternate, so
their lengths add up to code-point offsets, without a Python function.

Defined cases: a null text counts as empty and has no spans (and stays null when
sanitised); repeated rows each give a row and each count as a document; documents
without entities add to the frequencies only; an entity in every document carries no
information and is not protected by terms; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Folder, free_name, let, running, sized, table

# Each pattern finds what the plain one beside it finds. A run that has failed once isn't tried
# again from its middle, and nothing is given back, so long runs take linear time.
#: kind -> (pattern, cheap test that must hold)
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Stands around matches while a text is cut; texts may have it too.
MARK = "\x01"
WORD = r"[\p{L}\p{M}]{3,}"
WINDOW = 8
#: Code points on a side that are looked at first, and next; then all of them are.
CONTEXT = (160, 2560)
DISCLOSURE, PRIOR = 0.9, 0.5


def matches(text: Column, pattern: Column) -> Column:
    """Non-overlapping matches, leftmost first: an array of ``(start, end, value)`` in code points."""
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def laid(pieces: Column) -> Column:
        """Of gaps and matches in turn."""
        placed = F.arrays_zip(pieces.alias("value"), running(F.transform(pieces, F.length)).alias("end"))
        found = F.filter(placed, lambda x, i: (i % 2 == 1) & (F.length(x["value"]) > 0))
        return F.transform(found, lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    quick = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    # a text that has the mark itself is cut and searched apart
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    slow = F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), F.concat(found, F.array(F.lit(""))).alias("value")), lambda x: F.array(x["gap"], x["value"])))
    # one search that ends at the first match is all that a text without one costs
    return F.when(F.rlike(text, pattern), let(F.when(F.contains(text, F.lit(MARK)), slow).otherwise(quick), laid)).otherwise(nothing)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right is doubled."""
    back = F.reverse(digits)
    sums = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(2 * d // 10 + 2 * d % 10) for d in range(10)]), F.substring(back, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return sums % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # by length first, so that a part is no larger than an int
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        size = F.length(_digits(value))
        return F.when((size >= 14) & (size <= 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        size = F.length(_digits(value))
        return (size >= 10) & (size <= 15)
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that any text with a match of the kind passes."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))


def base_spans(text: Column) -> Column:
    """All pattern spans by start, then kind: ``(start, rank, end, value)``."""
    text = F.coalesce(text, F.lit(""))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(F.when(_possible(kind, text), _ranked(F.filter(matches(text, F.lit(PATTERNS[kind])), lambda m: _valid_match(kind, m)), rank)).otherwise(nothing))
    return F.array_sort(F.concat(*parts))


def _valid_match(kind: str, m: Column) -> Column:
    return _valid(kind, m["value"])


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _plain(side: Column) -> Column:
    """The words of a text beside a span, without other entities' parts."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(side, r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+", " ")), F.lit(WORD), F.lit(0))


def _near(text: Column, span: Column) -> Column:
    """The last ``WINDOW`` words before and the first after a span.

    They are looked for in so many code points beside it, then in more, then in all: a cut text
    counts if enough words are in it without the run that the cut may have split.
    """
    start, end = span["start"], span["end"]
    left, right = _plain(F.substring(text, F.lit(1), start)), _plain(F.substring(text, end + 1, F.length(text)))
    for size in reversed(CONTEXT):
        before = F.regexp_replace(F.substring(text, start - size + 1, F.lit(size)), r"^\S++", "")
        after = F.regexp_replace(F.substring(text, end + 1, F.lit(size)), r"(?<!\S)\S++$", "")
        left = F.when((start > size) & (F.size(_plain(before)) >= WINDOW), _plain(before)).otherwise(left)
        right = F.when((F.length(text) - end > size) & (F.size(_plain(after)) >= WINDOW), _plain(after)).otherwise(right)
    return F.array_distinct(F.concat(F.slice(F.reverse(left), 1, WINDOW), F.slice(right, 1, WINDOW)))


def disclosing(found: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """Words that disclose an entity: ``term``, each once.

    ``found`` has ``doc, text, base``; ``docs`` has the ``text`` of all documents.
    """
    def mention(s: Column) -> Column:
        value = F.when(s["rank"] == 0, F.lower(s["value"])).when(s["rank"] == 1, s["value"]).otherwise(_digits(s["value"]))
        return F.struct(F.xxhash64(F.concat_ws(":", s["rank"].cast("string"), value)).alias("entity"), _near(F.col("text"), s).alias("terms"))

    # the text itself doesn't ride on the rows of its spans
    mentions = found.where(F.size("base") > 0).select("doc", F.explode(F.transform("base", mention)).alias("m")).select("doc", "m.*")
    # the entity itself is counted by the empty term, so one pass gives n(e) and n(t, e)
    pairs = mentions.select("doc", "entity", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    pairs = Folder(docs.sparkSession, "privacy").cut(pairs)
    n_e = pairs.where("term = ''").select("entity", F.col("n_te").alias("n_e"))
    near = pairs.where("term <> ''").join(n_e, "entity")
    wanted = sized(near.select("term").distinct())
    # counted before the join: a common word's documents are summed in each task, not joined one by one
    everywhere = docs.select(F.explode(_vocabulary(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")
    total = docs.count()
    chance = F.col("n_e") / F.lit(float(total))
    share = (F.col("n_te") + F.lit(prior) * chance) / (F.col("n_t") + F.lit(prior))
    ratio = F.log(share / chance) / -F.log(chance)
    return near.join(sized(everywhere), "term").where((F.col("n_e") < total) & (ratio >= disclosure)).select("term").distinct()


def _vocabulary(text: Column) -> Column:
    """The different words of a text. Digits, marks and separators part words as in :data:`WORD`."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")
    return F.filter(F.array_distinct(F.split(flat, " ")), lambda w: F.length(w) >= 3)


def find(docs: DataFrame, disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of ``(start, rank, end, value)`` in order.

    ``rank`` counts :data:`KINDS`, and one past them is a disclosing term. The two columns come
    last; if ``docs`` has their names, they get underscores in front.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, spans, doc, words = (free_name(docs, name) for name in ("base", "spans", "hit_doc", "hit_terms"))
    found = docs.withColumn(base, base_spans(text))
    keyed = found.select(F.xxhash64("doc_id", "text").alias("doc"), text.alias("text"), F.col(base).alias("base"))
    terms = disclosing(keyed.where(F.size("base") > 0), docs, disclosure, prior)
    # documents with such words, few or none of most, and for each the words it has
    hits = docs.select(F.xxhash64("doc_id", "text").alias(doc), F.explode(_vocabulary(F.col("text"))).alias("term")).join(sized(terms), "term")
    hits = sized(hits.groupBy(doc).agg(F.array_sort(F.collect_set("term")).alias(words)))
    joined = found.join(hits, F.xxhash64("doc_id", "text") == F.col(doc), "left")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    lowered = F.lower(text)
    # where lower-casing changes the length, offsets are those of a case-insensitive search instead
    same = F.length(lowered) == F.length(text)
    spotted = F.when(same, matches(lowered, pattern)).otherwise(matches(text, F.concat(F.lit("(?iu)"), pattern)))
    extra = F.when(F.col(words).isNotNull(), _ranked(spotted, len(KINDS))).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>"))
    # words inside an entity are covered by its span already
    free = F.filter(extra, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select(*[f"`{c}`" for c in docs.columns], base, F.array_sort(F.concat(base, free)).alias(spans))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced: entities by their kind, terms by their shape."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    shape = lambda s: F.when(F.length(s["value"]) > 6, F.lit("[LONG WORD]")).otherwise(F.lit("[WORD]"))
    done = F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["out"],
                    F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                    F.when(s["rank"] < len(KINDS), F.get(names, s["rank"])).otherwise(shape(s)),
                ),
            )
            .otherwise(acc["out"])  # overlaps the span before it, whose replacement stands for both
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised, and ``n_chars`` to match if there is one."""
    spans, clean = free_name(docs, "spans"), free_name(docs, "clean_text")
    made = find(docs).withColumn(clean, sanitised(F.col("text"), F.col(spans)))
    out = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size(spans) > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return made.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return made.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op5_privacy": op5_privacy}
SQL: dict[str, str] = {}
