"""All queries of the engine over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .functions.pattern import compile_regex, compile_wildcard
from .operators import grams as g
from .operators import journal as j
from .operators import metadata as m
from .operators import overlay as o
from .operators import search as s
from .operators.stats import percentiles as percentiles_of
from .plans.catalog import Catalog, scratch
from .plans.session import Request, Session
from .sources.files import html_units

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return _table(spark, d, "documents")


def _units(spark, d, case_sensitive=False):
    return t.normalised_units(_docs(spark, d).select("doc_id", "text"), case_sensitive)


def _raw_units(spark, d):
    """Lines as they are, for operators that fold them in the worker that uses them."""
    return t.units(_docs(spark, d).select("doc_id", "text"))


# --- SQL building blocks ---------------------------------------------------

_U = """u AS (SELECT doc_id AS file_id, CAST(i AS INTEGER) AS line_number, regexp_replace(parts[i], '\\r$', '') AS raw FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN len(p) > 1 AND p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS parts FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))))"""
_FOLD = "nfc_normalize(replace(lower(nfc_normalize({0})), 'ß', 'ss'))"
_F = f"{_U}, f AS (SELECT *, {_FOLD.format('raw')} AS folded, replace(lower(nfc_normalize(raw)), 'ß', chr(57344) || chr(57345)) AS marked FROM u)"


def _hits_sql(needle: str) -> str:
    """Hits of a folded needle; a start on the second half of an expanded character is one on that character."""
    n = len(needle)
    return f"""{_F}, h AS (SELECT DISTINCT file_id, line_number,
  CAST(strlen(replace(substr(marked, 1, CASE WHEN substr(marked, i, 1) = chr(57345) THEN i - 2 ELSE i - 1 END), chr(57344) || chr(57345), 'ß')) AS INTEGER) AS byte_offset
  FROM (SELECT *, unnest(list_filter(range(1, greatest(length(folded) - {n - 2}, 1)), lambda k: substr(folded, k, {n}) = '{needle}')) AS i FROM f WHERE contains(folded, '{needle}')))"""


def _sensitive_sql(needle: str) -> str:
    n = len(needle)
    return f"""{_U}, h AS (SELECT file_id, line_number, CAST(strlen(substr(raw, 1, i - 1)) AS INTEGER) AS byte_offset
  FROM (SELECT *, unnest(list_filter(range(1, greatest(length(raw) - {n - 2}, 1)), lambda k: substr(raw, k, {n}) = '{needle}')) AS i FROM u WHERE contains(raw, '{needle}')))"""


def _starts_sql(pattern: str, where: str = "TRUE") -> str:
    """Starts of a pattern without anchors: what is left from each place on begins with a match."""
    return f"""{_F}, h AS (SELECT DISTINCT file_id, line_number,
  CAST(strlen(replace(substr(marked, 1, CASE WHEN substr(marked, i, 1) = chr(57345) THEN i - 2 ELSE i - 1 END), chr(57344) || chr(57345), 'ß')) AS INTEGER) AS byte_offset
  FROM (SELECT *, unnest(list_filter(range(1, length(folded) + 2), lambda k: regexp_matches(substr(folded, k), '^(?:{pattern})', 's'))) AS i FROM f WHERE {where}))"""


_H = "SELECT file_id, line_number, byte_offset FROM h"


def _batch_sql(files: int, matches: int, source: str = "h") -> str:
    return f"""n AS (SELECT *, row_number() OVER (ORDER BY file_id, line_number, byte_offset) AS match_number, dense_rank() OVER (ORDER BY file_id) AS file_number,
  row_number() OVER (PARTITION BY file_id ORDER BY line_number, byte_offset) AS snippet_number FROM {source}),
b AS (SELECT * FROM n WHERE match_number <= {matches} AND match_number <= coalesce((SELECT min(match_number) FROM n WHERE file_number >= {files}), {matches}))"""


# --- units and normalisation -----------------------------------------------


@query(f"WITH {_U} SELECT file_id, line_number, raw FROM u")
def unit_lines(spark, d):
    return t.units(_docs(spark, d))


@query(f"""WITH {_U} SELECT file_id, line_number, CAST(coalesce(sum(strlen(raw) + 1) OVER w, 0) AS BIGINT) AS "start",
CAST(coalesce(sum(strlen(raw) + 1) OVER w, 0) + strlen(raw) AS BIGINT) AS "end"
FROM u WINDOW w AS (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def unit_offsets(spark, d):
    return t.unit_offsets(_docs(spark, d))


@query("SELECT conv_id AS file_id, turn AS unit, strlen(text) AS bytes FROM conversations".replace("strlen(text)", "CAST(strlen(text) AS INTEGER)"))
def unit_turns(spark, d):
    """Turns of conversations are units too."""
    return _table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("unit"), F.octet_length("text").alias("bytes"))


@query(f"WITH {_U} SELECT file_id, line_number, {_FOLD.format('raw')} AS folded FROM u")
def normalize_fold(spark, d):
    return _units(spark, d).select("file_id", "line_number", "folded")


@query(f"WITH {_U} SELECT file_id, line_number, nfc_normalize(raw) AS folded FROM u")
def normalize_nfc(spark, d):
    return _units(spark, d, True).select("file_id", "line_number", "folded")


@query("""WITH RECURSIVE p AS (SELECT doc_id, i, CAST(strlen(parts[i]) + 1 AS BIGINT) AS bytes FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT doc_id, CASE WHEN len(q) > 1 AND q[len(q)] = '' THEN q[:len(q) - 1] ELSE q END AS parts FROM (SELECT doc_id, string_split(text, chr(10)) AS q FROM documents)))),
r AS (SELECT doc_id, i, bytes, 0 AS block, bytes AS filled FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.bytes, CASE WHEN filled + p.bytes > 4096 THEN block + 1 ELSE block END, CASE WHEN filled + p.bytes > 4096 THEN p.bytes ELSE filled + p.bytes END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id AS file_id, CAST(block AS INTEGER) AS block, count(*) AS units, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY ALL""")
def block_pack_stats(spark, d):
    """Units packed in order into blocks of at most 4 KiB; a larger unit is a block of its own."""
    made = _docs(spark, d).select(F.col("doc_id").alias("file_id"), F.posexplode(t.block_sizes(F.col("text"), 4096)).alias("block", "b"))
    return made.select("file_id", "block", "b.units", "b.bytes")


@query()
def html_page_units(spark, d):
    return html_units(_table(spark, d, "pages"))


# --- literals --------------------------------------------------------------


@query(f"WITH {_hits_sql('er')} {_H}")
def literal_hits_ci(spark, d):
    return s.literal_hits(_units(spark, d), "ER")


@query(f"WITH {_hits_sql('ss')} {_H}")
def literal_hits_expanded(spark, d):
    """A needle that starts inside folded characters: each source character counts once."""
    return s.literal_hits(_units(spark, d), "ß")


@query(f"WITH {_sensitive_sql('The')} {_H}")
def literal_hits_cs(spark, d):
    return s.literal_hits(_units(spark, d, True), "The", True)


@query(f"WITH {_sensitive_sql('haha')} {_H}")
def literal_overlap(spark, d):
    return s.literal_hits(_units(spark, d, True), "haha", True)


@query(f"WITH {_hits_sql('idiot')} SELECT file_id, count(*) AS matches FROM h GROUP BY file_id")
def literal_docs(spark, d):
    return s.hits_by_file(s.literal_hits(_units(spark, d), "Idiot"))


@query(f"WITH {_U} SELECT file_id, line_number, CAST(0 AS INTEGER) AS byte_offset FROM u WHERE FALSE")
def literal_empty(spark, d):
    return s.literal_hits(_units(spark, d), "")


# --- patterns --------------------------------------------------------------

_EMAIL = r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com"
_EMAIL_SQL = r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com"


@query(f"WITH {_F} SELECT file_id, line_number FROM f WHERE regexp_matches(folded, '{_EMAIL_SQL}')")
def regex_units(spark, d):
    return s.pattern_units(_units(spark, d), compile_regex(_EMAIL)).select("file_id", "line_number")


@query(f"WITH {_F} SELECT file_id, line_number FROM f WHERE regexp_matches(folded, '{_EMAIL_SQL}')")
def regex_mandatory_prefilter(spark, d):
    """The same by the mandatory literal first and the automaton after it."""
    pattern = compile_regex(_EMAIL)
    pattern.linear = True
    return s.pattern_units(_units(spark, d), pattern).select("file_id", "line_number")


@query(f"WITH {_starts_sql(_EMAIL_SQL, where=chr(39).join(['contains(folded, ', '@mail', ')']))} {_H}")
def regex_starts(spark, d):
    return s.regex_hits(_units(spark, d), _EMAIL)


@query(f"WITH {_F} SELECT file_id, line_number FROM f WHERE regexp_matches(folded, '^the .*(ing|tion)\\.$')")
def regex_anchored_units(spark, d):
    return s.pattern_units(_units(spark, d), compile_regex(r"^The .*(ing|tion)\.$")).select("file_id", "line_number")


@query(f"WITH {_F} SELECT file_id, line_number FROM f WHERE regexp_matches(folded, 'idiot.*sc.m', 's')")
def wildcard_units(spark, d):
    return s.pattern_units(_units(spark, d), compile_wildcard("Idiot*sc?m")).select("file_id", "line_number")


@query(f"WITH {_starts_sql('mail..example', where=chr(39).join(['contains(folded, ', '.example', ')']))} {_H}")
def wildcard_starts(spark, d):
    return s.wildcard_hits(_units(spark, d), "MAIL??example")


# --- limits ----------------------------------------------------------------

_LIMITS = s.Limits(20, 150, 3)


@query(f"WITH {_hits_sql('ing')}, {_batch_sql(20, 150)} SELECT file_id, line_number, byte_offset, CAST(match_number AS INTEGER) AS match_number, CAST(file_number AS INTEGER) AS file_number, CAST(snippet_number AS INTEGER) AS snippet_number FROM b")
def first_batch(spark, d):
    return s.first_batch(s.literal_hits(_units(spark, d), "ing"), _LIMITS)


@query(f"WITH {_hits_sql('ing')}, {_batch_sql(20, 150)} SELECT file_id, line_number, byte_offset FROM b WHERE snippet_number <= 3")
def first_batch_snippets(spark, d):
    return s.snippets(s.literal_hits(_units(spark, d), "ing"), _LIMITS)


@query(f"WITH {_hits_sql('ing')}, {_batch_sql(20, 150)} SELECT count(*) AS matches_seen, CAST(coalesce(max(file_number), 0) AS BIGINT) AS files_matched, CAST(coalesce(sum(CASE WHEN snippet_number <= 3 THEN 1 ELSE 0 END), 0) AS BIGINT) AS returned_snippets FROM b")
def search_metrics(spark, d):
    return s.metrics(s.literal_hits(_units(spark, d), "ing"), _LIMITS)


# --- metadata --------------------------------------------------------------

_M = """m AS (SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS name,
CAST(strlen(text) AS BIGINT) AS size, CAST(doc_id AS DECIMAL(38, 0)) AS modified_ns, 'File' AS kind, TRUE AS content_searchable FROM documents)"""
_MCOLS = "file_id, path, size, modified_ns, kind, content_searchable"


def _records(spark, d):
    return m.of_documents(_docs(spark, d))


@query(f"WITH {_M} SELECT {_MCOLS} FROM m WHERE contains(lower(name), 'doc_1') ORDER BY file_id LIMIT 100")
def metadata_filename(spark, d):
    return m.search(_records(spark, d), filename="DOC_1")


@query(f"WITH {_M} SELECT {_MCOLS} FROM m WHERE contains(lower(path), 'src1/de') ORDER BY file_id LIMIT 50")
def metadata_path(spark, d):
    return m.search(_records(spark, d), path="SRC1/de", limit=50)


@query(f"WITH {_M} SELECT {_MCOLS} FROM m WHERE contains(name, '7.txt') AND contains(path, '/fr/') ORDER BY file_id LIMIT 100")
def metadata_and(spark, d):
    return m.search(_records(spark, d), filename="7.txt", path="/fr/", case_sensitive=True)


@query("SELECT p_partkey AS file_id, p_name AS path FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey LIMIT 200")
def metadata_part_names(spark, d):
    parts = _table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("path"))
    return m.search(parts, filename="WIDGET", limit=200)


@query(f"WITH {_M} SELECT file_id, CASE WHEN file_id % 2 = 0 THEN replace(path, '/', chr(92)) ELSE path END AS path FROM m WHERE contains(lower(path), 'src2/es') ORDER BY file_id LIMIT 100")
def metadata_separator(spark, d):
    """Either separator, in the query and in the records; stored paths stay as they are."""
    path = F.when(F.col("file_id") % 2 == 0, F.translate("path", "/", "\\")).otherwise(F.col("path"))
    return m.search(_records(spark, d).select("file_id", path.alias("path")), path="src2\\ES")


@query(f"WITH {_M} SELECT file_id, path, CAST(row_number() OVER (ORDER BY string_split(path, '/'), file_id) - 1 AS BIGINT) AS path_rank FROM m")
def metadata_path_order(spark, d):
    return m.numbered(_records(spark, d).select("file_id", "path"))


@query(f"WITH {_M} SELECT file_id, count(*) AS records FROM m GROUP BY file_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return m.duplicate_ids(_records(spark, d))


@query(f"""WITH {_M} SELECT file_id, CASE WHEN size * file_id >= 1073741824 THEN printf('%.1f GiB', size * file_id / 1073741824.0) WHEN size * file_id >= 1048576 THEN printf('%.1f MiB', size * file_id / 1048576.0)
WHEN size * file_id >= 1024 THEN printf('%.1f KiB', size * file_id / 1024.0) ELSE (size * file_id) || ' B' END AS shown FROM m""")
def format_size(spark, d):
    return _records(spark, d).select("file_id", t.file_size(F.col("size") * F.col("file_id")).alias("shown"))


@query("""SELECT event_id AS file_id, CASE WHEN event_id % 100 = 0 THEN '—' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || 'Z' END AS shown FROM events""")
def format_mtime(spark, d):
    made = _table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.when(F.col("event_id") % 100 == 0, 0).otherwise(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("decimal(38,0)").alias("ns"))
    return made.select("file_id", t.modified_utc("ns").alias("shown"))


# --- sessions --------------------------------------------------------------

_PREVIEW = """CASE WHEN st > 0 THEN '…' ELSE '' END || substr(raw, CAST(st + 1 AS INTEGER), 180) || CASE WHEN st + 180 < length(raw) THEN '…' ELSE '' END"""
_PLACES = """CAST(greatest(least(length(decode(encode(raw)[1:byte_offset])) - 90, length(raw) - 180), 0) AS BIGINT) AS st"""


def _session_sql(hits: str, picked: str, after: str) -> str:
    return f"""WITH {_M}, {hits}, k AS (SELECT h.* FROM h {picked}), {_batch_sql(10, 500, 'k')},
c AS (SELECT b.file_id, b.line_number, byte_offset, raw, {_PLACES} FROM b JOIN u USING (file_id, line_number) WHERE snippet_number <= 3)
SELECT c.file_id, name, path, line_number, byte_offset, 'Line ' || line_number || ' · byte ' || byte_offset AS location, {_PREVIEW} AS preview FROM c JOIN m USING (file_id) {after}"""


def _flat(spark, d, request: Request) -> DataFrame:
    session = Session(_records(spark, d), _units(spark, d))
    rows = session.search(request)
    made = rows.select("file_id", "name", "path", F.explode("matches").alias("x"))
    return made.select("file_id", "name", "path", "x.line_number", "x.byte_offset", "x.location", "x.preview")


@query(_session_sql(_hits_sql("ing"), "", ""))
def session_content(spark, d):
    return _flat(spark, d, Request(content="ing", max_files=10))


@query(_session_sql(_hits_sql("ing"), "JOIN m USING (file_id) WHERE contains(name, '3')", ""))
def session_and(spark, d):
    """File and content: the condition on files goes first, so no match is lost to a limit."""
    return _flat(spark, d, Request(file="3", content="ing", max_files=10))


@query(_session_sql(_hits_sql("ing"), "", "WHERE contains(name, '3')"))
def session_and_postfilter(spark, d):
    """The same with limits first, as a search that stops early gives it."""
    return _flat(spark, d, Request(file="3", content="ing", max_files=10, filter_after_limits=True))


@query(f"WITH {_M} SELECT file_id, name, path, size FROM m WHERE contains(lower(path), 'src3/') ORDER BY lower(name), string_split(path, '/'), file_id LIMIT 25")
def session_files(spark, d):
    return Session(_records(spark, d), _units(spark, d)).search(Request(file="src3\\", full_path=True, max_files=25)).select("file_id", "name", "path", "size")


@query(f"""WITH {_M}, {_hits_sql('idiot')}, {_batch_sql(20, 500, 'h')},
c AS (SELECT b.file_id, b.line_number, byte_offset, raw, {_PLACES} FROM b JOIN u USING (file_id, line_number) WHERE snippet_number <= 3),
x AS (SELECT file_id, line_number, byte_offset, 'Line ' || line_number || ' · byte ' || byte_offset AS location, {_PREVIEW} AS preview FROM c),
nested AS (SELECT file_id, string_agg(line_number || '|' || byte_offset || '|' || location || '|' || preview, chr(10) ORDER BY line_number, byte_offset) AS matches FROM x GROUP BY file_id)
SELECT nested.file_id, path, size, name, matches FROM nested JOIN m USING (file_id) ORDER BY lower(name), string_split(path, '/'), file_id LIMIT 20""")
def session_rows_nested(spark, d):
    """Files with their nested matches, written out as text for the comparison."""
    rows = Session(_records(spark, d), _units(spark, d)).search(Request(content="idiot", max_files=20))
    one = lambda x: F.concat_ws("|", x["line_number"], x["byte_offset"], x["location"], x["preview"])
    return rows.select("file_id", "path", "size", "name", F.array_join(F.transform("matches", one), "\n").alias("matches"))


# --- grams -----------------------------------------------------------------

# Grams are of bytes, so the SQL cuts hexadecimal.
_G = f"""{_F}, s AS (SELECT file_id, upper(hex(encode(folded))) AS bytes FROM f),
g AS (SELECT DISTINCT file_id AS block_id, substr(bytes, 2 * i - 1, 6) AS gram FROM (SELECT file_id, bytes, unnest(range(1, length(bytes) // 2 - 1)) AS i FROM s))"""
_DF = f"{_G}, df AS (SELECT gram, CAST(least(count(*), 65) AS BIGINT) AS df FROM g GROUP BY gram)"


def _frequencies(spark, d, width=3):
    return g.frequencies(_raw_units(spark, d), width)


def _shown(frequencies, width=3):
    return frequencies.select(g.shown(F.col("gram"), width).alias("gram"), "df")


@query(f"WITH {_DF} SELECT gram, df FROM df")
def gram_df(spark, d):
    return _shown(_frequencies(spark, d))


@query(f"""WITH {_G}, w AS (SELECT DISTINCT file_id AS block_id, substr(bytes, 2 * i - 1, 10) AS gram FROM (SELECT file_id, bytes, unnest(range(1, length(bytes) // 2 - 3)) AS i FROM s))
SELECT gram, CAST(least(count(*), 65) AS BIGINT) AS df FROM w GROUP BY gram""")
def gram_df_five(spark, d):
    """Grams of five bytes."""
    return _shown(_frequencies(spark, d, 5), 5)


@query(f"WITH {_DF} SELECT gram, df FROM df ORDER BY df, gram LIMIT 50")
def gram_rare(spark, d):
    return _shown(g.rarest(_frequencies(spark, d), 50))


@query(f"WITH {_DF}, k AS (SELECT df, sum(sum(df)) OVER (ORDER BY df) AS total FROM df WHERE df <= 64 GROUP BY df) SELECT gram, df.df AS df FROM df JOIN k USING (df) WHERE total <= 2000")
def gram_budget(spark, d):
    return _shown(g.budget(_frequencies(spark, d), 2000))


@query(f"WITH {_G} SELECT block_id FROM g WHERE gram IN ('{"', '".join(sorted({('worthless'[i:i + 3]).encode().hex().upper() for i in range(7)}))}') GROUP BY block_id HAVING count(*) = 7")
def gram_candidates(spark, d):
    return g.candidates(g.grams(_raw_units(spark, d)), "Worthless")


def _indexed(spark, d):
    units = g.packed(_raw_units(spark, d), 1 << 16).drop("raw").persist()
    source = units.agg(F.coalesce(F.sum(F.octet_length("folded") + 1), F.lit(0)).alias("n")).head()["n"]
    return units, g.Index(**g.Index.build(units, source))


@query(f"WITH {_hits_sql('worthless')} {_H}")
def gram_pruned_hits(spark, d):
    """Hits found in candidate blocks of the index only: the same as from a scan of all units."""
    units, index = _indexed(spark, d)
    return s.literal_hits(index.pruned(units, "worthless"), "worthless")


@query(f"WITH {_hits_sql('.77@mail')} {_H}")
def gram_rare_hits(spark, d):
    """The same for a literal that few blocks have."""
    units, index = _indexed(spark, d)
    return s.literal_hits(index.pruned(units, ".77@mail"), ".77@mail")


@query(f"""WITH {_DF}, src AS (SELECT CAST(sum(strlen(raw) + 1) AS BIGINT) AS source_bytes FROM u),
k AS (SELECT df, CASE WHEN df <= 64 THEN count(*) * df ELSE 0 END AS rows, sum(CASE WHEN df <= 64 THEN count(*) * df ELSE 0 END) OVER (ORDER BY df) AS total FROM df GROUP BY df),
p AS (SELECT CAST(coalesce(sum(rows), 0) AS BIGINT) AS kept_postings FROM k WHERE df <= 64 AND total <= (SELECT floor(source_bytes * 0.01 / 4) FROM src))
SELECT source_bytes, (SELECT count(*) FROM df) AS grams, kept_postings, (SELECT count(*) FROM g) AS postings, kept_postings * 4.0 / source_bytes AS ratio FROM src, p""")
def capacity_report(spark, d):
    return g.capacity(_raw_units(spark, d)).withColumn("ratio", F.col("ratio").cast("double"))


# --- overlay ---------------------------------------------------------------

_D = f"""{_M}, up AS (
  SELECT file_id, 'moved/' || path AS path, size, modified_ns, kind, content_searchable, FALSE AS content_changed FROM m WHERE file_id % 50 = 0
  UNION ALL SELECT file_id, path, size + 7, modified_ns + 1, kind, content_searchable, TRUE FROM m WHERE file_id % 50 = 2
  UNION ALL SELECT file_id + 1000000, CASE WHEN file_id % 100 = 3 THEN path ELSE 'new/' || path END, size, modified_ns, kind, content_searchable, TRUE FROM m WHERE file_id % 50 = 3),
dead AS (SELECT file_id FROM m WHERE file_id % 50 = 1),
live AS (SELECT * FROM m WHERE file_id NOT IN (SELECT file_id FROM dead) AND file_id NOT IN (SELECT file_id FROM up) AND path NOT IN (SELECT path FROM up))"""


def _delta(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("file_id") % 50
    moved = base.where(k == 0).withColumn("path", F.concat(F.lit("moved/"), "path")).withColumn("content_changed", F.lit(False))
    changed = base.where(k == 2).withColumn("size", F.col("size") + 7).withColumn("modified_ns", (F.col("modified_ns") + 1).cast("decimal(38,0)")).withColumn("content_changed", F.lit(True))
    new_path = F.when(F.col("file_id") % 100 == 3, F.col("path")).otherwise(F.concat(F.lit("new/"), "path"))
    created = base.where(k == 3).withColumn("path", new_path).withColumn("file_id", F.col("file_id") + 1_000_000).withColumn("content_changed", F.lit(True))
    return moved.unionByName(changed).unionByName(created), base.where(k == 1).select("file_id")


@query(f"WITH {_D} SELECT {_MCOLS} FROM live UNION ALL SELECT {_MCOLS} FROM up WHERE file_id NOT IN (SELECT file_id FROM dead)")
def overlay_current(spark, d):
    base = _records(spark, d)
    return o.current(base, *_delta(base))


@query(f"WITH {_D}, x AS (SELECT {_MCOLS}, 0 AS from_base FROM up UNION ALL SELECT {_MCOLS}, 1 FROM live) SELECT * FROM x WHERE contains(path, 'src4/') ORDER BY from_base, file_id LIMIT 60")
def overlay_metadata_search(spark, d):
    base = _records(spark, d)
    return o.metadata_search(base, *_delta(base), F.contains("path", F.lit("src4/")), 60)


@query(f"""WITH {_hits_sql('idiot')}, {_D} SELECT h.file_id, coalesce(CASE WHEN up.file_id IS NOT NULL THEN up.path END, m.path) AS path, line_number, byte_offset
FROM h JOIN m USING (file_id) LEFT JOIN up ON up.file_id = h.file_id
WHERE h.file_id NOT IN (SELECT file_id FROM dead) AND NOT coalesce(up.content_changed, FALSE) AND m.path NOT IN (SELECT path FROM up WHERE up.file_id <> m.file_id)
UNION ALL SELECT h.file_id + 1000000, up.path, line_number, byte_offset FROM h JOIN up ON up.file_id = h.file_id + 1000000""")
def overlay_content_search(spark, d):
    """Base hits of live files, under their paths of now, and hits of created files; changed files lost the text."""
    base = _records(spark, d)
    ups, gone = _delta(base)
    found = s.literal_hits(_units(spark, d), "idiot")
    with_path = found.join(base.select("file_id", "path"), "file_id")
    fresh = found.withColumn("file_id", F.col("file_id") + 1_000_000).join(ups.select("file_id", "path"), "file_id")
    return o.content_hits(with_path, fresh, ups, gone)


# A log of all events over the customers; four events in a row share a path, which a customer may have had before.
_LOG = """ev AS (SELECT event_id AS seq, user_id AS file_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action, 'p' || (event_id // 4) AS path, event_type = 'purchase' AS content_changed FROM events),
base AS (SELECT c_custkey AS file_id, 'p' || (c_custkey * 3) AS path FROM customer),
up AS (SELECT * FROM ev WHERE action = 'upsert'),
ends AS (SELECT file_id, seq FROM ev WHERE action = 'delete'
  UNION ALL SELECT a.file_id, min(b.seq) FROM up a JOIN up b ON b.path = a.path AND b.file_id <> a.file_id AND b.seq > a.seq
    WHERE NOT EXISTS (SELECT 1 FROM ev c WHERE c.file_id = a.file_id AND c.seq > a.seq AND c.seq < b.seq) GROUP BY a.file_id, a.seq),
latest AS (SELECT file_id, max(seq) AS seq FROM ev GROUP BY file_id),
dead_at AS (SELECT file_id, max(seq) AS seq FROM ends GROUP BY file_id),
living AS (SELECT u.* FROM up u JOIN latest l ON l.file_id = u.file_id AND l.seq = u.seq LEFT JOIN dead_at x ON x.file_id = u.file_id WHERE x.seq IS NULL OR x.seq < u.seq)"""


def _log(spark, d):
    log = _table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("file_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"),
        F.concat(F.lit("p"), F.expr("event_id div 4").cast("string")).alias("path"),
        (F.col("event_type") == "purchase").alias("content_changed"),
    )
    return log, _table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("p"), (F.col("c_custkey") * 3).cast("string")).alias("path"))


@query(f"""WITH {_LOG} SELECT v.file_id, v.path, (SELECT bool_or(o.content_changed) FROM ev o LEFT JOIN dead_at x ON x.file_id = o.file_id WHERE o.file_id = v.file_id AND (x.seq IS NULL OR o.seq > x.seq)) AS content_changed FROM living v""")
def path_owner_replacement(spark, d):
    return o.resolved(*_log(spark, d))[0].select("file_id", "path", "content_changed")


@query(f"""WITH {_LOG} SELECT file_id FROM base b WHERE (file_id IN (SELECT file_id FROM ev) AND file_id NOT IN (SELECT file_id FROM living))
OR (file_id NOT IN (SELECT file_id FROM ev) AND path IN (SELECT path FROM up))""")
def overlay_tombstones(spark, d):
    return o.resolved(*_log(spark, d))[1]


_LIMITED = s.Limits(25, 60, 2)
_TWO = f"""{_hits_sql('idiot')}, bh AS (SELECT h.* FROM h WHERE file_id % 5 <> 2), dh AS (SELECT h.* FROM h WHERE file_id % 5 = 2),
{_batch_sql(25, 60, 'bh')}, seen AS (SELECT 25 - coalesce(max(file_number), 0) AS files, 60 - count(*) AS matches FROM b),
n2 AS (SELECT *, row_number() OVER (ORDER BY file_id, line_number, byte_offset) AS match_number, dense_rank() OVER (ORDER BY file_id) AS file_number,
  row_number() OVER (PARTITION BY file_id ORDER BY line_number, byte_offset) AS snippet_number FROM dh)"""


@query(f"""WITH {_TWO}, b2 AS (SELECT n2.* FROM n2, seen WHERE files > 0 AND matches > 0 AND match_number <= matches AND match_number <= coalesce((SELECT min(match_number) FROM n2, seen WHERE file_number >= files), matches))
SELECT file_id, line_number, byte_offset FROM b WHERE snippet_number <= 2 UNION ALL SELECT file_id, line_number, byte_offset FROM b2 WHERE snippet_number <= 2""")
def overlay_limits(spark, d):
    """Base and changed files under one limit: what the base leaves of it is the delta's."""
    found = s.literal_hits(_units(spark, d), "idiot")
    return o.limited_content(found.where("file_id % 5 <> 2"), found.where("file_id % 5 = 2"), _LIMITED)


@query(f"""WITH {_hits_sql('moron')}, bh AS (SELECT h.* FROM h WHERE file_id % 5 <> 2), dh AS (SELECT h.* FROM h WHERE file_id % 5 = 2),
{_batch_sql(100, 500, 'bh')}, n2 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number, byte_offset) AS sn FROM dh),
x AS (SELECT file_id, line_number, byte_offset FROM b WHERE snippet_number <= 3),
y AS (SELECT file_id, line_number, byte_offset, row_number() OVER (ORDER BY file_id, line_number, byte_offset) AS k FROM n2 WHERE sn <= 3)
SELECT * FROM x UNION ALL SELECT file_id, line_number, byte_offset FROM y WHERE k <= greatest(0, 100 - (SELECT count(*) FROM x))""")
def overlay_first_batch(spark, d):
    """The delta only fills up what the base's first batch lacks."""
    found = s.literal_hits(_units(spark, d), "moron")
    return o.first_content(found.where("file_id % 5 <> 2"), found.where("file_id % 5 = 2"))


@query(f"""WITH {_D}, seen AS (SELECT file_id, path, size, modified_ns FROM live UNION ALL SELECT file_id, path, size, modified_ns FROM up)
SELECT coalesce(m.file_id, s.file_id) AS file_id, CASE WHEN m.file_id IS NULL THEN 'create' WHEN s.file_id IS NULL THEN 'delete' WHEN m.path <> s.path THEN 'rename' ELSE 'modify' END AS action,
CASE WHEN m.file_id IS NULL THEN TRUE WHEN s.file_id IS NULL THEN FALSE ELSE m.size <> s.size OR m.modified_ns <> s.modified_ns END AS content_changed
FROM m FULL JOIN seen s ON m.file_id = s.file_id WHERE m.file_id IS NULL OR s.file_id IS NULL OR m.path <> s.path OR m.size <> s.size OR m.modified_ns <> s.modified_ns""")
def reconcile_actions(spark, d):
    base = _records(spark, d)
    return o.reconcile(base, o.current(base, *_delta(base)))


@query(f"WITH {_D}, c AS (SELECT (SELECT count(*) FROM up) + (SELECT count(*) FROM dead) AS changes, (SELECT count(*) FROM m) AS base_rows) SELECT changes, base_rows, changes >= 50000 OR changes >= greatest(1, ceil(0.02 * base_rows)) AS compact FROM c")
def compaction_decision(spark, d):
    base = _records(spark, d)
    ups, gone = _delta(base)
    marks = base.select(F.lit(0).alias("change")).unionByName(ups.select(F.lit(1).alias("change"))).unionByName(gone.select(F.lit(1).alias("change")))
    counts = marks.agg(F.sum("change").cast("long").alias("changes"), F.sum(1 - F.col("change")).cast("long").alias("base_rows"))
    return counts.withColumn("compact", o.should_compact(F.col("changes"), F.col("base_rows")))


# A scan that saw the changes of the overlay queries: a file whose content changed has a further line.
_OBS = """obs AS (SELECT doc_id, CASE WHEN doc_id % 50 = 2 THEN text || chr(10) || 'Idiot again' ELSE text END AS text FROM documents WHERE doc_id % 50 <> 1 AND doc_id % 100 <> 3
  UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 50 = 3)"""


def _observed(spark, d):
    base = _records(spark, d)
    ups, gone = _delta(base)
    records = o.current(base, ups, gone)
    k, texts = F.col("doc_id"), _docs(spark, d).select("doc_id", "text")
    old = texts.where((k % 50 != 1) & (k % 100 != 3)).withColumn("text", F.when(k % 50 == 2, F.concat("text", F.lit("\nIdiot again"))).otherwise(F.col("text")))
    files = old.unionByName(texts.where(k % 50 == 3).withColumn("doc_id", k + 1_000_000))
    return base, texts.withColumnRenamed("doc_id", "file_id"), records, files.withColumnRenamed("doc_id", "file_id")


def _reconciled(spark, d) -> Catalog:
    base, texts, records, files = _observed(spark, d)
    catalog = Catalog(spark, scratch(spark), 1 << 16)
    catalog.initialise(base, texts, 7)
    catalog.reconcile(records, files, 9)
    return catalog


@query(f"WITH {_D} SELECT {_MCOLS} FROM live UNION ALL SELECT {_MCOLS} FROM up WHERE file_id NOT IN (SELECT file_id FROM dead)")
def lifecycle_reconcile(spark, d):
    """Records of a stored catalog that was begun, reconciled with a later scan, and compacted as changes were many."""
    return _reconciled(spark, d).load().records.select(*[c.strip() for c in _MCOLS.split(",")])


@query(f"WITH {_OBS}, {_hits_sql('idiot').replace('FROM documents', 'FROM obs')} {_H}")
def store_search(spark, d):
    """Content hits in that catalog, found through its index."""
    return _reconciled(spark, d).load().hits("idiot")


@query(f"""WITH {_M}, {_D.removeprefix(_M + ', ')} SELECT file_id FROM m WHERE file_id IN (SELECT file_id FROM dead) OR file_id NOT IN (SELECT file_id FROM live UNION ALL SELECT file_id FROM up) OR file_id IN (SELECT file_id FROM up WHERE content_changed)""")
def source_drift(spark, d):
    """Records that a later scan shows to be stale."""
    base, texts, records, _ = _observed(spark, d)
    catalog = Catalog(spark, scratch(spark), 1 << 16)
    catalog.initialise(base, texts)
    return catalog.drifted(records)


# --- journals --------------------------------------------------------------

_BITS = {"view": j.RENAME_OLD, "click": j.RENAME_NEW, "signup": j.FILE_CREATE, "error": j.FILE_DELETE, "purchase": j.DATA_EXTEND}
_REASON = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _BITS.items()) + f" ELSE 0 END + CASE WHEN event_id % 53 = 0 THEN {j.HARD_LINK} ELSE 0 END"
_J = f"""jr AS (SELECT user_id AS file_reference, event_id AS usn, {_REASON} AS reason, 'f' || event_id AS name, event_id % 7 = 0 AS is_directory FROM events),
jm AS (SELECT *, max(CASE WHEN reason & {j.RENAME_OLD} <> 0 THEN usn END) OVER w AS old_at, max(CASE WHEN reason & {j.RENAME_NEW} <> 0 THEN usn END) OVER w AS new_at,
  last_value(CASE WHEN reason & {j.RENAME_OLD} <> 0 THEN name END IGNORE NULLS) OVER w AS kept FROM jr
  WINDOW w AS (PARTITION BY file_reference ORDER BY usn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ja AS (SELECT *, 'reconcile' AS action FROM jm WHERE reason & {j.HARD_LINK} <> 0
  UNION ALL SELECT *, CASE WHEN reason & {j.RENAME_OLD} <> 0 THEN NULL WHEN reason & {j.RENAME_NEW} <> 0 THEN CASE WHEN old_at IS NOT NULL AND (new_at IS NULL OR old_at > new_at) THEN 'rename' ELSE 'reconcile' END
    WHEN reason & {j.FILE_CREATE} <> 0 THEN 'create' WHEN reason & {j.FILE_DELETE} <> 0 THEN 'delete' WHEN reason & {j.DATA_EXTEND} <> 0 THEN 'modify' END FROM jm)"""


def _journal(spark, d):
    bits = F.lit(0)
    for name, bit in _BITS.items():
        bits = F.when(F.col("event_type") == name, F.lit(bit)).otherwise(bits)
    reason = bits + F.when(F.col("event_id") % 53 == 0, F.lit(j.HARD_LINK)).otherwise(0)
    return _table(spark, d, "events").select(
        F.col("user_id").alias("file_reference"),
        (F.col("user_id") % 10).alias("parent_reference"),
        F.col("event_id").alias("usn"),
        reason.cast("long").alias("reason"),
        F.when(F.col("event_id") % 7 == 0, j.DIRECTORY).otherwise(0).cast("long").alias("attributes"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"),
    )


@query(f"""WITH {_J} SELECT usn, file_reference, action, CASE WHEN action = 'rename' THEN kept END AS old_name, CASE WHEN action <> 'reconcile' THEN name END AS new_name, is_directory FROM ja WHERE action IS NOT NULL""")
def journal_normalise(spark, d):
    return j.normalise(_journal(spark, d))


@query(f"WITH {_J} SELECT CAST(least(min(CASE WHEN reason & {j.RENAME_OLD} <> 0 THEN usn END), max(usn) + 1) AS BIGINT) AS next_usn FROM jr")
def journal_checkpoint(spark, d):
    """Over the whole journal, and the next usn as observed in it."""
    return j.checkpoint(_journal(spark, d))


@query("""WITH k AS (SELECT c_custkey AS id FROM customer UNION SELECT 5) SELECT user_id AS file_reference, event_id AS usn FROM events WHERE user_id IN (SELECT id FROM k) OR user_id % 10 IN (SELECT id FROM k)""")
def journal_known(spark, d):
    """Events of known files, and of files below known folders or the root."""
    known = _table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"))
    return j.known_events(_journal(spark, d), known, 5).select("file_reference", "usn")


_TREE = """tree AS (SELECT 0 AS file_id, CAST(NULL AS BIGINT) AS parent, 'root' AS name UNION ALL SELECT 1 + r_regionkey, 0, r_name FROM region
UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, c_name FROM customer)"""


def _tree(spark, d):
    root = spark.createDataFrame([(0, None, "root")], "file_id long, parent long, name string")
    pick = lambda name, i, p, n: _table(spark, d, name).select(i.cast("long").alias("file_id"), p.cast("long").alias("parent"), F.col(n).alias("name"))
    return (
        root.unionByName(pick("region", F.col("r_regionkey") + 1, F.lit(0), "r_name"))
        .unionByName(pick("nation", F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, "n_name"))
        .unionByName(pick("customer", F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, "c_name"))
    )


@query(f"WITH RECURSIVE {_TREE}, x AS (SELECT file_id, name AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.file_id, x.path || '/' || t.name FROM tree t JOIN x ON t.parent = x.file_id) SELECT CAST(file_id AS BIGINT) AS file_id, path FROM x")
def tree_paths(spark, d):
    return j.paths(spark, _tree(spark, d))


@query(f"WITH RECURSIVE {_TREE}, x AS (SELECT file_id, 1 AS depth FROM tree WHERE parent = 2 UNION ALL SELECT t.file_id, x.depth + 1 FROM tree t JOIN x ON t.parent = x.file_id) SELECT CAST(file_id AS BIGINT) AS file_id, CAST(depth AS INTEGER) AS depth FROM x")
def tree_descendants(spark, d):
    return j.descendants(spark, _tree(spark, d), 2)


# --- relational extras on search results ------------------------------------


@query(f"""WITH {_hits_sql('idiot')} SELECT toxic, count(DISTINCT h.file_id) AS files, count(*) AS hits FROM h JOIN labels ON labels.doc_id = h.file_id GROUP BY toxic""")
def hits_by_label(spark, d):
    found = s.literal_hits(_units(spark, d), "idiot")
    return found.join(_table(spark, d, "labels"), F.col("file_id") == F.col("doc_id")).groupBy("toxic").agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("hits"))


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL""")
def events_by_hour(spark, d):
    """Tumbling windows over event time, as a batch."""
    e = _table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").cast(dict(e.dtypes)["ts"]).alias("hour"), "event_type", "events")


@query("""SELECT latency, CAST(v AS DOUBLE) AS value FROM (SELECT unnest(['p50', 'p95', 'max']) AS latency, unnest([l[CAST(ceil((len(l) - 1) * 0.5) AS INTEGER) + 1], l[CAST(ceil((len(l) - 1) * 0.95) AS INTEGER) + 1], l[len(l)]]) AS v FROM (SELECT list_sort(list(value)) AS l FROM events))""")
def percentiles(spark, d):
    """Values at given places of the order."""
    found = percentiles_of(_table(spark, d, "events").select("value"), {"p50": 50, "p95": 95, "max": 100})
    return found.select(F.col("name").alias("latency"), F.col("value").cast("double").alias("value"))
