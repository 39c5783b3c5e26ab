"""Text and document files as rows: a directory scan, and units extracted from office documents."""

from __future__ import annotations

import io
import os
import re
import shutil
import stat
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import numbered as _numbered

# Which files a scan takes and which folders it leaves out.
SKIPPED_FOLDERS = (".git", "target", "node_modules", ".venv", "venv", "dist", "build")
TEXT_EXTENSIONS = ("rs", "md", "txt", "log", "json", "toml", "yaml", "yml", "xml", "html", "css", "csv", "ts", "tsx", "js", "jsx", "c", "h", "cc", "cpp", "hpp", "py", "ps1", "cmd", "bat", "sh")
BARE_NAMES = ("README", "LICENSE", "Makefile")
DOCUMENT_EXTENSIONS = ("pdf", "docx", "xlsx", "pptx")

UNIT_SCHEMA = "path string, kind string, line_number int, raw string, problem string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1))


def searchable(path: Column) -> Column:
    """A known extension in any case, or a known bare name without one; not below a skipped folder."""
    name = F.element_at(F.split(path, "/"), -1)
    folders = "|".join(map(re.escape, SKIPPED_FOLDERS))
    return (extension(path).isin(*TEXT_EXTENSIONS) | ((extension(path) == "") & name.isin(*BARE_NAMES))) & ~path.rlike(rf"(^|/)({folders})/")


def extractable(path: Column) -> Column:
    folders = "|".join(map(re.escape, SKIPPED_FOLDERS))
    return extension(path).isin(*DOCUMENT_EXTENSIONS) & ~path.rlike(rf"(^|/)({folders})/")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative), ``size``, ``modified_ns``, ``content`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    # the source's paths are URIs: the part behind the root is what is kept
    relative = F.url_decode(F.regexp_replace(F.regexp_extract("path", re.escape(base) + r"/(.*)$", 1), r"\+", "%2B"))
    return files.select(relative.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), "content")


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, modified_ns, text`` of the searchable files that are valid UTF-8."""
    found = scan(spark, root).where(searchable(F.col("path")))
    text = F.col("content").cast("string")
    return found.where(F.is_valid_utf8(text)).select("path", "size", "modified_ns", text.alias("text"))


def numbered(files: DataFrame) -> DataFrame:
    """Files with ``doc_id``, their place in the order of paths by parts, from 0."""
    return _numbered(files.withColumn("file_id", F.xxhash64("path"))).drop("file_id").withColumnRenamed("path_rank", "doc_id")


def metadata_records(root: str) -> list[tuple]:
    """``file_id, path, size, modified_ns, kind`` of everything below a local folder, in path order.

    Walking a file system is driver work; the rows then become a table.
    """
    rows = []
    for folder, folders, names in os.walk(root):
        folders.sort()
        for name in sorted([*folders, *names]):
            full = os.path.join(folder, name)
            info = os.lstat(full)
            kind = "Symlink" if stat.S_ISLNK(info.st_mode) else "Directory" if stat.S_ISDIR(info.st_mode) else "File" if stat.S_ISREG(info.st_mode) else "Other"
            rows.append((info.st_ino, os.path.relpath(full, root), info.st_size if kind == "File" else 0, info.st_mtime_ns, kind))
    rows.sort(key=lambda r: r[1].split("/"))
    seen: set[int] = set()
    out = []
    for file_id, *rest in rows:  # hard links share an inode: later ones get an id of their own
        while file_id in seen:
            file_id = (file_id * 0x100000001B3 + 1) % (1 << 63)
        seen.add(file_id)
        out.append((file_id, *rest))
    return out


def metadata_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(metadata_records(root), "file_id long, path string, size long, modified_ns long, kind string")


# --- documents -------------------------------------------------------------

_space = re.compile(r"\s+")
_token = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(.*?)\]\]>|<!DOCTYPE(?:[^>\[]|\[.*?\])*>|<(/?)([^\s/>]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|([^<]+)", re.S)
_entity = re.compile(r"&(?:#(\d+)|#x([0-9A-Fa-f]+)|(\w+));")
_known = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_xml(data: bytes) -> str:
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding)
    return data.decode("utf-8")


def _plain(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 10 if m[1] else 16))
        if m[3] not in _known:
            raise ValueError(f"unknown entity &{m[3]};")
        return _known[m[3]]

    return _entity.sub(one, text)


def events(xml: str) -> Iterator[tuple[str, str, str]]:
    """``(start|end|text, local name, attributes or text)`` of a document."""
    at = 0
    for m in _token.finditer(xml):
        if m.start() != at:
            raise ValueError("malformed XML")
        at = m.end()
        if m[1] is not None:
            yield "text", "", m[1]
        elif m[3]:
            name = m[3].rpartition(":")[2]
            if m[2]:
                yield "end", name, ""
            else:
                yield "start", name, m[4]
                if m[5]:
                    yield "end", name, ""
        elif m[6] is not None:
            yield "text", "", _plain(m[6])
    if at != len(xml):
        raise ValueError("malformed XML")


def attribute(attributes: str, name: str) -> str | None:
    m = re.search(rf"(?:^|\s)(?:[^\s=:]+:)?{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attributes)
    return _plain(m[1] if m[1] is not None else m[2]) if m else None


def unit(text: str) -> str:
    return _space.sub(" ", text).strip()


def paragraphs(xml: str, container: str = "p", leaf: str = "t") -> list[str]:
    """Texts of all containers: their leaves joined, with a space for tabs and breaks."""
    out, open_, in_leaf = [], [], 0
    for kind, name, value in events(xml):
        if kind == "start":
            if name == container:
                open_.append([])
            elif name in ("tab", "br", "cr") and open_:
                open_[-1].append(" ")
            in_leaf += name == leaf
        elif kind == "end":
            in_leaf -= name == leaf
            if name == container and open_:
                if made := unit("".join(open_.pop())):
                    out.append(made)
        elif in_leaf and open_:
            open_[-1].append(value)
    return out


def _number(name: str) -> int:
    m = re.search(r"(\d+)\.xml$", name)
    return int(m[1]) if m else 0


_DOCX_PARTS = ("document", "header", "footer", "footnotes", "endnotes", "comments")


def docx_units(archive: zipfile.ZipFile) -> list[str]:
    def rank(name: str) -> tuple | None:
        m = re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", name)
        return (_DOCX_PARTS.index(re.sub(r"\d+$", "", m[1])), _number(name), name) if m else None

    parts = sorted((n for n in archive.namelist() if rank(n)), key=rank)
    return [u for n in parts for u in paragraphs(decode_xml(archive.read(n)))]


def pptx_units(archive: zipfile.ZipFile) -> list[str]:
    parts = [n for n in archive.namelist() if re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", n)]
    parts.sort(key=lambda n: (re.sub(r"\d+\.xml$", "", n), _number(n)))
    return [u for n in parts for u in paragraphs(decode_xml(archive.read(n)))]


def xlsx_units(archive: zipfile.ZipFile) -> list[str]:
    names = set(archive.namelist())
    shared = paragraphs_of_strings(decode_xml(archive.read("xl/sharedStrings.xml"))) if "xl/sharedStrings.xml" in names else []
    out = []
    for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number):
        out += _cells(decode_xml(archive.read(sheet)), shared)
    return out


def paragraphs_of_strings(xml: str) -> list[str]:
    """All shared strings, the empty ones too: cells name them by number."""
    out, parts, inside = [], None, 0
    for kind, name, value in events(xml):
        if kind == "start":
            if name == "si":
                parts = []
            inside += name == "t"
        elif kind == "end":
            inside -= name == "t"
            if name == "si":
                out.append("".join(parts or []))
                parts = None
        elif inside and parts is not None:
            parts.append(value)
    return out


def _cells(xml: str, shared: list[str]) -> list[str]:
    out, kind_of, within = [], "", ""
    cell: dict[str, list[str]] = {}
    for kind, name, value in events(xml):
        if kind == "start":
            if name == "c":
                kind_of, cell = attribute(value, "t") or "", {"f": [], "v": [], "t": []}
            elif name in cell:
                within = name
        elif kind == "end":
            if name == "c":
                raw, formula = "".join(cell["v"]), "".join(cell["f"])
                if kind_of == "s":
                    index = int(raw) if raw.strip().isdigit() else -1
                    shown = shared[index] if 0 <= index < len(shared) else ""
                elif kind_of == "inlineStr":
                    shown = "".join(cell["t"])
                elif kind_of == "b":
                    shown = "TRUE" if raw.strip() == "1" else "FALSE"
                else:
                    shown = raw
                if made := unit(f"{formula} {shown}"):
                    out.append(made)
                cell = {}
            elif name == within:
                within = ""
        elif within and cell:
            cell[within].append(value)
    return out


def pdf_paragraphs(text: str) -> list[str]:
    """Pages end at form feeds, paragraphs at blank lines; soft line ends become spaces."""
    return [made for page in text.split("\f") for block in re.split(r"\n[^\S\n]*\n", page) if (made := unit(block))]


def pdf_units(data: bytes, helper: str = "pdftotext") -> list[str]:
    """Through an external helper, as the format has no reader in the standard library."""
    program = shutil.which(helper)
    if not program:
        raise RuntimeError(f"{helper} is not installed")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as file:
        file.write(data)
        file.flush()
        done = subprocess.run([program, "-enc", "UTF-8", "-eol", "unix", file.name, "-"], capture_output=True, check=True, timeout=120)
    return pdf_paragraphs(done.stdout.decode())


def document_units(kind: str, data: bytes) -> list[str]:
    if kind == "pdf":
        return pdf_units(data)
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return {"docx": docx_units, "pptx": pptx_units, "xlsx": xlsx_units}[kind](archive)


def extracted(files: DataFrame) -> DataFrame:
    """``path, kind, line_number, raw, problem`` of documents given as ``path, content``.

    A document that can't be read gives one row that says why.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    rows = [(path, kind, k, u, None) for k, u in enumerate(document_units(kind, bytes(content)), 1)]
                except (ValueError, KeyError, RuntimeError, UnicodeError, zipfile.BadZipFile, subprocess.SubprocessError) as e:
                    rows = [(path, kind, 0, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "kind", "line_number", "raw", "problem"])

    return files.select("path", extension(F.col("path")).alias("kind"), "content").where(F.col("kind").isin(*DOCUMENT_EXTENSIONS)).mapInPandas(run, UNIT_SCHEMA)


def mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What a catalog of a local folder begins with: records with ``content_searchable``, and ``file_id, text``.

    Texts are those of text files that are valid UTF-8 and, unit by unit on lines of their own, of documents
    that can be read. All other files have a record only.
    """
    records = metadata_table(spark, root)
    found = scan(spark, root)
    units = extracted(found.where(extractable(F.col("path")))).where("problem IS NULL")
    lines = F.sort_array(F.collect_list(F.struct("line_number", "raw")))["raw"]  # one document's
    documents = units.groupBy("path").agg(F.array_join(lines, "\n").alias("text"))
    text = F.col("content").cast("string")
    texts = found.where(searchable(F.col("path")) & F.is_valid_utf8(text)).select("path", text.alias("text"))
    files = records.where("kind = 'File'").select("file_id", "path").join(texts.unionByName(documents), "path").select("file_id", "text")
    known = files.select("file_id", F.lit(True).alias("content_searchable"))
    return records.join(known, "file_id", "left").withColumn("content_searchable", F.coalesce("content_searchable", F.lit(False))), files


def html_units(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``file_id, line_number, raw``: the text between tags of web pages, piece by piece.

    Scripts, styles and comments go; the five XML entities and a few common ones are decoded.
    """
    bare = F.regexp_replace(F.col(column), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    pieces = F.split(bare, r"<[^>]*>")
    clean = F.transform(pieces, lambda x: F.trim(F.regexp_replace(_decoded(x), r"\s+", " ")))
    made = pages.select(F.col(key).alias("file_id"), F.posexplode(F.filter(clean, lambda x: x != "")).alias("n", "raw"))
    return made.select("file_id", (F.col("n") + 1).alias("line_number"), "raw")


def _decoded(text: Column) -> Column:
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return text

