"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a part has at most ``LEAF`` code points. A part's value is
the ids of that part as a text of its own. Two neighbours are joined by re-encoding
a window around the seam, which grows outwards to the next stable place: a space
after a character that is not white space. No alternative of the pattern takes white
space after anything else, so whatever the context, a match ends before such a
space; and what a match takes from there on does not depend on the text before. So
the ids outside the window are those of the joined text, joining is associative, and
the root has the ids of one pass over the text. Where there is no such place, the
window reaches the end of the part, so text without spaces is encoded again at each level. Decoding concatenates the bytes of halves up
the same kind of tree.

Defined cases: a null text counts as empty and has no ids; texts of any length are
encoded whole; repeated rows each give a row; other columns are carried through.
The ranks' file is read by the driver and broadcast, so its size is checked.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._shared import free_name, small_batches, table, trimmed

#: Parts of at most so many code points are encoded at once; smaller ones mean more joining.
LEAF = 256
#: Ids that are decoded at once.
RUN = 4096
LARGEST_FILE = 64 << 20
RANKS = "byte_bpe_multi_50k.tiktoken"


class Codec:
    """Encodes and decodes with the ranks of one tiktoken file."""

    def __init__(self, blob: bytes, leaf: int = LEAF) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        self.leaf = leaf
        self._plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._texts = [str(k) for k in range(len(self._bytes))]

    def encode(self, text: str | None) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self._plain(text[start:end])
        seam = (start + end) // 2
        return self._join(text, start, seam, end, self._encode(text, start, seam), self._encode(text, seam, end))

    def _join(self, text: str, start: int, seam: int, end: int, left: list[int], right: list[int]) -> list[int]:
        first, last = stable_before(text, start, seam), stable_after(text, seam, end)
        sizes = self._bytes
        rest, kept = len(text[first:seam].encode()), len(left)
        while rest > 0:
            kept -= 1
            rest -= len(sizes[left[kept]])
        over, dropped = len(text[seam:last].encode()), 0
        while over > 0:
            over -= len(sizes[right[dropped]])
            dropped += 1
        if rest or over:
            raise AssertionError("a token crosses a stable place")
        del left[kept:]
        left += self._plain(text[first:last])
        left += right[dropped:] if dropped else right
        return left

    def listed(self, ids: list[int]) -> str:
        """The ids as decimal numbers with commas between them."""
        return ",".join(map(self._texts.__getitem__, ids))

    def decode(self, ids: list[int], start: int = 0, end: int | None = None) -> bytes:
        end = len(ids) if end is None else end
        if end - start <= min(self.leaf * 16, RUN):
            return b"".join(map(self._bytes.__getitem__, ids[start:end]))
        middle = (start + end) // 2
        return self.decode(ids, start, middle) + self.decode(ids, middle, end)


def stable_before(text: str, start: int, seam: int) -> int:
    """The last stable place between ``start`` and ``seam``, or ``start``."""
    at = text.rfind(" ", start + 1, seam)
    while at > 0 and text[at - 1].isspace():
        at = text.rfind(" ", start + 1, at)
    return at if at > 0 else start


def stable_after(text: str, seam: int, end: int) -> int:
    """The first stable place from ``seam`` on, or ``end``."""
    at = text.find(" ", seam, end)
    while at >= 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1, end)
    return at if at >= 0 else end


_codecs: dict[bytes, Codec] = {}


def _codec(blob: bytes) -> Codec:
    """One codec per worker process and file."""
    key = hashlib.sha256(blob).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(blob)
    return _codecs[key]


def _ranks(spark: SparkSession, path: str | None):
    small_batches(spark)
    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        blob = file.read(LARGEST_FILE + 1)
    if len(blob) > LARGEST_FILE:
        raise ValueError(f"a ranks file of over {LARGEST_FILE} bytes is not broadcast")
    return spark.sparkContext.broadcast(blob)


def ids_of(codec: Codec, texts: list[str | None], checked: bool) -> list[list[int]]:
    """The ids of each text; with ``checked``, a text that its ids don't decode to is an error."""
    made = [codec.encode(t) for t in texts]
    if checked and any(codec.decode(ids) != (t or "").encode() for ids, t in zip(made, texts, strict=True)):
        raise ValueError("a text differs from its decoded ids")
    return made


def encode(docs: DataFrame, path: str | None = None, column: str = "text", checked: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``, an array of the ids of ``column`` (empty for null).

    ``checked``: ids are decoded again by the same worker, and a text that they don't give back is an error.
    """
    ranks, out = _ranks(docs.sparkSession, path), free_name(docs, "token_ids")
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            for part in _slices(batch):
                ids = pa.array(ids_of(codec, part.column(at).to_pylist(), checked), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*batch.schema.names, out])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str | None = None, column: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids in ``column`` (empty for null)."""
    ranks, out = _ranks(encoded.sparkSession, path), free_name(encoded, "decoded")
    at = encoded.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            for part in _slices(batch):
                made = pa.array([codec.decode(ids or []) for ids in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*batch.schema.names, out])

    return encoded.mapInArrow(trimmed(run), T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a batch of long texts stays small in Python."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of a round trip."""
    ranks = _ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for part in _slices(batch):
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(codec.listed(ids).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
