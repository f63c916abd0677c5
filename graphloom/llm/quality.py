"""Quality rules by compression bands.

A text's zstandard ratio (compressed bytes a byte) falls with its length, so limits go by length. Below its band
a text repeats itself; above it, it is noise. The same bands are applied to each fixed-size chunk of the text, since
a long clean part can hide a bad one from the ratio of the whole: a text of up to 16 chunks may have none outside its
band, of up to 64 one, and longer ones one in 64. Each document is judged alone: one pass,
no shuffle, memory bounded by the longest text.

Defined results: a null text counts as an empty one, has no words and fails the base rules; ratios of empty texts are
null; rows that repeat are judged alike, each on its own; columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, pick, pieces, utf8

#: (texts of fewer bytes than this, least ratio, greatest ratio). Texts of under 64 bytes are stored as they are whether
#: prose or noise, so only repetition shows there.
BANDS = (
    (32, 0.90, 99.0),
    (64, 0.65, 2.0),
    (128, 0.45, 1.06),
    (256, 0.42, 1.15),
    (512, 0.38, 0.95),
    (1024, 0.34, 0.84),
    (2048, 0.31, 0.76),
    (4096, 0.28, 0.72),
    (8192, 0.25, 0.70),
    (1 << 62, 0.22, 0.68),
)
CHUNK_BYTES = 4096
#: The last chunk takes what is left of the text if that is less than so many bytes.
LEAST_CHUNK = 128
#: (texts of fewer chunks than this, chunks outside their bands that such a text may hold); longer ones one in 64.
CHUNKS_OUTSIDE = ((17, 0), (65, 1))
LEVEL = 3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_bytes bigint, ratio double, n_chunks bigint, n_chunks_outside bigint, base_failed boolean, kept boolean, reason string"
)


def band(size: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((low, high) for below, low, high in bands if size < below)


def chunks_allowed(n: int, limits: tuple = CHUNKS_OUTSIDE) -> int:
    return next((most for below, most in limits if n < below), n // 64)


def cut(raw: bytes, chunk: int = CHUNK_BYTES) -> list[bytes]:
    """Chunks of fixed size; a rest of under LEAST_CHUNK bytes belongs to the last one."""
    begins = [i for i in range(0, len(raw), chunk) if i == 0 or len(raw) - i >= LEAST_CHUNK]
    return [raw[a:b] for a, b in zip(begins, [*begins[1:], len(raw)], strict=True)]


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        mixed += h[k : k + n] * FACTORS[k]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # some windows share a hash: now by the words themselves
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)).tobytes()
    width = 4 * WINDOW
    windows = [ids[4 * i : 4 * i + width] for i in range(n)]
    count: dict[bytes, int] = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in enumerate(windows):
        if count[w] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def judge(raw: bytes, packer: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK_BYTES, outside_limits: tuple = CHUNKS_OUTSIDE) -> tuple:
    """All columns of SCHEMA but the id."""
    words = raw.split()  # bytes.split() cuts at the six ASCII white-space characters alone
    n_words = len(words)
    marked = len(raw.translate(None, SPACES))
    word_chars = marked if raw.isascii() else len(raw.translate(None, SPACES).decode("utf-8", "replace"))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeat_words(words)
    base_failed = n_words < 20 or 100 * repeats > 30 * n_words
    size = len(raw)
    ratio, n_chunks, outside, reason = None, 0, 0, None
    if size:
        ratio = len(packer.compress(raw)) / size
        low, high = band(size, bands)
        parts = cut(raw, chunk)
        n_chunks = len(parts)
        for part in parts:
            a, b = band(len(part), bands)
            outside += not a <= (ratio if n_chunks == 1 else len(packer.compress(part)) / len(part)) <= b
        reason = "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if outside > chunks_allowed(n_chunks, outside_limits) else None
    reason = "base" if base_failed else reason
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, size, ratio, n_chunks, outside, base_failed, reason is None, reason


def _judged(batches: Iterator[pa.RecordBatch], schema: pa.Schema, bands: tuple, chunk: int, limits: tuple) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in pieces(batches):
        rows = [judge(x or b"", packer, bands, chunk, limits) for x in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(schema) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t.type) for c, t in zip(columns, list(schema)[1:], strict=True)]], schema=schema)


def compression_bands(docs: DataFrame, bands: tuple = BANDS, chunk: int = CHUNK_BYTES, limits: tuple = CHUNKS_OUTSIDE) -> DataFrame:
    """One row per document: counts, ratios and the verdict with its reason (null if kept)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), utf8("text").alias("text"))
    return mapped(rows, partial(_judged, schema=schema, bands=bands, chunk=chunk, limits=limits), SCHEMA)
