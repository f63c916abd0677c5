"""Token ids in seekable zstandard files.

A file holds independent zstandard frames, each with the ids (little-endian unsigned 32-bit) of some consecutive
documents; a skippable frame with the file's place among all files and which documents lie in which frame; and, last, the seek table of the seekable
zstandard format: of each frame the compressed and decompressed size and a checksum (the low half of XXH64 of the
decompressed bytes). A reader finds a document by the end of the file and decompresses its frame alone; any
zstandard tool can decompress the file as a whole.

Documents are dealt out by ranges of doc_id, text and row, so no task holds more than its share, even where one id is
very common. A file's place is its range's number and its own within the range; names play no part in the order.
Spark's own writer commits the files: a task that is tried again leaves no second file, in any store Spark can write.
A file's row is made whole in memory, so its size is bounded by FILE_BYTES and the longest document. An index table
beside the files says which file holds a document, so that a reader of some documents opens their files alone.

Defined results: a null text counts as an empty one, whose only id is the end; an empty table makes no files; rows
with one doc_id follow one another by a hash of their texts, null ids come first; the strings of special tokens in a
text are those tokens, as the library has it; further columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Chunks
from .common import mapped, new_path, pick, pieces, running_totals, share, sized_join, small, utf8

FRAME_BYTES = 256 << 10
FILE_BYTES = 8 << 20
LEVEL = 3
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Spark's text writer ends each row, here a whole file, with this: the magic number that ends a seek table.
TAIL = struct.pack("<I", SEEKABLE_MAGIC).decode("latin-1")
DOCUMENT = [("doc", "<i8"), ("n", "<u4"), ("frame", "<u4")]
#: The folder of the index table; Spark's readers of the files pass over names that begin so.
INDEX = "_documents"


class FileBuilder:
    """Collects documents' ids into one file."""

    def __init__(self, level: int = LEVEL, place: tuple[int, int] = (0, 0), frame_bytes: int = FRAME_BYTES):
        self.place, self.frame_bytes = place, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.packed_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((-(1 << 63) if doc_id is None else doc_id, len(ids) // 4, len(self.entries)))
        self.open.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            frame = self.packer.compress(raw)
            self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.frames.append(frame)
            self.packed_bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def body(self) -> bytes:
        """The file but for its last four bytes, TAIL."""
        self.close_frame()
        index = struct.pack("<qq", *self.place) + np.array(self.docs, dtype=DOCUMENT).tobytes()
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IB", len(self.entries), 0x80)
        return b"".join([*self.frames, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", TABLE_MAGIC, len(table) + 4), table])


class TokenFile:
    """Reads a file's bytes; frames are decompressed on demand and checked."""

    def __init__(self, raw: bytes):
        count, flags, magic = struct.unpack_from("<IBI", raw, len(raw) - 9)
        if magic != SEEKABLE_MAGIC or flags & 0x80 == 0:
            raise ValueError("not a seekable zstandard file with checksums")
        begin = len(raw) - 9 - 12 * count
        self.raw = raw
        self.entries = np.frombuffer(raw, dtype="<u4", count=3 * count, offset=begin).reshape(count, 3)
        ends = np.cumsum(self.entries[:, 0], dtype=np.int64)
        self.begins = ends - self.entries[:, 0]
        at = int(ends[-1]) if count else 0
        magic, size = struct.unpack_from("<II", raw, at)
        if magic != INDEX_MAGIC:
            raise ValueError("the documents' index is missing")
        self.place = struct.unpack_from("<qq", raw, at + 8)
        self.docs = np.frombuffer(raw, dtype=DOCUMENT, count=size // 16 - 1, offset=at + 24)
        self.opener = zstandard.ZstdDecompressor()
        ends = np.cumsum(self.docs["n"], dtype=np.int64)
        self.starts = ends - self.docs["n"]
        first = np.searchsorted(self.docs["frame"], np.arange(count))
        self.frame_starts = self.starts[first] if count else ends

    def frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.entries[k])
        begin = int(self.begins[k])
        out = self.opener.decompress(self.raw[begin : begin + packed], max_output_size=size)
        if xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: wrong checksum")
        return out

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, its ids as bytes) of all or of the wanted documents."""
        last, opened = -1, b""
        for (doc, n, frame), start in zip(self.docs.tolist(), self.starts.tolist(), strict=True):
            if wanted is None or doc in wanted:
                if frame != last:
                    last, opened = frame, self.frame(frame)
                begin = 4 * (start - int(self.frame_starts[frame]))
                yield (None if doc == -(1 << 63) else doc), start, opened[begin : begin + 4 * n]


@cache
def loaded(path: str) -> Chunks:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models

    tokenizer = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        model = json.load(f)["model"]
    if model.get("type", "BPE") == "BPE":  # Chunks has a cache of its own
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        options = {k: model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
        tokenizer.model = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options)
    return Chunks(tokenizer)


def _built(batches: Iterator[pa.RecordBatch], path: str, end: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    chunks, tail = loaded(path), struct.pack("<I", end)
    part, number = TaskContext.get().partitionId(), itertools.count()
    builder = FileBuilder(place=(part, next(number)), frame_bytes=min(FRAME_BYTES, file_bytes))

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([builder.body()], pa.binary())], names=["body"])

    for batch in pieces(batches, "text", 2_000_000):
        texts = (x.decode("utf-8", "replace") if x else "" for x in batch.column("text").to_pylist())
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), chunks.encode(texts), strict=True):
            builder.add(doc_id, ids + tail)
            if builder.packed_bytes >= file_bytes:
                yield row()
                builder = FileBuilder(place=(part, next(number)), frame_bytes=min(FRAME_BYTES, file_bytes))
    if builder.docs:
        yield row()


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0, index: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Writes docs (doc_id, text) as token files in ascending doc_id order, with the id ``end`` after each document."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), utf8("text").alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "tie", "row")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = mapped(dealt, partial(_built, path=tokenizer, end=end, file_bytes=file_bytes), "body binary")
    (
        files.select(F.col("body").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", TAIL)
        .text(path)
    )
    if index:
        listed = read(docs.sparkSession, path, ids=False).select("doc_id", F.element_at(F.split("file", "/"), -1).alias("name"))
        listed.distinct().repartitionByRange("doc_id", "name").sortWithinPartitions("doc_id").write.parquet(f"{path}/{INDEX}")


def _read(batches: Iterator[pa.RecordBatch], wanted: frozenset[int] | None, ids: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"file": pa.string(), "part": pa.int64(), "number": pa.int64(), "doc_id": pa.int64(), "start_in_file": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    for batch in batches:
        for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            file = TokenFile(raw.as_py())
            found = [(name, *file.place, doc, start, len(x) // 4, zlib.crc32(x), *([x] if ids else [])) for doc, start, x in file.documents(wanted)]
            if found:
                types = kinds | ({"ids": pa.binary()} if ids else {})
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types.values(), strict=True)], names=list(types))


def read(spark: SparkSession, path: str, wanted: frozenset[int] | None = None, ids: bool = True) -> DataFrame:
    """(file, part, number, doc_id, start_in_file, n_tokens, ids_crc32, ids) of all documents, or of a given set of wanted ones.

    The index says which files hold wanted documents; the others aren't opened, and frames without any stay packed.
    """
    places: str | list[str] = path
    if wanted is not None:
        names = spark.read.schema("doc_id bigint, name string").parquet(f"{path}/{INDEX}").where(F.col("doc_id").isin(*wanted)).select("name").distinct()
        places = [f"{path}/{r['name']}" for r in names.collect()]
    schema = "file string, part bigint, number bigint, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else "")
    if not places:
        return spark.createDataFrame([], schema)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(places).select("path", "content")
    return mapped(rows, partial(_read, wanted=wanted, ids=ids), schema)


def starts(found: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before one, by the files' places."""
    sums = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("file_tokens"))
    offsets = running_totals(sums, ["part", "number"], "file_tokens", "before", "files").select("part", "number", "before")
    table, fits = small(offsets, "file_starts")
    return sized_join(found, table, ["part", "number"], "inner", fits).withColumn("start", F.col("before") + F.col("start_in_file"))


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs to files in the shared folder and returns what the files hold, without the ids themselves."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer, end, index=False, file_bytes=file_bytes)
    return starts(share(read(spark, path, ids=False), "read"))
