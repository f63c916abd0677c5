"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary file gives ranks of byte strings. Each byte has a character of its own, merges follow from the ranks,
and each match of the pattern is encoded separately. Ids of a text are those of its chunks: a text is cut before
every single space between two other characters, which the pattern never matches across. Each distinct chunk goes
through the library once while a bounded cache holds it; a text with other white space beside a space goes whole.

Decoding joins the tokens' bytes, so characters that two tokens share come out right; offsets count bytes, and a
token's first character is the one that holds its first byte. Each document is encoded alone: one pass, no shuffle.

Defined results: a null text counts as an empty one; an empty text has no ids; bytes that end within a character
decode to U+FFFD where text is asked for; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import carried, mapped, pieces

#: Distinct chunks kept a worker; beyond it the cache starts anew, which changes no result.
CACHE_CHUNKS = 1_000_000
#: Texts whose new chunks go through the library together.
GROUP = 32
MARKS = ".,;:!?"
NEW = b"new"  # what stands for the ids of a chunk that isn't known

OUTPUTS = {
    "n_tokens": "bigint",
    "ids": "array<int>",
    "offsets": "array<int>",
    "chars": "array<int>",
    "ids_sha256": "string",
    "decoded": "binary",
    "decoded_sha256": "string",
}


class Chunks:
    """Encodes texts with a tokenizer of the tokenizers library, each distinct chunk once; ids as 32-bit bytes."""

    def __init__(self, tokenizer, most: int = CACHE_CHUNKS):
        self.tokenizer, self.most = tokenizer, most
        self.first: dict[str, bytes | None] = {}  # chunks at the start of a text
        self.later: dict[str, bytes | None] = {}  # chunks that a space precedes
        self.older: dict[int, dict[str, bytes | None]] = {}
        vocabulary = tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a character for each byte
        self.marks = dict(zip(MARKS, self.whole([*MARKS]), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk with a space before it: one call for all, cut where the tokens' bytes add up."""
        if len(chunks) < 2:
            return self.whole([" " + x for x in chunks])
        packed = self.whole(["".join([" " + x for x in chunks])])[0]
        ends = np.cumsum(self.sizes[np.frombuffer(packed, dtype="<u4")])
        wanted = np.cumsum([len(x.encode("utf-8", "replace")) + 1 for x in chunks])
        cuts = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or (ends[cuts] != wanted).any():
            return self.whole([" " + x for x in chunks])
        cuts = (4 * cuts + 4).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _learn(self, known: dict[str, bytes | None], chunks: set[str], encode) -> None:
        # an empty chunk or white space beside the cut: the text can't be cut there
        new = {x for x in chunks if x not in known}
        safe = {x for x in new if x and not x[0].isspace() and not x[-1].isspace()}
        known.update(dict.fromkeys(new - safe))
        # the pattern always parts a letter from a mark behind it, so such a chunk is its stem and the mark
        marked = {x for x in safe if x[-1] in self.marks and x[-2:-1].isalpha()}
        rest = [*(safe - marked), *(x for x in {x[:-1] for x in marked} if x not in known and x not in safe)]
        known.update(zip(rest, encode(rest), strict=True))
        known.update((x, known[x[:-1]] + self.marks[x[-1]]) for x in marked)

    def _found(self, known: dict[str, bytes | None], chunks: list[list[str]], encode) -> list[list[bytes | None]]:
        """What is known of each chunk of each text, once all new ones have been learned."""
        found = [list(map(known.get, x, itertools.repeat(NEW))) for x in chunks]
        places = [[i for i, ids in enumerate(f) if ids is NEW] for f in found]
        missing = {x[i] for x, at in zip(chunks, places, strict=True) for i in at}
        if not missing:
            return found
        if len(known) + len(missing) > self.most // 2:  # the older half goes
            old = self.older[id(known)] = dict(known)
            known.clear()
        else:
            old = self.older.get(id(known), {})
        if old:
            known.update((x, old[x]) for x in missing if x in old)
        self._learn(known, missing, encode)
        for x, f, at in zip(chunks, found, places, strict=True):
            for i in at:
                f[i] = known[x[i]]
        return found

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        texts = iter(texts)
        while group := list(itertools.islice(texts, GROUP)):
            cut = [x.split(" ") for x in group]
            first = self._found(self.first, [x[:1] for x in cut], self.whole)
            later = self._found(self.later, [x[1:] for x in cut], self.spaced)
            for text, head, rest in zip(group, first, later, strict=True):
                found = head + rest
                yield b"" if not text else self.whole([text])[0] if None in found else b"".join(found)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible in Latin-1, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tokenizer_of(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the tokenizers library that merges the pair with the lowest-ranked union first."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    name = {t: "".join(table[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
        merges += [(name[a], name[b]) for a, b in cuts if a in ranks and b in ranks]
    out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@cache
def loaded(path: str, pattern: str) -> tuple[Chunks, list[bytes]]:
    """Once a worker: the encoder and each id's bytes."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return Chunks(tokenizer_of(ranks, pattern)), table


def decode(ids: Iterable[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def char_starts(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """For each byte offset, the index of the character that holds that byte."""
    if not len(offsets):
        return offsets
    starts = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    return np.cumsum(starts)[offsets] - 1


def outputs(packed: bytes, table: list[bytes], want: tuple[str, ...], decimals: list[bytes]) -> list:
    ids = np.frombuffer(packed, dtype="<u4")
    listed = ids.tolist()
    got: dict = {"n_tokens": len(listed), "ids": ids.astype(np.int32)}
    if "ids_sha256" in want:
        got["ids_sha256"] = hashlib.sha256(b"".join(map(decimals.__getitem__, listed))[:-1]).hexdigest()
    if {"decoded", "decoded_sha256", "chars"} & {*want}:
        got["decoded"] = decode(listed, table)
        got["decoded_sha256"] = hashlib.sha256(got["decoded"]).hexdigest()
    if {"offsets", "chars"} & {*want}:
        sizes = np.fromiter(map(len, map(table.__getitem__, listed)), dtype=np.int64, count=len(listed))
        got["offsets"] = np.cumsum(sizes) - sizes
        if "chars" in want:
            got["chars"] = char_starts(got["decoded"], got["offsets"])
    return [got[x] for x in want]


def _encoded(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, pattern: str, want: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    chunks, table = loaded(path, pattern)
    decimals = [b"%d " % i for i in range(len(table))] if "ids_sha256" in want else []
    for batch in pieces(batches, None, 2_000_000):
        texts = (x.decode("utf-8", "replace") if x else "" for x in batch.column(batch.num_columns - 1).to_pylist())
        rows = [outputs(x, table, want, decimals) for x in chunks.encode(texts)]
        new = [pa.array(c, schema.field(n).type) for n, c in zip(want, zip(*rows, strict=True), strict=True)]
        kept = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*kept, *new], schema=schema)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), want: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """The columns ``keep`` of docs and what ``want`` names of OUTPUTS; path is a file that every executor has."""
    rows = carried(docs, keep)
    schema = StructType([rows.schema[c] for c in keep] + list(StructType.fromDDL(", ".join(f"{w} {OUTPUTS[w]}" for w in want))))
    return mapped(rows, partial(_encoded, schema=to_arrow_schema(schema, prefers_large_types=False), path=path, pattern=pattern, want=want), schema)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    _, table = loaded(path, pattern)
    for batch in batches:
        raw = [None if ids is None else decode(ids, table) for ids in batch.column("ids").to_pylist()]
        texts = [None if x is None else x.decode("utf-8", "replace") for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "decoded", "text"])


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded bytes, text) of rows with doc_id and ids; null ids give nulls."""
    return mapped(encoded.select(F.col("doc_id").cast("bigint"), "ids"), partial(_decoded, path=path, pattern=pattern), "doc_id bigint, decoded binary, text string")
