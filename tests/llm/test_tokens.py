import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
import zstandard
from helpers import clashing, docs, prose

from graphloom.llm import bpe, token_files
from graphloom.llm.common import new_path
from graphloom.llm.queries import pattern, tokenizer_path

ODD = ["", " ", "a ", " a", "a  b", "a\n b", "a \n", "don't stop", "x\x1cy \x85z", "é漢字😀 ﻿ ​", "<|endoftext|> end", "1²½ ٣", "tab\tt", "\r\n\r\n", "a.b. c,d", "...", " .", "A" * 5000, "é " * 3000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = ["".join(rng.choices("ab Z.,'!\n\t \x0b\x1c\x85\xa0é漢😀1²d's|#", k=rng.randrange(50))) for _ in range(300)]
    return ODD + odd + [prose(400, i) for i in range(5)]


@pytest.fixture(scope="module")
def expected(texts):
    ranks = bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    return [enc.encode_ordinary(t) for t in texts]


def test_ids_and_decoding(spark, texts, expected):
    want = ("n_tokens", "ids", "offsets", "chars", "ids_sha256", "decoded_sha256")
    got = bpe.encode(clashing(docs(spark, *texts, None)), tokenizer_path("byte_bpe_50k.tiktoken"), pattern(), want=want)
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, (text, ids) in enumerate(zip([*texts, ""], [*expected, []], strict=True)):
        r = rows[i]
        assert list(r["ids"]) == ids, repr(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert len(r["offsets"]) == len(ids) and all(a < b for a, b in zip(r["offsets"], r["offsets"][1:], strict=False))
        raw = text.encode()
        assert list(r["chars"]) == [len(raw[:o].decode("utf-8", "ignore")) for o in r["offsets"]]
    back = bpe.decode_ids(got.select("doc_id", "ids"), tokenizer_path("byte_bpe_50k.tiktoken"), pattern())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate([*texts, ""]))


def test_a_full_cache_changes_nothing(texts, expected):
    whole, _ = bpe.loaded(tokenizer_path("byte_bpe_50k.tiktoken"), pattern())
    tiny = bpe.Chunks(whole.tokenizer, most=40)
    assert [np.frombuffer(x, "<u4").tolist() for x in tiny.encode(texts)] == expected


def test_split_characters(spark):
    rows = spark.createDataFrame([(1, [10263]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode_ids(rows, tokenizer_path("byte_bpe_50k.tiktoken"), pattern()).collect()}
    assert got[2] is None and got[3] == "" and isinstance(got[1], str)


@pytest.fixture(scope="module")
def plain(texts):
    """Ids of the tokenizer's file by the library alone, as it is loaded; strings of special tokens are those tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_are_those_of_the_plain_library(plain, texts):
    rng = random.Random(8)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    more = ["".join(rng.choices(["<|endoftext|>", " ", "a", "b.", "\n", "<|", "é"], k=rng.randrange(12))) for _ in range(400)]
    chunks = token_files.loaded(tokenizer_path("byte_bpe_50k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in chunks.encode(texts + more)]
    assert got == plain + [tokenizer.encode(t, add_special_tokens=False).ids for t in more]
    assert sum("<|endoftext|>" in t for t in more) > 100


def test_files_hold_all_ids(spark, texts, plain):
    rows = [(i * 3, t, None, None, 0) for i, t in enumerate(texts)] + [(1, None, None, None, 0)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5))
    got = token_files.round_trip(df, tokenizer_path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    ids = {i * 3: x for i, x in enumerate(plain)} | {1: []}
    start = 0
    assert [r["doc_id"] for r in got] == sorted(ids)
    for r in got:
        packed = np.array([*ids[r["doc_id"]], 0], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(packed), zlib.crc32(packed.tobytes()))
        start += len(packed)
    assert token_files.round_trip(df.where("false"), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_only_wanted_documents_are_decompressed(spark):
    path = new_path(spark, "tokens")
    token_files.write(docs(spark, *[prose(200, i) for i in range(40)]), path, tokenizer_path("byte_bpe_50k.json"), file_bytes=0)
    some = token_files.read(spark, path, frozenset({7, 31}))
    assert {r["doc_id"] for r in some.collect()} == {7, 31}
    every = {r["file"] for r in token_files.read(spark, path).collect()}
    assert len(every) > 2 and len(some.inputFiles()) <= 2  # files without wanted documents aren't opened
    assert token_files.read(spark, path, frozenset({99})).count() == 0


def test_starts_of_very_many_files(spark):
    """More files than a task's names keep in order: c1000 sorts before c101."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        words = [prose(1 + i % 7, i) for i in range(1200)]
        got = token_files.round_trip(docs(spark, *words), tokenizer_path("byte_bpe_50k.json"), file_bytes=0).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len({(r["part"], r["number"]) for r in got}) == 1200
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_repeated_and_null_ids_and_long_texts(spark):
    from tokenizers import Tokenizer

    long = prose(200_000, 3)
    rows = [(None, "x"), (None, None), (5, "b c"), (5, "b c"), (5, "a"), (5, None), (-7, long), (9, "")]
    got = token_files.round_trip(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer_path("byte_bpe_50k.json")).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), count(t)) for i, t in rows)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None, None, -7, 5, 5, 5, 5, 9]
    ends = [r["start"] + r["n_tokens"] for r in ordered]
    assert [r["start"] for r in ordered] == [0, *ends[:-1]]


def test_file_format():
    builder = token_files.FileBuilder()
    rng = np.random.default_rng(0)
    made = [(i, rng.integers(0, 50000, n).astype("<u4").tobytes()) for i, n in enumerate([0, 5, 100_000, 3, 70_000, 1])]
    for i, ids in made:
        builder.add(i, ids)
    raw = builder.body() + token_files.TAIL.encode("latin-1")
    file = token_files.TokenFile(raw)
    assert len(file.entries) > 1
    assert [(d, x) for d, _, x in file.documents()] == made
    # any reader of zstandard gets the ids one after another
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(x for _, x in made)
    opened = []
    file.frame = lambda k, f=file.frame: opened.append(k) or f(k)
    assert [x for _, _, x in file.documents({5})] == [made[5][1]] and len(opened) == 1
    broken = bytearray(raw)
    broken[len(raw) - 9 - 12] ^= 1  # a compressed size
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.TokenFile(bytes(broken)).documents())
    check = bytearray(raw)
    check[len(raw) - 9 - 1] ^= 1  # the last frame's checksum
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.TokenFile(bytes(check)).documents())
