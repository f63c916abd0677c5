import random
import re
from collections import Counter

import zstandard
from helpers import clashing, docs, prose

from graphloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rng = random.Random(1)
    noise = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=4000))
    texts = [None, "", " \n\t ", prose(300), "spam eggs " * 400, " ".join(noise[i : i + 76] for i in range(0, 4000, 76)), prose(12), "a b c d e f g h i j a b c d e f g h", "x\ny\nx\n x\n\nx", prose(30000, 5), "é|ö <b> " + prose(50), "dup", "dup", "a\x0bb\x0cc\xa0d\x85e\x1cf"]
    got = {r["doc_id"]: r for r in quality.compression_bands(clashing(docs(spark, *texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), i
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (r["reason"] is None) and (not r["kept"] or not r["base_failed"])
    assert got[3]["kept"] and got[9]["kept"] and not got[4]["kept"] and got[5]["reason"] == "incompressible"
    assert got[3]["ratio"] == len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(texts[3].encode())) / len(texts[3].encode())
    assert got[0]["ratio"] is None


def test_a_long_bad_part_is_found_by_chunks(spark):
    mixed = prose(3000, 2) + " " + " ".join(f"{prose(7, 3)} {i}" for i in range(700))
    r = quality.compression_bands(docs(spark, mixed)).first()
    assert r["n_chunks"] > 5 and r["n_chunks_outside"] > 0


def test_random_texts_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "#", "é"], k=rng.randrange(200))) for _ in range(60)]
    for r in quality.compression_bands(docs(spark, *texts)).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])


def brute_verdict(text):
    """The verdict from the tables in the docstring, written apart from the operator."""
    raw = (text or "").encode()
    n_words, *_, repeats = brute(text)
    if n_words < 20 or 100 * repeats > 30 * n_words:
        return "base"
    ratio = lambda x: len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(x)) / len(x)

    def place(x):
        for below, low, high in quality.BANDS:
            if len(x) < below:
                return "repetitive" if ratio(x) < low else "incompressible" if ratio(x) > high else None
        raise AssertionError

    if (verdict := place(raw)) is not None:
        return verdict
    chunks, rest = [], raw
    while rest:
        size = 4096 if len(rest) >= 4096 + 128 else len(rest) if len(rest) <= 4096 or len(rest) < 4096 + 128 else 4096
        chunks.append(rest[:size])
        rest = rest[size:]
    bad = sum(place(x) is not None for x in chunks)
    return "chunks" if bad > (0 if len(chunks) <= 16 else 1 if len(chunks) <= 64 else len(chunks) // 64) else None


def test_verdicts_match_brute_force(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = lambda n: " ".join("".join(rng.choices(letters, k=rng.randrange(1, 76))) for _ in range(n))
    spam = lambda n: " ".join(f"{w} {i}" for i, w in enumerate(["cheap pills here now for you my"] * n))
    texts = [prose(n, n) for n in (1, 5, 20, 21, 25, 30, 50, 90, 200, 500, 600, 601, 900, 3000, 20_000, 60_000)]
    texts += [" ".join("a" * 1 for _ in range(k)) for k in (19, 20, 31, 40)] + [" ".join(rng.choices(letters, k=k)) for k in (20, 25, 40, 60)]
    texts += [noise(n) for n in (20, 40, 300)] + [spam(n) for n in (3, 20, 200)]
    texts += [f"{prose(n, n)} {noise(m)} {prose(n, n + 1)}" for n in (300, 2000, 9000, 30_000) for m in (3, 30, 150, 400)]
    texts += [prose(700, i)[: 4096 + k] for i, k in enumerate((-1, 0, 1, 127, 128, 129))]
    got = {r["doc_id"]: (r["reason"], r["kept"]) for r in quality.compression_bands(docs(spark, *texts)).collect()}
    want = [brute_verdict(t) for t in texts]
    assert got == {i: (v, v is None) for i, v in enumerate(want)}
    assert {"base", "repetitive", "incompressible", "chunks", None} <= {*want}


def test_short_texts_are_judged(spark):
    short = " ".join("abcdefghijklmnopqrstu")  # 20 and more words in 41 bytes
    same = "ab cd " * 11
    got = {r["doc_id"]: r for r in quality.compression_bands(docs(spark, short, same, None, "")).collect()}
    assert got[0]["kept"] and not got[0]["base_failed"]
    assert not got[1]["kept"] and got[1]["n_chunks_outside"] == 1 and got[2]["n_chunks"] == got[3]["n_chunks"] == 0


def test_empty_table(spark):
    assert quality.compression_bands(docs(spark, "x").where("false")).count() == 0
