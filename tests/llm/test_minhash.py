import random

import numpy as np
from graphs_llm import brute_components
from helpers import DOCS, clashing, docs, prose

from graphloom.llm import minhash


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k=4):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = brute_components(links)
    return {i: (len(s), roots.get(i, i)) for i, s in sets.items()}


def corpus():
    rng = random.Random(11)
    out = []
    for g in range(25):
        words = prose(rng.choice([8, 40, 150, 400]), g).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(words)
            for _ in range(rng.randrange(0, 2 + len(words) // 60)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def result(df, k=4):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k).collect()}


def test_matches_brute_force(spark):
    texts = corpus() + [None, "", " \n", "one", "ONE", "one two three", "one two three", "é É", "É é", "A\x0bb c\td", "a b C d"]
    assert result(clashing(docs(spark, *texts)).repartition(3)) == brute(list(enumerate(texts)))


def test_many_near_copies_make_one_component(spark):
    rng = random.Random(12)
    base = prose(120, 1).split()
    texts = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(copy))
    got = result(docs(spark, *texts, prose(100, 2)))
    assert {c for _, c in got.values()} == {0, 400}


def test_a_chain_is_one_component(spark):
    words = prose(200, 3).split()
    texts = [" ".join(words[i * 6 : i * 6 + 100]) for i in range(12)]
    assert result(docs(spark, *texts)) == brute(list(enumerate(texts)))


def test_repeated_ids_and_empty(spark):
    a, b = prose(50, 1), prose(50, 2)
    rows = [(3, a, None, None, 0), (3, a, None, None, 0), (1, b, None, None, 0), (3, b, None, None, 0), (None, a, None, None, 0), (7, a, None, None, 0)]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, True)] * 2 + [(3, 1, False), (1, 1, True), (None, None, True), (7, 3, False)], key=str)
    assert minhash.near_duplicates(docs(spark, "x").where("false")).count() == 0
    left = minhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS), 4)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("3", a), ("3", a), ("1", b), ("None", a)]) and left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_neighbours_hold_all_of_a_small_region():
    rng = np.random.default_rng(0)
    n = 60
    keys = np.sort(rng.integers(0, 20, n))
    import pyarrow as pa

    columns = {"tree": np.zeros(n, dtype=np.int32), "k0": keys, "k1": keys * 0, "k2": np.sort(rng.integers(0, 9, n)), "k3": keys * 0, "tail": np.arange(n), "id": np.arange(n), "n_shingles": np.full(n, 10)}
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    whole = [(a, b) for x in minhash._neighbours(iter([batch]), 80, False) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
    cut = [(a, b) for x in minhash._neighbours(iter([batch.slice(i, 7) for i in range(0, n, 7)]), 80, False) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
    assert sorted(whole) == sorted(cut)
    for a in range(n):
        for b in range(a):
            if keys[a] == keys[b] and (keys == keys[a]).sum() <= minhash.NEIGHBOURS + 1:
                assert (a, b) in whole


def test_a_crowd_that_borders_cut_is_whole(spark):
    rng, n = np.random.default_rng(6), 12
    values = rng.integers(0, 1 << 32, (n, minhash.VALUES), dtype=np.uint32)
    values[:, : minhash.DEPTH] = 7  # one region in the first tree, none in the others
    classes = spark.createDataFrame([(i, 50, v.tobytes()) for i, v in enumerate(values)], "id bigint, n_shingles bigint, signature binary")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "80")  # about 3 of 240 rows a range
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        _, crowds = minhash.candidates(classes)
        assert {r["id"] for r in crowds.collect()} == set(range(n))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_a_region_of_unlinked_boilerplate(spark):
    """Rows that share a long passage, and so common prefixes, but mostly aren't similar: links equal brute force."""
    rng = random.Random(31)
    passage = prose(120, 1).split()
    texts = []
    for i in range(400):
        own = prose(rng.choice([45, 60, 90]), 5000 + i).split()
        texts.append(" ".join(passage + own))
        if i % 20 == 0:  # a near copy of this one
            own[rng.randrange(len(own))] = f"z{i}"
            texts.append(" ".join(passage + own))
    want = brute(list(enumerate(texts)))
    assert result(docs(spark, *texts)) == want
    assert len({c for _, c in want.values()}) == 400


def test_crowds_beyond_a_tile_equal_brute_force(spark, monkeypatch):
    """Rows that differ in a tenth to half of their words: those with rare shingles meet by these, others in tiles."""
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = random.Random(41)
    texts = []
    for g in range(3):
        passage = prose(100, g).split()
        for i in range(50):
            own = prose(rng.choice([8, 13, 16, 20, 40, 90]), 900 + 100 * g + i // 2).split()
            own[rng.randrange(len(own))] = f"z{i}"
            texts.append(" ".join(passage + own if i % 3 else own + passage))
    want = brute(list(enumerate(texts)))
    assert result(docs(spark, *texts)) == want
    crowded = spark.createDataFrame([(g, 50 * g + i) for g in range(3) for i in range(50)], "region bigint, id bigint")
    rows = docs(spark, *texts).selectExpr("doc_id AS id", "CAST(text AS binary) AS text")
    nothing = spark.createDataFrame([], "node bigint, component bigint")
    links = {(r["a"], r["b"]) for r in minhash.crowd_links(crowded, rows, nothing, 4, 80).collect()}
    sets = [shingles(t, 4) for t in texts]
    every = {(a, b) for g in range(3) for a in range(50 * g, 50 * g + 50) for b in range(50 * g, a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links == every


def test_very_long_texts(spark):
    long = prose(60_000, 2).split()
    near = list(long)
    near[30_000] = "changed"
    got = result(docs(spark, " ".join(long), " ".join(near), " ".join(long[:40_000])))
    assert [got[i][1] for i in range(3)] == [0, 0, 2]
