import random
from collections import Counter

import duckdb
import pytest
from helpers import DOCS, clashing, prose

from graphloom.llm import mixing


def waterfill(sizes):
    """Targets by source, as the words say it: raise all by weight, stop each at three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        free = total - sum(3 * sizes[s] for s in full)
        goal = {s: free * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if goal[s] > 3 * sizes[s]}
        if not over:
            return goal | {s: 3.0 * sizes[s] for s in full}
        full |= over


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng.choice([3, 10, 40]), i), "en", rng.choice(["big"] * 12 + ["a", "b", "c", "é", "", None]), 0) for i in range(600)]
    return out + [(600, None, None, "a", None), (601, "", None, "void", 0), (None, "w w", None, "b", 0), (5, "again", "en", "big", 0)]


def test_targets_and_takes(spark, rows):
    docs = clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    wanted = waterfill(sizes)
    assert abs(sum(wanted.values()) - sum(sizes.values())) < 1e-6
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - wanted[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["n_copies"]
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert abs(taken["big"] - wanted["big"]) < 0.2 * wanted["big"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))


def test_matches_sql(spark, rows):
    table = [r for r in rows if r[0] is not None and r[0] != 5]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", table)
    wanted = {r[0]: r[1:] for r in con.sql(mixing.ORACLE).fetchall()}
    for r in mixing.plan(spark.createDataFrame(table, DOCS)).collect():
        size, source_size, target, taken = wanted[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (size, source_size, taken) and abs(r["target"] - target) < 1e-9


def test_emits_copies(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    plan = Counter({(r["doc_id"], r["source"], r["size"]): r["n_copies"] for r in mixing.plan(docs).collect() if r["n_copies"]})
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixing.mix(docs).collect())
    assert got == plan


def test_names_may_clash(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("n_copies", "_key", "_mix", "_copy", "row", "copy", "size", "rate"):
        docs = docs.selectExpr("*", f"'mine' AS `{name}`")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert {(r["n_copies"], r["_key"], r["_mix"], r["_copy"], r["row"]) for r in got.collect()} == {("mine",) * 5}


def test_repeated_and_very_long_rows(spark):
    long = prose(300_000, 1)
    rows = [(1, long, "en", "a", 0)] + [(2, "one two", "en", "b", 0)] * 50
    got = mixing.plan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 51 and {r["size"] for r in got if r["source"] == "a"} == {300_000}
    assert len({r["taken"] for r in got if r["source"] == "b"}) == 1  # repeated rows share a coin


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, "a", 0)], DOCS)
    assert [r["taken"] for r in mixing.plan(nothing).collect()] == [0, 0]
    one = spark.createDataFrame([(1, "a b", None, None, 0)], DOCS)
    assert mixing.plan(one).first()["taken"] == 2
