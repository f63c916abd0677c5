import random
import re

import duckdb
from helpers import DOCS, clashing, docs, prose

from graphloom.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """From the definition: all runs of lines of any length against all earlier ones, in the order of rows."""
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n")
        units = [(i, x.strip(" \t\v\f\r")) for i, x in enumerate(lines) if WORD.search(x)]
        words = [len(WORD.findall(x)) for _, x in units]
        gone = set()
        for s in range(len(units)):
            for e in range(s + 1, len(units) + 1):
                if e - s < 4 and sum(words[s:e]) < 50:
                    continue
                key = tuple(x for _, x in units[s:e])
                a, b = units[s][0], units[e - 1][0]
                d0, b0 = first.setdefault(key, (doc, b))
                if d0 != doc or b0 < a:
                    gone.update(range(a, b + 1))
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def lefts(df):
    return {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}


def corpus():
    rng = random.Random(9)
    shared = [prose(rng.choice([3, 12, 30, 60, 80]), 100 + i) for i in range(12)]
    out = []
    for i in range(80):
        lines = []
        while len(lines) < rng.randrange(2, 12):
            k = rng.randrange(len(shared))
            lines += shared[k : k + rng.randrange(1, 6)] if rng.random() < 0.5 else [prose(rng.randrange(1, 40), 1000 + rng.randrange(10**6))]
            if rng.random() < 0.2:
                lines.append("  ")
        out.append("\n".join(lines))
    return out + ["same\n" * 9, "a\nb\n" * 6, "", "\n\n", prose(20000, 3)]


def test_matches_brute_force(spark):
    texts = corpus()
    assert lefts(clashing(docs(spark, *texts)).repartition(3)) == brute(list(enumerate(texts)))


def test_matches_sql(spark):
    from pyspark.sql import functions as F

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(corpus())))
    out = linededup.dedup_lines(docs(spark, *corpus()))
    got = out.select("doc_id", "n_lines", "n_deleted", F.length("text"), F.md5("text")).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(linededup.ORACLE).fetchall())


def test_a_shared_passage_stays_once_whatever_is_around_it(spark):
    passage = prose(60, 1)
    texts = [f"{prose(9, 10 + i)}\n{passage}\n{prose(8, 50 + i)}" for i in range(50)]
    got = lefts(docs(spark, *texts))
    assert passage in got[0] and not any(passage in got[i] for i in range(1, 50))
    assert all(got[i].count("\n") == 1 for i in range(1, 50))


def test_edges(spark):
    long = "\n".join([prose(55, 7), prose(3, 8)])
    rows = [(1, None, None, None, 0), (2, long, "en", "s", 0), (2, long, "en", "s", 0), (None, long, "en", "s", 0), (3, "  " + long.replace("\n", " \r\n\n"), None, None, 0), (4, "short\nline", "en", None, 0), (5, "short\nline", "en", None, 0)]
    got = [(r["doc_id"], r["text"], r["n_deleted"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()]
    by = {d: [x[1:] for x in got if x[0] == d] for d in {x[0] for x in got}}
    assert by[None] == [(long, 0)]  # null ids come first
    assert by[2] == [("", 2)] * 2 and by[1] == [(None, 0)]  # the run's short last line, too
    assert by[4] == by[5] == [("short\nline", 0)]
    assert by[3][0][1] == 2
    assert linededup.dedup_lines(docs(spark, "x").where("false")).count() == 0


def test_a_match_ends_where_the_equal_lines_end(spark):
    head, tail, other = prose(60, 1), prose(10, 2), prose(12, 3)
    texts = [f"{head}\n{other}", f"{head}\n{tail}", f"{prose(5, 4)}\n{head}\n{tail}\n{prose(5, 5)}"]
    got = lefts(docs(spark, *texts))
    # the second text's run ends before its tail, the third's has an earlier copy with the tail, though not the first copy
    assert got[1] == tail and got[2] == f"{prose(5, 4)}\n{prose(5, 5)}"


def test_every_repeated_window_shares_a_fingerprint():
    a, b = "\n".join(prose(n, n) for n in (30, 31, 32, 3, 4, 60, 5)), prose(5, 99)
    left = linededup.fingerprints(f"{b}\n{a}\n{b}".encode())
    right = linededup.fingerprints(a.encode())
    assert {f[0] for f in right} <= {f[0] for f in left}
    lines = [x for _, x in linededup.units(a.encode())]
    assert len(right) < len(lines)  # fewer positions than lines

    def runs(found):
        return {hashes[16 * r : 16 * e] for _, _, hashes, spans in found for r, e in zip(spans[::2], spans[1::2], strict=True)}

    shared = runs(right) & runs(left)
    assert shared and all(len(x) % 16 == 0 for x in shared)


def test_without_fingerprints_nothing_is_found(spark, monkeypatch):
    """Rows come through the selected lines: positions chosen by their place instead of by hash lose matches."""
    passage = "\n".join(prose(20, 70 + i) for i in range(3))
    texts = ["\n".join([*(prose(9, 1000 * i + k) for k in range(i % 5)), passage, prose(8, 50 + i)]) for i in range(30)]
    found = [{h for h, *_ in linededup.fingerprints(t.encode())} for t in texts]
    assert all(found[0] & f for f in found)
    by_place = lambda hashes, ends: [i - i % 3 for i in range(len(ends))]
    monkeypatch.setattr(linededup, "selected", by_place)
    found = [{h for h, *_ in linededup.fingerprints(t.encode())} for t in texts]
    assert not all(found[0] & f for f in found)


def test_hot_passages_are_dealt_apart(spark, monkeypatch):
    from graphloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    passage = "\n".join(prose(20, 70 + i) for i in range(3))
    texts = [f"{prose(9, i)}\n{passage}\n{prose(8, 500 + i)}" for i in range(60)] + corpus()
    assert lefts(docs(spark, *texts)) == brute(list(enumerate(texts)))
