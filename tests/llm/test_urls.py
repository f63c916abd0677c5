import random

import duckdb
from graphs_llm import brute_components
from helpers import clashing

from graphloom.llm import common, urls

SCHEMA = "page_id bigint, url string, html string"
CANON = '<html><link rel="canonical" href="{}"></html>'
REFRESH = '<META HTTP-EQUIV="Refresh" CONTENT="0; URL={}">'


def pages(spark):
    x = "https://{}"
    rows = [
        ("http://Shop.Example.COM/en/a", ""), ("http://www.example.com/en/a", ""), ("http://sub.www.example.com/en/", ""), ("http://example.com/de", ""),
        ("http://example.com", ""), ("http://a.net/es/1?x#y", ""), ("http://net/fr/", ""), ("http://a.net/de/", ""), ("nothing", ""), (None, ""), ("", None),
        # an alias of a blocked page, by a canonical link; and one of that alias, by a redirect
        (x.format("a.org/1"), CANON.format("http://b.net/fr/9")), (x.format("a.org/2"), REFRESH.format("/1")),
        # a class with a block and an explicit allow
        (x.format("c.org/1"), CANON.format("http://b.net/es/2")), (x.format("c.org/2"), CANON.format("https://c.org/1")), (x.format("c.org/2"), REFRESH.format("http://www.example.com/en/z")),
        # an allow of its own outlives a blocked class
        ("http://www.example.com/en/own", CANON.format("http://b.net/fr/10")),
        (x.format("d.org/dir/p"), CANON.format("q")), (x.format("d.org/x"), "<link rel=canonical>"), (x.format("e.org"), CANON.format("//f.org/y")), ("HTTP://UP.net/ES/", ""), (x.format("a.org/1"), ""),
    ]
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA)


def test_verdicts(spark):
    got = {r["page_id"]: r for r in urls.filter_urls(clashing(pages(spark))).collect()}
    assert len(got) == 22
    wanted = ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", None, "net/es/", "net/fr/", None, None, None, None]
    assert [got[i]["rule"] for i in range(11)] == wanted
    assert [got[i]["verdict"] for i in range(11)] == ["block", "allow", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (got[0]["host"], got[0]["path"], got[4]["path"], got[5]["path"]) == ("shop.example.com", "/en/a", "", "/es/1")
    assert (got[8]["host"], got[8]["path"], got[9]["host"]) == ("", "", "")
    assert [got[i]["verdict"] for i in (11, 12, 13, 14, 15, 16)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert got[11]["reason"] == "class" and got[16]["reason"] == "rule" and got[21]["verdict"] == "block"
    assert got[17]["component"] == "d.org/dir/p" and got[18]["component"] is None and got[20]["verdict"] == "allow"
    assert urls.filter_urls(pages(spark).where("false")).count() == 0


def test_matches_sql_where_targets_are_whole(spark):
    df = pages(spark).where("page_id not in (12, 17, 19)")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [tuple(r) for r in df.collect()])
    got = urls.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(urls.ORACLE).fetchall()))


def test_components_match_brute_force(spark):
    rng = random.Random(8)
    for n, m in ((40, 30), (60, 58)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(500 + i, 501 + i) for i in range(70)] + [(900, 900 + i) for i in range(60)]
        got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == {k: v for k, v in brute_components(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
