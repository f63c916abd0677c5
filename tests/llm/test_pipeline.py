from helpers import DOCS, prose
from test_langid import text
from test_linededup import brute as brute_lines
from test_minhash import brute as brute_groups
from test_mixing import waterfill

import corpus_pipeline
from graphloom.llm import langid


def test_stages_match_brute_force(spark, tmp_path):
    passage = text("en", 60, "p")
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        body = text(lang, 20 + i % 50, i)
        if i % 10 == 3:
            body = f"{body}\n{passage}"
        rows.append([i, body, lang, f"s{i % 4}", len(body)])
    rows += [[100, rows[5][1], "fr", "s1", 0], [101, rows[8][1] + " extra", "fr", "s1", 0], [102, None, "en", "s0", None], [103, "123", "en", "s0", 3], [104, "漢字かな交じり文" * 60, "en", None, 0], [105, text("de", 90, 7), None, None, 5]]
    df = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    sf = f"file://{tmp_path}"
    got = corpus_pipeline.run(spark, sf).collect()

    # the same, step by step, without the operators but for the language model
    model = langid.fit(df.where(~langid.held_out()))
    rejected = {r["doc_id"] for r in langid.predict(df, model).where("rejected").collect()}
    assert {102, 103} <= rejected and len(rejected) < 8
    kept = {r[0]: r for r in rows if r[0] not in rejected}
    lines = brute_lines([(i, r[1]) for i, r in kept.items()])
    kept = {i: [i, lines[i], *r[2:]] for i, r in kept.items() if lines[i].strip() or not r[1].strip()}
    groups = brute_groups([(i, r[1]) for i, r in kept.items()], 5)
    kept = {i: r for i, r in kept.items() if groups[i][1] == i}
    sizes = {}
    for r in kept.values():
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    goal = waterfill(sizes)
    assert {r["doc_id"] for r in got} <= kept.keys()
    for source, size in sizes.items():
        rate = goal[source] / size
        for i, r in kept.items():
            if r[3] == source:
                n = sum(g["doc_id"] == i for g in got)
                assert int(rate + 1e-9) <= n <= int(rate + 1e-9) + 1
    import hashlib

    assert all(g["decoded_sha256"] == hashlib.sha256(kept[g["doc_id"]][1].encode()).hexdigest() and g["n_tokens"] == len(g["ids"]) for g in got)
    assert 100 not in {g["doc_id"] for g in got} and passage in kept[3][1] and passage not in kept[13][1]


def test_stages_take_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, prose(60, i), "en", "s", 1, "more") for i in range(30)], DOCS + ", score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == list(corpus_pipeline.COLUMNS)
        assert df.count() > 0
