import random

import numpy as np
from helpers import DOCS, clashing

from graphloom.llm import langid

SYLLABLES = {"en": "the ing and tion er on".split(), "de": "sch ung keit ein lich der".split(), "fr": "eau eux ment que oi elle".split()}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def table(spark, more=()):
    rows = [(i, text(lang, 5 + i % 60, i), lang, "s", 0) for i in range(240) for lang in [list(SYLLABLES)[i % 3]]]
    return spark.createDataFrame(rows + list(more), DOCS)


def test_held_out_accuracy_and_edges(spark):
    odd = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !!", "de", "s", 0), (903, "漢字かな交じり文" * 60, None, "s", 0), (904, text("de", 20000, 1), None, "s", 0), (905, text("fr", 30, 2), "", "s", 0), (None, text("fr", 30, 3), "fr", "s", 0), (7, text("fr", 9, 4), None, "s", 0)]
    df = clashing(table(spark, odd)).withColumn("held_out", langid.held_out())
    model = langid.fit(df.where("not held_out and coalesce(doc_id, 0) < 900"))
    assert model.languages == ["de", "en", "fr"] and len(model.centroids) == 3 * langid.CENTROIDS
    got = {(r["doc_id"], r["lang"]): r for r in langid.predict(df, model, ("doc_id", "lang", "held_out")).collect()}
    assert len(got) == 248
    plain = [r for (i, lang), r in got.items() if i is not None and i < 240 and lang]
    assert np.mean([r["lang"] == r["lang_pred"] for r in plain if r["held_out"]]) > 0.97
    assert not any(r["rejected"] for r in plain)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i, lang in ((900, "en"), (901, "en"), (902, "de")):
        r = got[i, lang]
        assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert got[903, None]["rejected"] and got[904, None]["lang_pred"] == "de" and got[None, "fr"]["lang_pred"] == "fr"


def test_only_the_text_counts(spark):
    df = table(spark)
    model = langid.fit(df)
    from pyspark.sql import functions as F

    moved = df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(moved, model).collect()}


def test_nothing_to_learn(spark):
    df = table(spark)
    model = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}
    assert langid.predict(df.where("false"), langid.fit(df)).count() == 0


def test_nearest_centroid_is_what_it_says(spark):
    df = table(spark)
    model = langid.fit(df)
    for i in (0, 1, 2):
        lang = list(SYLLABLES)[i]
        c = langid.counts(text(lang, 5 + i % 60, i))
        v = np.log1p(c) * model.idf
        v /= np.linalg.norm(v)
        best = max(range(len(model.owner)), key=lambda k: float(v @ model.centroids[k]))
        r = langid.predict(df.where(f"doc_id = {i}"), model).first()
        assert r["lang_pred"] == model.languages[model.owner[best]]


def test_repeated_rows_are_one_row_of_the_sample(spark):
    same = [(7, text("de", 30, 1), "de", "s", 0)] * 1000
    for i in range(6):
        model = langid.fit(spark.createDataFrame([(i, *r[1:]) for r in same] + [(50 + k, text("fr", 30, k), "fr", "s", 0) for k in range(30)], DOCS))
        assert model.languages == ["de", "fr"] and (model.owner == 0).sum() == 1
    only = langid.fit(spark.createDataFrame(same, DOCS))
    assert only.languages == ["de"] and langid.predict(spark.createDataFrame(same[:3], DOCS), only).first()["lang_pred"] == "de"
    assert langid.fit(spark.createDataFrame([(1, "12 34", "de", "s", 0)] * 5, DOCS)).languages == []


def test_many_languages(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03d}": ["".join(rng.choices(letters, k=6)) for _ in range(4)] for i in range(300)}
    rows = [(k * 300 + i, " ".join(rng.choices(w, k=20)), lang, "s", 0) for i, (lang, w) in enumerate(words.items()) for k in range(3)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    assert len(model.languages) == 300
    got = langid.predict(spark.createDataFrame(rows, DOCS), model, ("lang",)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_partitions_do_not_matter_and_names_may_clash(spark):
    df = clashing(table(spark))
    one, two = langid.fit(df.repartition(1)), langid.fit(df.repartition(7))
    assert one.languages == two.languages and np.allclose(one.centroids, two.centroids) and one.limits == two.limits
    got = langid.predict(df, one, ("doc_id", "_text", "key")).collect()
    assert {(r["_text"], r["key"]) for r in got} == {("x", "x")} and len(got) == 240


def brute(rows, model_rows, n_centroids):
    """TF-IDF vectors of byte n-grams in plain Python, clustered and compared as the words of the module say."""
    import math

    def grams(t):
        b = [x + 32 if 65 <= x <= 90 else x for x in (" " + t.lower() + " ").encode()]
        b = [x if x >= 128 or 97 <= x <= 122 else 32 for x in b]
        out = {}
        for two in zip(b, b[1:], strict=False):
            if two != (32, 32):
                cell = ((two[0] << 8 | two[1]) * 2654435761 & 0xFFFFFFFF) >> 20
                out[cell] = out.get(cell, 0) + 1
        for three in zip(b, b[1:], b[2:], strict=False):
            if three[1:] != (32, 32):
                cell = ((three[0] << 16 | three[1] << 8 | three[2]) * 2246822519 & 0xFFFFFFFF) >> 20
                out[cell] = out.get(cell, 0) + 1
        return out

    seen = {}
    for _, t, _ in model_rows:
        for cell in grams(t):
            seen[cell] = seen.get(cell, 0) + 1
    idf = lambda cell: math.log((1 + len(model_rows)) / (1 + seen.get(cell, 0))) + 1

    def vector(t):
        v = np.zeros(4096)
        for cell, n in grams(t).items():
            v[cell] = math.log1p(n) * idf(cell)
        return v / np.linalg.norm(v)

    centroids = []
    for lang in sorted({x for _, _, x in model_rows}):
        members = sorted(((sum(grams(t).values()), t) for _, t, x in model_rows if x == lang), key=lambda m: m[0])
        vs = np.stack([vector(t) for _, t in members])
        centroids.append((lang, langid.cluster(vs, n_centroids)))
    out = {}
    for i, t, _ in rows:
        v = vector(t)
        out[i] = max(centroids, key=lambda c: float((c[1] @ v).max()))[0]
    return out


def test_matches_brute_force(spark):
    """One centroid a language, so that no order of equal starts can matter: predictions equal plain Python's."""
    rows = [(i, text(lang, 5 + i % 40, i), lang) for i in range(120) for lang in [list(SYLLABLES)[i % 3]]]
    held = langid.CENTROIDS
    try:
        langid.CENTROIDS = 1
        model = langid.fit(spark.createDataFrame([(*r, "s", 0) for r in rows], DOCS))
    finally:
        langid.CENTROIDS = held
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(*r, "s", 0) for r in rows], DOCS), model).collect()}
    assert got == brute(rows, rows, 1)
