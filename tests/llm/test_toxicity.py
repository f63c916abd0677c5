import random

import numpy as np
from helpers import DOCS, clashing, prose

from graphloom.llm import toxicity

INSULTS = ("idiot", "moron", "scumbag", "pathetic", "worthless")


def table(spark, n=400):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.randrange(5, 80), i).split()
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words) + ".", "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def auc(scores, y):
    p, n = scores[y == 1], scores[y == 0]
    return np.mean([(a > n).mean() + (a == n).mean() / 2 for a in p])


def test_held_out_accuracy_and_variants(spark):
    docs, labels = table(spark)
    model = toxicity.fit(clashing(docs), labels.where("doc_id % 5 <> 0"))
    got = toxicity.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.doc_id % 5 == 0]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.97
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.97
    clean = prose(40, 999)
    texts = [f"{clean} {x} {clean}" for x in ("idiot", "id-iot", "i.d.i.o.t", "i d i o t", "idiiot", "IDIOT!")] + [clean]
    more = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)] + [(10, None, None, None, 0), (11, "", None, None, 0), (12, clean * 300, None, None, 0), (12, clean * 300, None, None, 0), (None, "x" * 100_000, None, None, 0)], DOCS)
    s = [(r["doc_id"], r["score"]) for r in toxicity.score(more, model).collect()]
    by = dict(s)
    assert len(s) == 12 and all(0 <= x <= 1 for _, x in s)
    assert all(by[i] >= 0.5 for i in range(6)) and by[6] < 0.5 and by[12] < 0.5
    assert by[10] == by[11] == model.prior


def test_kernel_is_what_it_says():
    def explicit(a, b):
        def f(w):
            w, out = f"\x02{w}\x03", {}
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + toxicity.SPAN)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        key = w[i] + w[j] + w[k]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
            return out

        x, y = f(a), f(b)
        return sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    words = ["idiot", "idxiot", "trash", "tree", "pathetic"]
    table = toxicity.columns(words)
    k = toxicity.kernel_rows(words, table)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(k[i, j] - explicit(a, b)) < 0.06, (a, b)
    assert k[0, 1] > 0.4 > k[0, 2]


def test_nothing_to_learn(spark):
    docs, labels = table(spark, 20)
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.selectExpr("doc_id", "quality", "cast(null as int) toxic")):
        model = toxicity.fit(docs, some)
        assert {r["score"] for r in toxicity.score(docs, model).collect()} == {model.prior}
    assert toxicity.score(docs.where("false"), toxicity.Model()).count() == 0


def test_marks_are_read_once():
    import time

    began = time.perf_counter()
    assert "ab" in toxicity.words_of("_" * 10_000 + "ab")
    for x in ("_" * 60 + "word", "a " * 50_000 + "bb", "a_" * 50_000 + "bb", "a" + " " * 100_000 + "bc", ". - " * 20_000 + "x", "é_" * 30_000):
        toxicity.words_of(x)
    assert time.perf_counter() - began < 1
    assert "idiot" in toxicity.words_of("an i d i o t, really") and "idiot" in toxicity.words_of("x (i.d.i.o.t)")
    assert "ab" not in toxicity.words_of("a b")


def test_machine_is_a_kernel_machine(spark):
    """Newton's sums over executors give what a dense solver gives on the same examples, for 200 words."""
    rng = random.Random(6)
    clean = sorted({prose(1, i) for i in range(400)})[:180]
    words = [(w, -1.0, 0.0, float(rng.randrange(1, 9))) for w in clean] + [(w + "x" * k, 1.0, 30.0 + i, 0.0) for i, w in enumerate(INSULTS) for k in range(4)]
    df = spark.createDataFrame(words, "word string, y double, evidence double, clean double").repartition(3)
    cells, bias = toxicity.machine(df)
    chosen, strongest = toxicity.landmarks(df)
    table = toxicity.columns(chosen)
    values, vectors = np.linalg.eigh((table.T @ table).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    examples = [(w, y, np.sqrt(e)) for w, y, e, _ in words]
    scale = 0.3 * 180 / sum(s for _, y, s in examples if y > 0)
    rows = [(w, y, scale * s if y > 0 else 1.0) for w, y, s in examples]
    rows += [(v, 1.0, scale * np.sqrt(e) / 2) for w, e in strongest for k in [len(w) // 2] for v in (w[:k] + w[k - 1] + w[k:], w[:k] + "x" + w[k:])]
    x = np.c_[toxicity.kernel_rows([r[0] for r in rows], table) @ root, np.ones(len(rows))]
    y, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    ridge = np.r_[np.full(x.shape[1] - 1, 1e-2 * 1.3 * 180 / len(rows)), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(100):  # the same objective, step by step
        inside = y * (x @ w) < 1
        new = np.linalg.solve((x[inside] * c[inside][:, None]).T @ x[inside] + np.diag(ridge), x[inside].T @ (c * y)[inside])
        if np.allclose(new, w):
            break
        w = new
    model = toxicity.Model(cells=cells, bias=bias)
    some = [r[0] for r in rows]
    assert np.abs(model.words(some) - (toxicity.kernel_rows(some, table) @ root @ w[:-1] + w[-1])).max() < 0.05


def test_names_may_clash(spark):
    docs, labels = table(spark, 100)
    model = toxicity.fit(clashing(docs), clashing(labels))
    got = toxicity.score(clashing(docs), model, ("doc_id", "_text", "kept")).collect()
    assert len(got) == 100 and {(r["_text"], r["kept"]) for r in got} == {("x", "x")}
