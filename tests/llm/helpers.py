"""What the tests of the corpus operators share."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, *texts, lang="en", source="s"):
    """documents with ids from 0 on."""
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def clashing(df):
    """df with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for name in ("id", "score", "kept", "component", "node", "a", "b", "n", "key", "size", "tie", "first", "last", "runs", "label_", "_text", "rate", "weight"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))
