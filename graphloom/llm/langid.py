"""Language ID by nearest centroid.

A text becomes counts of hashed byte bigrams and trigrams of its lower-cased letters, damped, weighted by inverse
document frequency and normalised. Each language has several centroids, clustered by cosine from a bounded sample of
labelled rows; the nearest centroid names the language. A text too far from every centroid for its length is
rejected: the limit is a part of the similarity that labelled texts of that length reach.

Fitting reads labels of the given rows alone. Document frequencies are counted over all of those rows, by executors;
the sample has at most SAMPLE_ROWS rows over all languages, those with the least hashes of id and text in each, and one
of each language at least. Prediction is one pass over whole texts, without a shuffle; the model is a few hundred kB.

Defined results: a null text or one without letters is ``und`` with score 0 and counts as rejected; with no labelled
rows every text is ``und``; ties go to the language that sorts first; repeated rows are judged alike, and are one row of
the sample; of more than SAMPLE_ROWS languages the commonest SAMPLE_ROWS are learned; further columns are not read,
whatever their names, and ``keep`` may name any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, mapped, pieces, share, utf8

DIMS = 4096
#: Centroids a language.
CENTROIDS = 4
#: Labelled rows that reach the driver, as vectors, over all languages; and those of one language at most.
SAMPLE_ROWS = 2000
SAMPLE_LANGUAGE = 400
#: The sample is drawn from so many rows of a language, each the least of its slot by hash.
SLOTS = 1 << 14
#: Texts of up to so many n-grams share a limit; the last limit holds for all longer ones.
LENGTHS = (50, 200, 800, 3200)
#: The part of the similarity that all but REJECT_QUANTILE of the labelled texts of a length reach.
REJECT_PART = 0.4
REJECT_QUANTILE = 0.005
LEAST_TEXTS = 20
LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed bigram or trigram occurs; none for a text without letters."""
    if not text or not LETTER.search(text):
        return None
    b = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)]
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    two = two[two != 0x2020]
    three = three[three & np.uint32(0xFFFF) != 0x2020]
    cell = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(32 - DIMS.bit_length() + 1)
    return np.bincount(cell, minlength=DIMS)


def damped(count: np.ndarray) -> np.ndarray:
    return np.log1p(count).astype(np.float32)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None
    owner: np.ndarray | None = None
    limits: list[float] = field(default_factory=list)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = rows * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def similarities(self, v: np.ndarray) -> np.ndarray:
        """Of each vector, the greatest cosine with a centroid of each language."""
        s = v @ self.centroids.T
        return np.stack([s[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)

    def limit(self, grams: np.ndarray) -> np.ndarray:
        return np.asarray(self.limits)[np.searchsorted(LENGTHS, grams)]

    def predict(self, rows: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's number, score, whether it is rejected)."""
        s = self.similarities(self.vectors(rows))
        best = s.argmax(axis=1)
        top = s[np.arange(len(s)), best]
        rest = s.copy()
        rest[np.arange(len(s)), best] = -1 if s.shape[1] > 1 else 0
        lead = top - rest.max(axis=1)
        return best, np.clip(1 / (1 + np.exp(-30.0 * lead.astype(np.float64))), 0, 1), top < self.limit(grams)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine; they start as far from one another as can be, from the mean's nearest row."""
    seeds = [int((v @ v.mean(axis=0)).argmax())]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds]
    for _ in range(rounds):
        at = (v @ c.T).argmax(axis=1)
        c = np.stack([v[at == i].sum(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (c := counts((raw or b"").decode("utf-8", "replace"))) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(c.sum())], pa.int64()), pa.array([damped(c).tobytes()], pa.binary())], names=["lang", "grams", "row"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, dtype=np.int64), 0
    for batch in pieces(batches):
        for raw in batch.column("text").to_pylist():
            if (c := counts((raw or b"").decode("utf-8", "replace"))) is not None:
                total += c > 0
                n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1), pa.int32()), pa.array(np.append(total, n), pa.int64())], names=["dim", "n"])


def fit(labelled: DataFrame, key: str = "doc_id") -> Model:
    """From rows with text and lang; rows without a lang teach nothing."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64(F.col(f"`{key}`").cast("string"), "text").alias("hash"), "lang", utf8("text").alias("text"))
    # map-side, a row for each slot of a language, whatever the number of rows or repeats
    slots = rows.groupBy("lang", F.pmod("hash", F.lit(SLOTS)).alias("slot")).agg(F.min("hash").alias("hash"), F.count("*").alias("n"))
    slots = share(slots, "slots")
    known = slots.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS)
    languages = sorted(r["lang"] for r in known.collect())
    if not languages:
        return Model()
    df = {r["dim"]: r["n"] for r in mapped(rows.select("text"), _frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    if not df:
        return Model()
    each = max(1, min(SAMPLE_LANGUAGE, SAMPLE_ROWS // len(languages)))
    order = Window.partitionBy("lang").orderBy("slot")
    wanted = slots.join(F.broadcast(labelled.sparkSession.createDataFrame([(x,) for x in languages], "lang string")), "lang")
    wanted = share(wanted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= each).select("lang", "hash"), "wanted")
    sampled = rows.join(F.broadcast(wanted), ["lang", "hash"], "left_semi").groupBy("lang", "hash").agg(F.min("text").alias("text"))
    picked = mapped(sampled.select("lang", "text"), _features, "lang string, grams bigint, row binary").toPandas()
    if not len(picked):
        return Model()
    picked = picked.sort_values(["lang", "grams", "row"])  # in an order that doesn't depend on the partitions
    n = df.pop(-1)
    seen = np.zeros(DIMS)
    seen[list(df)] = list(df.values())
    model = Model(languages=sorted(set(picked["lang"])), idf=(np.log((1 + n) / (1 + seen)) + 1).astype(np.float32))
    x = model.vectors(np.stack([np.frombuffer(r, dtype=np.float32) for r in picked["row"]]))
    groups = [cluster(x[(picked["lang"] == lang).to_numpy()], CENTROIDS) for lang in model.languages]
    model.centroids, model.owner = np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    best, length = model.similarities(x).max(axis=1), np.searchsorted(LENGTHS, picked["grams"].to_numpy())
    by_length = [best[length == k] for k in range(len(LENGTHS) + 1)]
    # longer texts lie nearer, so a length with few labelled texts takes the limit of the next shorter one
    limit = 0.0
    for b in by_length:
        limit = REJECT_PART * float(np.quantile(b, REJECT_QUANTILE)) if len(b) >= LEAST_TEXTS else limit
        model.limits.append(limit)
    return model


def _predicted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, model: Model) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, None):
        raw = batch.column(batch.num_columns - 1).to_pylist()
        lang, score, rejected = ["und"] * len(raw), [0.0] * len(raw), [True] * len(raw)
        for begin in range(0, len(raw), 512):
            found = [(i, c) for i, x in enumerate(raw[begin : begin + 512], begin) if (c := counts((x or b"").decode("utf-8", "replace"))) is not None]
            if found and model.languages:
                at, count = zip(*found, strict=True)
                best, p, far = model.predict(np.stack([damped(c) for c in count]), np.array([c.sum() for c in count]))
                for i, k, y, z in zip(at, best.tolist(), p.tolist(), far.tolist(), strict=True):
                    lang[i], score[i], rejected[i] = model.languages[k], y, z
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], schema=schema)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, lang_pred, score and rejected; only the text enters a prediction."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    rows = carried(docs, keep)
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    schema = StructType([rows.schema[c] for c in keep] + new)
    return mapped(rows, partial(_predicted, schema=to_arrow_schema(schema), model=model), schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
