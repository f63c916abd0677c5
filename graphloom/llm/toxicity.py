"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are alike by the subsequences of LENGTH characters that they share within SPAN positions, each gap damped
by DECAY: an insult with an inserted or stretched character keeps most of them. The kernel's features are hashed
into DIMS cells, so a word's kernel with a landmark is a sparse dot product. Landmarks are words of the training
rows; the Nyström map K_mm^-1/2 k(w) feeds a linear machine with squared hinge loss, whose weights fold back into one
weight a cell. Scoring a word is then a few table look-ups, whatever the number of landmarks.

Sentences teach through their words, all of them: a word is a positive example if it is much commoner in toxic
training rows than chance explains (LEAST_EVIDENCE leaves half a word to chance in 60,000), else a negative one,
weighted by its evidence; those between teach neither. A logistic curve over a text's strongest words turns them into
a score; it is fitted on the training rows, too. Letters that stand alone one after another are read as one word as
well. Fitting uses about SAMPLE_ROWS labelled rows a class, drawn by hash. Words stay on the executors, which return
sums; the driver holds the landmarks and a matrix of their number squared. Scoring is one pass over whole texts
without a shuffle. The README says why the machine learns from words, with figures.

Defined results: null and empty texts, and all texts if either class has no rows, get the share of toxic rows as
their score (0 without labels); rows whose label is null or other than 0 and 1 teach nothing; repeated rows score
alike; further columns are not read, whatever their names, and ``keep`` may name any.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, mapped, pieces, share, utf8

LENGTH, SPAN, DECAY = 3, 5, 0.6
DIMS = 1 << 15
LANDMARKS = 384
#: Words of which variants teach, too.
VARIED = 64
SAMPLE_ROWS = 4000
#: Longer words are read in overlapping parts of this many characters.
LONGEST = 32
#: A word is toxic evidence from this log-likelihood ratio on, and clean up to this odds ratio; others don't teach.
LEAST_EVIDENCE, MOST_CLEAN_ODDS = 20.0, 1.5
WORDS_CACHED = 500_000
#: Tasks that a step of Newton's method is dealt to, at most.
TASKS = 64
MARKS = re.compile(r"[\W_]+")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Three or more letters that stand alone. What parts them matches no letter, so a text is read once, not in all ways.
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\s.\-_*]+[^\W_](?![^\W_])){2,}")
GAPS = [(a, b, DECAY ** (b - 2)) for a, b in itertools.combinations(range(1, SPAN), LENGTH - 1)]


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words; those with marks inside also without them; long ones in parts; spelled-out ones joined."""
    low = text.lower()
    out = set(low.split())
    out.update([joined for w in out if not w.isalnum() and (joined := MARKS.sub("", w))])
    for m in SPELLED.finditer(low):
        out.add(MARKS.sub("", m[0]))
    long = [w for w in out if len(w) > LONGEST]
    out.difference_update(long)
    for w in long:
        out.update(w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, cell, weight) of each gapped subsequence of each word."""
    spelled = [f"\x02{EDGE.sub('', w) or w}\x03" for w in words]
    codes = np.frombuffer("".join(spelled).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in spelled])
    whose, cells, weights = [], [], []
    for a, b, weight in GAPS:
        n = len(codes) - b
        if n <= 0:
            continue
        ok = owner[:n] == owner[b:]
        mixed = codes[:n] * np.uint64(0x9E3779B97F4A7C15) + codes[a : a + n] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[b:] * np.uint64(0x165667B19E3779F9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        cells.append((mixed >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64)[ok])
        whose.append(owner[:n][ok])
        weights.append(np.full(int(ok.sum()), weight))
    if not cells:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(whose), np.concatenate(cells), np.concatenate(weights)


def norms(n: int, whose: np.ndarray, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The lengths of the words' feature vectors; only words that repeat a subsequence need their features summed up."""
    squares = np.bincount(whose, weights**2, n)
    key = whose * DIMS + cells
    ordered = np.sort(key)
    repeated = np.zeros(n, dtype=bool)
    repeated[ordered[1:][ordered[1:] == ordered[:-1]] // DIMS] = True
    if repeated.any():
        some = repeated[whose]
        each, at = np.unique(key[some], return_inverse=True)
        squares[repeated] = np.bincount(each // DIMS, np.bincount(at, weights[some]) ** 2, n)[repeated]
    return np.sqrt(np.maximum(squares, 1e-9))


def kernel_rows(words: list[str], table: np.ndarray) -> np.ndarray:
    """Normalised kernels of words with what the columns of table (a row for each cell) hold."""
    out = np.zeros((len(words), table.shape[1]), dtype=np.float32)
    for begin in range(0, len(words), 1000):
        part = words[begin : begin + 1000]
        whose, cells, weights = features(part)
        order = np.argsort(whose, kind="stable")
        whose, cells, weights = whose[order], cells[order], weights[order]
        if len(whose):
            first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            out[begin + whose[first]] = np.add.reduceat(table[cells] * weights[:, None], first, axis=0)
        out[begin : begin + len(part)] /= norms(len(part), whose, cells, weights)[:, None]
    return out


def columns(words: list[str]) -> np.ndarray:
    """The normalised features of words, a column for each."""
    whose, cells, weights = features(words)
    out = np.zeros((DIMS, len(words)), dtype=np.float32)
    np.add.at(out, (cells, whose), weights)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->j", out, out)), 1e-9)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.5 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(np.full(len(w), 0.5)), g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    cells: np.ndarray | None = None
    bias: float = 0.0
    curve: np.ndarray | None = None
    prior: float = 0.0

    def words(self, words: list[str]) -> np.ndarray:
        whose, cells, weights = features(words)
        return np.bincount(whose, self.cells[cells] * weights, len(words)) / norms(len(words), whose, cells, weights) + self.bias


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def evidence(self, texts: list[str]) -> list[tuple[float, float, float, float]]:
        """Of each text: the greatest word score, the mean of the three greatest, how many are positive, and words, as logarithms."""
        found = [words_of(x) for x in texts]
        new = [w for w in set().union(*found) if w not in self.known]
        if len(self.known) + len(new) > WORDS_CACHED:
            self.known.clear()
            new = list(set().union(*found))
        if new:
            self.known.update(zip(new, self.model.words(new).tolist(), strict=True))
        return [self.strongest(words) for words in found]

    def strongest(self, words: set[str]) -> tuple[float, float, float, float]:
        if not words:
            return -2.0, -2.0, 0.0, 0.0
        scores = np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))
        top = np.sort(scores[scores >= np.partition(scores, -3)[-3]])[-3:] if len(scores) > 3 else scores
        return float(top.max()), float(top.mean()), float(np.log1p((scores > 0).sum())), float(np.log1p(len(scores)))


def decoded(texts: list[bytes | None]) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in texts]


def _evidence(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in pieces(batches, most=1_000_000):
        rows = scorer.evidence(decoded(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column("y"), *[pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]], names=["y", "x0", "x1", "x2", "x3"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=1_000_000):
        found, toxic = [], []
        for y, x in zip(batch.column("y").to_pylist(), decoded(batch.column("text").to_pylist()), strict=True):
            w = {EDGE.sub("", w) or w for w in words_of(x)}
            found += w
            toxic += [y] * len(w)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())], names=["word", "y"])


def judged(words: DataFrame, n_toxic: float, n_clean: float) -> DataFrame:
    """(word, y, evidence, clean) of the words that teach, from words and how many toxic and clean rows hold them.

    evidence is the log-likelihood ratio of a word's two counts against those that the classes' sizes predict.
    """
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n, part = toxic + clean, n_toxic / (n_toxic + n_clean)
    term = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    odds = ((toxic + 0.1) / (n_toxic + 0.2)) / ((clean + 0.1) / (n_clean + 0.2))
    rows = words.select("word", "clean", (2 * (term(toxic, part) + term(clean, 1 - part))).alias("evidence"), odds.alias("odds"))
    positive = (F.col("evidence") >= LEAST_EVIDENCE) & (F.col("odds") > 2)
    used = rows.where(positive | ((F.col("odds") <= MOST_CLEAN_ODDS) & (F.col("clean") > 0)))
    return used.select("word", F.when(positive, 1.0).otherwise(-1.0).alias("y"), "evidence", F.col("clean").cast("double").alias("clean"))


def landmarks(words: DataFrame) -> tuple[list[str], list[tuple[str, float]]]:
    """The strongest positive words, the commonest negative ones, and as many by hash; and the strongest with their evidence."""
    strongest = [(r["word"], r["evidence"]) for r in words.where("y > 0").orderBy(F.desc("evidence"), "word").limit(LANDMARKS // 2).collect()]
    clean = words.where("y < 0")
    common = [r["word"] for r in clean.orderBy(F.desc("clean"), "word").limit(LANDMARKS // 4).collect()]
    others = [r["word"] for r in clean.where(~F.col("word").isin(common)).orderBy(F.xxhash64("word"), "word").limit(LANDMARKS // 4).collect()]
    return [w for w, _ in strongest] + common + others, strongest


def _mapped_words(batches: Iterator[pa.RecordBatch], table: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            x = (kernel_rows(part.column("word").to_pylist(), table) @ root).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("weight"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "weight", "x"])


def _sums(batches: Iterator[pa.RecordBatch], w: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """What a step of Newton's method needs of the rows inside the margin, all without w: two sums, and a mark of the set."""
    left = right = None
    marked, rows = 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float16).reshape(batch.num_rows, -1).astype(np.float64)
        x = np.c_[x, np.ones(len(x))]
        y, weight = (batch.column(c).to_numpy() for c in ("y", "weight"))
        inside = np.ones(len(x), dtype=bool) if w is None else y * (x @ w) < 1
        x, y, weight = x[inside], y[inside], weight[inside]
        more = (x * weight[:, None]).T @ x, x.T @ (weight * y)
        left, right = more if left is None else (left + more[0], right + more[1])
        marked, rows = marked + int(inside.sum()), rows + batch.num_rows
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([marked], pa.int64()), pa.array([rows], pa.int64())], names=["l", "r", "inside", "n"])


def squared_hinge(rows: DataFrame, total_weight: float, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights, the last a bias, by Newton's method: executors sum up the rows inside the margin, the driver solves."""
    w, last = None, None
    for _ in range(rounds):
        parts = mapped(rows, partial(_sums, w=w), "l binary, r binary, inside bigint, n bigint")
        left = right = 0.0
        inside = n = 0
        for p in parts.toLocalIterator():  # a matrix at a time
            right = right + np.frombuffer(bytes(p["r"]))
            left = left + np.frombuffer(bytes(p["l"])).reshape(len(right), -1)
            inside, n = inside + p["inside"], n + p["n"]
        penalty = np.full(len(right), ridge * total_weight / n)
        penalty[-1] = 1e-6
        new = np.linalg.solve(left + np.diag(penalty), right)
        if last == inside and np.allclose(new, w, rtol=1e-4, atol=1e-6):
            break
        w, last = new, inside
    return new


def machine(words: DataFrame) -> tuple[np.ndarray, float]:
    """The weight of each cell, and the bias, from words that teach."""
    chosen, strongest = landmarks(words)
    table = columns(chosen)
    values, vectors = np.linalg.eigh((table.T @ table).astype(np.float64))
    root = (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T).astype(np.float32)
    sums = words.groupBy("y").agg(F.sum(F.sqrt("evidence")).alias("root"), F.count("*").alias("n")).collect()
    positive, negative = (next((r[c] for r in sums if r["y"] == y), 0) for y, c in ((1.0, "root"), (-1.0, "n")))
    scale = 0.3 * negative / max(positive, 1e-9)
    weight = F.when(F.col("y") > 0, F.sqrt("evidence") * scale).otherwise(1.0)
    # the strongest also with a letter doubled or inserted, as examples of half their weight
    variants = [(v, 1.0, scale * float(np.sqrt(e)) / 2) for w, e in strongest[:VARIED] for k in [len(w) // 2] if k >= 2 for v in (w[:k] + w[k - 1] + w[k:], w[:k] + "x" + w[k:])]
    rows = words.select("word", "y", weight.alias("weight"))
    if variants:
        rows = rows.union(words.sparkSession.createDataFrame(variants, "word string, y double, weight double"))
    # a small table with much work a row: dealt over the cores, but no more tasks than matrices the driver should add up
    rows = rows.repartition(min(TASKS, words.sparkSession.sparkContext.defaultParallelism))
    rows = share(mapped(rows, partial(_mapped_words, table=table, root=root), "y double, weight double, x binary"), "word_features", "lz4")
    w = squared_hinge(rows, 1.3 * negative)
    return (table @ (root @ w[:-1].astype(np.float32))).astype(np.float64), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic). The sample is drawn from the labels by a hash of the id.

    Its rows, about SAMPLE_ROWS a class whatever the tables' size, are all that is broadcast. A document with both
    labels counts as each.
    """
    marks = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    model = Model(prior=sizes.get(1, 0) / total if total else 0.0)
    if len(sizes) < 2:
        return model
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000))
    share_of = {y: 1_000_000 if n <= SAMPLE_ROWS else int(1_000_000 * SAMPLE_ROWS / n) for y, n in sizes.items()}
    picked = marks.where(slot < F.when(F.col("y") == 1, share_of[1]).otherwise(share_of[0]))
    sample = share(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", utf8("text").alias("text")), "sample")
    counted = mapped(sample, _word_rows, "word string, y int").groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    n_toxic, n_clean = (min(sizes[y], sizes[y] * share_of[y] / 1e6) for y in (1, 0))
    words = share(judged(counted, n_toxic, n_clean), "words")
    if not words.take(1):
        return model
    model.cells, model.bias = machine(words)
    seen = mapped(sample, partial(_evidence, model=model), "y int, x0 double, x1 double, x2 double, x3 double").toPandas()
    y = seen["y"].to_numpy(dtype=float)
    weight = np.where(y == 1, sizes[1] / max((y == 1).sum(), 1), sizes[0] / max((y == 0).sum(), 1))
    model.curve = logistic(seen[["x0", "x1", "x2", "x3"]].to_numpy(), y, weight / weight.mean())
    return model


def _scored(batches: Iterator[pa.RecordBatch], schema: pa.Schema, model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in pieces(batches, None, 1_000_000):
        texts = decoded(batch.column(batch.num_columns - 1).to_pylist())
        score = np.full(len(texts), model.prior)
        if model.curve is not None and (at := [i for i, x in enumerate(texts) if x]):
            x = np.array(scorer.evidence([texts[i] for i in at]))
            score[at] = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model.curve, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], schema=schema)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs and score; only the text enters it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = carried(docs, keep)
    schema = StructType([rows.schema[c] for c in keep] + [StructField("score", DoubleType())])
    return mapped(rows, partial(_scored, schema=to_arrow_schema(schema), model=model), schema)

