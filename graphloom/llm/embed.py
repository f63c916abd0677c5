"""Embedding near-dedup by collision-counting projections.

Equal vectors form classes first, so a vector that a third of all rows share is one row. A class is dealt out to the
cells of its nearest pivots, whose number grows with the classes. To how many of them is calibrated for the pivots at
hand: pairs at the threshold, made from vectors of the table, share one of them with probability REACH, so that recall
doesn't fall as pivots grow; for random vectors of 64 components it takes 5 at 100 pivots, 10 at 8,192. Inside a cell
each of PROJECTIONS random directions puts all vectors in an order on a line. A window around a query's position in that order holds the
vectors that collide with it there; a pair that collides in as many orders as a pair at the threshold does with
probability RECALL is verified by its cosine in double precision.

A cell of more rows than TILE is cut into tiles, and each pair of tiles is a task: memory is bounded, and no row is
dropped. Each pair counts in the first cell that its two vectors share. Tasks return sums and a spanning forest, never
pairs, so a dense group makes as many rows as it has members.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null
label, link with nothing and are kept; vectors of unlike lengths link with nothing; rows that share a vec_id are one
node of the graph; rows with a null vec_id link with nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mapped, share, sized_join, small

THRESHOLD = 0.93
PROJECTIONS = 32
#: Half of a window's width in standard deviations of the projected difference of a pair at the threshold.
WIDTH = 2.0
RECALL = 0.999
#: Classes a pivot, and pivots at most.
CELL = 1024
MOST_PIVOTS = 8192
#: Pivots a class goes to at least.
NEAREST = 4
#: Pairs at the threshold that share a pivot, and vectors and pairs that show to how many pivots classes go for that.
REACH = 0.9995
PROBES = 1024
PROBE_PAIRS = 8192
TILE = 2048
#: Queries whose counts are in memory at once.
QUERIES = 512


def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dims, PROJECTIONS))


def window(threshold: float) -> float:
    """Half the width of a window: pairs of unit vectors at the threshold are sqrt(2 - 2 t) apart."""
    return WIDTH * math.sqrt(2 - 2 * threshold)


def least_count(threshold: float, recall: float = RECALL) -> int:
    """The greatest count of collisions that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(WIDTH / math.sqrt(2))
    below = 0.0
    for count in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if below > 1 - recall:
            return count
    return PROJECTIONS


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, d1, d2, raw): raw are the components as doubles, null if the vector links with nothing."""
    for batch in batches:
        d1, d2, raw = [], [], []
        for vector, label in zip(batch.column("embedding"), batch.column("label"), strict=True):
            x = np.zeros(0)
            if vector.is_valid and label.is_valid and not vector.values.null_count:
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ok = len(x) and np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0
            digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if ok else b""
            d1.append(int.from_bytes(digest[:8], "little", signed=True) if ok else None)
            d2.append(int.from_bytes(digest[8:], "little", signed=True) if ok else None)
            raw.append(x.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "d1", "d2", "raw"])


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def pivots_needed(pivots: np.ndarray, probes: np.ndarray, threshold: float, reach: float = REACH) -> int:
    """Of how many nearest pivots pairs at the threshold share one with probability ``reach``; all without probes."""
    if len(pivots) <= NEAREST or not len(probes):
        return len(pivots)
    rng, needed = np.random.default_rng(11), []
    for begin in range(0, PROBE_PAIRS, 256):
        x = probes[np.arange(begin, begin + 256) % len(probes)]
        away = rng.standard_normal(x.shape)
        away -= np.einsum("ij,ij->i", away, x)[:, None] * x
        length = np.linalg.norm(away, axis=1)[:, None]
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * np.divide(away, length, out=np.zeros_like(away), where=length > 0)
        ranks = []
        for z in (x, y):
            rank = np.empty((len(z), len(pivots)), dtype=np.int32)
            np.put_along_axis(rank, np.argsort(-(z @ pivots.T), axis=1, kind="stable").astype(np.int32), np.arange(len(pivots), dtype=np.int32)[None, :], axis=1)
            ranks.append(rank)
        needed.append(np.maximum(*ranks).min(axis=1) + 1)
    return max(NEAREST, int(np.quantile(np.concatenate(needed), reach, method="higher")))


def _dealt(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], nearest: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A row for each cell of a class: (label, dims, cell, cells, id, n, raw); cells lists all its cells."""
    for batch in batches:
        for label, ident, n, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "id", "n", "raw")), strict=True):
            x = np.frombuffer(raw, dtype=np.float64)
            cells = [0]
            if len(x) in pivots:
                s = pivots[len(x)] @ unit(x[None, :])[0]
                cells = np.sort(np.argsort(-s, kind="stable")[: nearest[len(x)]]).tolist()
            k = len(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * k, pa.int64()), pa.array([len(x)] * k, pa.int32()), pa.array(cells, pa.int32()), pa.array([cells] * k, pa.list_(pa.int32())), pa.array([ident] * k, pa.int64()), pa.array([n] * k, pa.int64()), pa.array([raw] * k, pa.binary())],
                names=["label", "dims", "cell", "cells", "id", "n", "raw"],
            )


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """How many projections put row j of b into the window around row i of a: counts[i, j]."""
    counts = np.zeros((len(a), len(b)), dtype=np.uint8)
    place = np.empty(len(b), dtype=np.uint16)  # a tile has fewer rows than 2**16
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        place[order] = np.arange(len(b), dtype=np.uint16)
        begin = np.searchsorted(line, a[:, k] - half, "left").astype(np.uint16)
        width = np.searchsorted(line, a[:, k] + half, "right").astype(np.uint16) - begin
        # places before the window wrap around to large numbers
        counts += place[None, :] - begin[:, None] < width[:, None]
    return counts


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the least number in both of two padded (-1) tables of cells."""
    both = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    return np.where(both.any(axis=2), a, np.iinfo(np.int32).max).min(axis=1)


def _counted(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """(id, n, root) for the classes of a pair of tiles: rows linked here, and the least class its links reach here."""
    _, dims, cell, one, two = (x.as_py() for x in key)
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    tile = table.column("tile").to_numpy()
    x = unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype=np.float64).reshape(-1, dims))
    listed = table.column("cells").to_pylist()
    cells = np.full((len(ids), max(map(len, listed))), -1, dtype=np.int32)
    for i, c in enumerate(listed):
        cells[i, : len(c)] = c
    left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
    line, half, least = x @ directions(dims), window(threshold), least_count(threshold)
    sums, ends = np.zeros(len(ids), dtype=np.int64), []
    for begin in range(0, len(left), QUERIES):
        some = left[begin : begin + QUERIES]
        i, j = np.nonzero(collisions(line[some], line[right], half) >= least)
        i, j = some[i], right[j]
        if one == two:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 65536):
            p, q = i[at : at + 65536], j[at : at + 65536]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            p, q = p[ok], q[ok]
            here = first_common(cells[p], cells[q]) == cell
            np.add.at(sums, p[here], n[q[here]])
            np.add.at(sums, q[here], n[p[here]])
            ends.append((p, q))
    root = np.arange(len(ids))[np.argsort(np.argsort(ids, kind="stable"), kind="stable")]  # ranks by id
    if ends:
        p, q = (np.concatenate(e) for e in zip(*ends, strict=True))
        while True:
            low = np.minimum(root[p], root[q])
            last = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            if (last == root).all():
                break
    by_rank = np.sort(ids, kind="stable")
    seen = np.flatnonzero((sums > 0) | (by_rank[root] != ids))
    return pa.table({"id": pa.array(ids[seen], pa.int64()), "n": pa.array(sums[seen], pa.int64()), "root": pa.array(by_rank[root][seen], pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows with vec_id, embedding and label."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = share(mapped(rows, _vectors, "vec_id bigint, label bigint, d1 bigint, d2 bigint, raw binary"), "vectors", "lz4")
    usable = kept.where("raw is not null and vec_id is not null")
    classes = share(usable.groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min("raw").alias("raw")), "classes", "lz4")
    count = classes.count()
    wanted = min(MOST_PIVOTS, -(-count // CELL))
    sample = classes.select("id", "raw").orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(wanted + PROBES).toPandas() if count else None
    by_dims: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for i, raw in enumerate(sample["raw"] if sample is not None else ()):
        by_dims.setdefault(len(raw) // 8, ([], []))[i >= wanted].append(np.frombuffer(bytes(raw), dtype=np.float64))
    pivots = {k: unit(np.stack(v)) for k, (v, _) in by_dims.items() if v}
    nearest = {k: pivots_needed(v, unit(np.stack(by_dims[k][1])) if by_dims[k][1] else v[:0], threshold) for k, v in pivots.items()}
    dealt = mapped(classes.select("label", "id", "n", "raw"), partial(_dealt, pivots=pivots, nearest=nearest), "label bigint, dims int, cell int, cells array<int>, id bigint, n bigint, raw binary")
    dealt = share(dealt, "cells", "lz4")
    place = ["label", "dims", "cell"]
    sizes, fits = small(dealt.groupBy(*place).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "tiles")
    tiled = sized_join(dealt, sizes, place, "inner", fits).withColumn("tile", F.pmod(F.xxhash64("id", F.lit("tile")), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(*place, F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "cells", "id", "n", "raw")

    def counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _counted(key, table, threshold)

    found = share(tiled.groupBy(*place, "one", "two").applyInArrow(counted, "id bigint, n bigint, root bigint"), "linked", "lz4")
    linked = found.groupBy("id").agg(F.sum("n").alias("linked"))
    reached = components(found.where("id <> root"), "id", "root").withColumnRenamed("node", "id")
    at = classes.select("label", "d1", "d2", "id", "n").join(linked, "id", "left").join(reached, "id", "left")
    at = at.select("label", "d1", "d2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "id").alias("_component"))
    out = kept.select("vec_id", "label", "d1", "d2").join(at, ["label", "d1", "d2"], "left")
    alone = F.col("d1").isNull() | F.col("vec_id").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("_component"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("_links")).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


#: The same by brute force over all pairs with equal labels.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), counted AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
), components AS (
  SELECT node AS vec_id, min(other) AS least_id FROM reach GROUP BY node
)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(least_id, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(least_id, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted USING (vec_id) LEFT JOIN components USING (vec_id)
"""
