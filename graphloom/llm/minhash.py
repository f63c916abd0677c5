"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct word shingles. Documents with equal sets form classes first, so thousands of
copies cost one row. Each class gets a MinHash signature, and each tree of the forest is one sorted order of all
signatures: tree t sorts by the values from position 4t on, cyclically. Rows are dealt out by ranges of that order, so
no prefix, however common, fills a task. In a sorted order a row's candidates are the rows before it with the longest
common prefix: of at least DEPTH values in a region that holds few rows, deeper ones where a region is crowded, and
always the row just before it and the region's first row. A pair of similarity 0.8 shares DEPTH values with some
tree with probability 1 - (1 - 0.8**DEPTH)**TREES, over 0.9999; pairs that sizes rule out are dropped at once.

Candidates are confirmed on full sets in two rounds. The first confirms each row's best candidate, which connects
nearly all of a dense group by as many pairs as it has rows; the second confirms all other pairs whose ends are not
yet in one component. A crowded region may still hold rows outside its largest component. Regions that share rows make
a crowd. Its rows outside its largest component are compared on full sets with those of its rows that share one of their
rarest shingles, of which similar rows always share one; where many rows of a crowd do so, and in small crowds, with all
of its rows, in tiles of bounded size that return links alone, never pairs. No candidate is given up.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is kept; one with
fewer words than a shingle has its whole sequence as the only shingle; equal rows stay or go together; rows that share
a doc_id but not a text are judged each by its text; rows with a null doc_id get a null component and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, mapped, pieces, share, utf8

SHINGLE = 5
THRESHOLD = 80  # percent
TREES = 20
DEPTH = 4
VALUES = TREES * DEPTH
#: Rows before a row that are its candidates in a sorted order, if their common prefix is long enough.
NEIGHBOURS = 4
#: Common values that candidates beyond the first two need in a crowded region.
CROWDED_DEPTH = 6
#: Rows of a tile of a crowd.
TILE = 256
WORDS_CACHED = 400_000

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDER = ("tree", "k0", "k1", "k2", "k3", "tail", "id")


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(raw: bytes | None, k: int, known: WordHashes) -> np.ndarray:
    """The set's shingles as sorted distinct 64-bit hashes."""
    words = (raw or b"").lower().split()  # of bytes: A-Z alone are lower-cased, the six ASCII white-space characters cut
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out += h[i : i + n] * _PLACE[i]
    return np.unique(mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint64)
    for begin in range(0, len(shingles), 2048):
        part = shingles[begin : begin + 2048]
        out = np.minimum(out, ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in pieces(batches):
        n, first, second, rows = [], [], [], []
        for raw in batch.column("text").to_pylist():
            s = shingle_set(raw, k, known)
            digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
            n.append(len(s))
            first.append(int(digest[0]))
            second.append(int(digest[1]))
            rows.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(rows, pa.binary())],
            names=["doc_id", "tie", "n_shingles", "set1", "set2", "signature"],
        )


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, tie, n_shingles, set1, set2, signature): the text's hash, the set's size, its digest and its signature."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("`text`")).alias("tie"), utf8("text").alias("text"))
    return mapped(rows, partial(_signed, k=k), "doc_id bigint, tie bigint, n_shingles bigint, set1 bigint, set2 bigint, signature binary")


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the first eight values in its order, and a hash of the others."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
        for tree in range(TREES):
            turned = np.ascontiguousarray(np.roll(values, -DEPTH * tree, axis=1))
            keys = turned[:, :8].copy().view(np.int64)
            rest = turned[:, 8:].copy().view(np.uint64)
            tail = mixed((rest * _PLACE[: rest.shape[1] % 64][None, :]).sum(axis=1, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), tree, dtype=np.int32)), *[pa.array(np.ascontiguousarray(keys[:, i])) for i in range(4)], pa.array(tail), batch.column("id"), batch.column("n_shingles")],
                names=[*ORDER, "n_shingles"],
            )


TREE_SCHEMA = "tree int, k0 bigint, k1 bigint, k2 bigint, k3 bigint, tail bigint, id bigint, n_shingles bigint"


def common_values(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i and j with equal first four values: how many of the first eight are equal, and 9 if all hashes are."""
    low = np.int64(0xFFFFFFFF)  # the first of two values, as little-endian memory has it
    d2, d3 = x["k2"][i] ^ x["k2"][j], x["k3"][i] ^ x["k3"][j]
    out = np.full(len(i), 4)
    step = (d2 & low) == 0
    out += step
    for equal in (d2 == 0, (d3 & low) == 0, d3 == 0, x["tail"][i] == x["tail"][j]):
        step = step & equal
        out += step
    return out


def _neighbours(batches: Iterator[pa.RecordBatch], threshold: int, ends: bool, crowds: bool | None = None) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a sorted run of rows.

    Also rows without a partner: with ``crowds``, by default as ``ends``, all rows of crowded regions with depth -1, and
    with ``ends`` the run's first and last rows with depth 0: NEIGHBOURS + 1 each, so a region with no more rows than
    that in a run is there with all of them.
    """
    names = [*ORDER, "n_shingles"]
    before: dict[str, np.ndarray] | None = None  # the last rows of the batches so far
    head_of = None  # (tree, k0, k1, id, n, rows so far) of the open region
    first_rows = 0

    def rows(a, b, depth, of=None):
        size = len(a)
        null = pa.nulls(size, pa.int64())
        keys = [pa.nulls(size, pa.int32()), *[null] * 5, null] if of is None else [pa.array(of[c].astype(np.int32) if c == "tree" else of[c]) for c in (*ORDER[:-1], "n_shingles")]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), null if of is not None else pa.array(b, pa.int64()), pa.array(depth, pa.int32()), *keys], names=["a", "b", "depth", *ORDER[:-1], "n_shingles"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        x = new if before is None else {c: np.concatenate([before[c], new[c]]) for c in names}
        lead = 0 if before is None else len(before["id"])
        total = len(x["id"])
        starts = np.ones(total, dtype=bool)
        starts[1:] = (x["tree"][1:] != x["tree"][:-1]) | (x["k0"][1:] != x["k0"][:-1]) | (x["k1"][1:] != x["k1"][:-1])
        region = np.maximum.accumulate(np.where(starts, np.arange(total), 0))
        head_id, head_n, place = x["id"][region].copy(), x["n_shingles"][region].copy(), np.arange(total) - region
        if head_of is not None and lead:  # the region may have begun before the rows at hand
            same = (x["tree"] == head_of[0]) & (x["k0"] == head_of[1]) & (x["k1"] == head_of[2])
            head_id[same], head_n[same] = head_of[3], head_of[4]
            at = np.flatnonzero(same)
            place[at] = head_of[5] - 1 - (lead - 1) + at
        found = []
        for lag in range(1, NEIGHBOURS + 1):
            i = np.arange(max(lead, lag), total)
            j = i - lag
            i, j = i[region[i] == region[j]], j[region[i] == region[j]]
            depth = common_values(x, i, j)
            ok = (place[i] <= NEIGHBOURS) | (lag <= 2) | (depth >= CROWDED_DEPTH)
            found.append((x["id"][i][ok], x["id"][j][ok], depth[ok], x["n_shingles"][i][ok], x["n_shingles"][j][ok]))
        i = np.arange(lead, total)
        i = i[place[i] > NEIGHBOURS]
        found.append((x["id"][i], head_id[i], np.full(len(i), DEPTH), x["n_shingles"][i], head_n[i]))
        a, b, depth, n, m = (np.concatenate(c) for c in zip(*found, strict=True))
        ok = (a != b) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
        if ok.any():
            yield rows(np.maximum(a, b)[ok], np.minimum(a, b)[ok], depth[ok])
        if (ends if crowds is None else crowds) and (place[lead:] > NEIGHBOURS).any():
            full = np.flatnonzero(place == NEIGHBOURS + 1)
            full = full[full >= lead]  # here a region becomes a crowd: with the rows before
            at = np.concatenate([(full[:, None] - np.arange(NEIGHBOURS + 2)).ravel(), lead + np.flatnonzero(place[lead:] > NEIGHBOURS + 1)])
            crowd = {c: x[c][at] for c in names}
            yield rows(crowd["id"], None, np.full(len(at), -1, dtype=np.int32), crowd)
        if ends and first_rows <= NEIGHBOURS:
            part = {c: new[c][: NEIGHBOURS + 1 - first_rows] for c in names}
            first_rows += len(part["id"])
            yield rows(part["id"], None, np.zeros(len(part["id"]), dtype=np.int32), part)
        last = total - 1
        head_of = tuple(int(v) for v in (x["tree"][last], x["k0"][last], x["k1"][last], head_id[last], head_n[last], place[last] + 1))
        before = {c: x[c][-NEIGHBOURS - 1 :] for c in names}
    if ends and before is not None:
        yield rows(before["id"], None, np.zeros(len(before["id"]), dtype=np.int32), before)


PAIR_SCHEMA = "a bigint, b bigint, depth int, tree int, k0 bigint, k1 bigint, k2 bigint, k3 bigint, tail bigint, n_shingles bigint"


def candidates(classes: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b, depth, trees), a > b, of classes (id, n_shingles, signature), each pair once; (region, id) of crowds."""
    trees = mapped(classes.select("id", "n_shingles", "signature"), _planted, TREE_SCHEMA)
    ordered = trees.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    found = share(mapped(ordered, partial(_neighbours, threshold=threshold, ends=True), PAIR_SCHEMA), "neighbours")
    # the rows around the borders of the ranges: a few a partition
    borders = found.where("b is null and depth = 0").select(F.col("a").alias("id"), *ORDER[:-1], "n_shingles").distinct()
    across = share(mapped(borders.select(*ORDER, "n_shingles").repartition(1).sortWithinPartitions(*ORDER), partial(_neighbours, threshold=threshold, ends=False, crowds=True), PAIR_SCHEMA), "across")
    found = found.union(across)  # a region that borders cut is a crowd by its rows on both sides
    pairs = found.where("b is not null").select("a", "b", "depth")
    crowds = found.where("b is null and depth = -1").select(F.xxhash64("tree", "k0", "k1").alias("region"), F.col("a").alias("id"))
    return share(pairs.groupBy("a", "b").agg(F.max("depth").alias("depth"), F.count("*").alias("trees")), "pairs"), crowds


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    inter = np.intersect1d(a, b, assume_unique=True).size
    return 100 * inter >= threshold * (len(a) + len(b) - inter)


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, threshold: int) -> Iterator[pa.RecordBatch]:
    known, last, last_set = WordHashes(), None, None
    for batch in pieces(pieces(batches, "text_a"), "text_b"):
        a, b = [], []
        for x, y, text_x, text_y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            if last != text_y:
                last, last_set = text_y, shingle_set(text_y, k, known)
            if similar(shingle_set(text_x, k, known), last_set, threshold):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; texts has id and text."""
    left = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return mapped(both.select("a", "b", "text_a", "text_b"), partial(_confirmed, k=k, threshold=threshold), "a bigint, b bigint")


def _linked(key: tuple, table: pa.Table, k: int, threshold: int) -> pa.Table:
    """(a, b) of a pair of tiles: for each asking row one link to each other component that it is similar to.

    The shingles of the tiles are numbered, so all intersections of a block are one product of 0-1 matrices.
    """
    known = WordHashes()
    ids, at = table.column("id").to_numpy(), table.column("component").to_numpy()
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    sets = [shingle_set(x, k, known) for x in table.column("text").to_pylist()]
    n = np.array([len(x) for x in sets], dtype=np.float64)
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    shingles, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    shared = (np.cumsum(count > 1) - 1)[number]  # a shingle of one row alone is in no intersection
    keep = count[number] > 1
    owner, shared = owner[keep], shared[keep]
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    place = np.full(len(sets), -1)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    for begin in range(0, int(shared.max()) + 1 if len(shared) else 0, 8192):
        some = (shared >= begin) & (shared < begin + 8192)
        o, c = owner[some], shared[some] - begin
        x = np.zeros((len(left), 8192), dtype=np.float32)
        y = np.zeros((len(right), 8192), dtype=np.float32)
        x[place[o[asks[o]]], c[asks[o]]] = 1
        y[place[o[~asks[o]]], c[~asks[o]]] = 1
        inter += x @ y.T
    union = n[left][:, None] + n[right][None, :] - inter
    i, j = np.nonzero((100 * inter.astype(np.float64) >= threshold * union) & (at[left][:, None] != at[right][None, :]))
    _, first = np.unique(np.stack([left[i], at[right[j]]], axis=1), axis=0, return_index=True)
    q, r = ids[left[i[first]]], ids[right[j[first]]]
    return pa.table({"a": pa.array(np.maximum(q, r), pa.int64()), "b": pa.array(np.minimum(q, r), pa.int64())})


def placed(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """pairs with the components of their ends, at_a and at_b, where those differ."""
    for end in ("a", "b"):
        pairs = pairs.join(reached.select(F.col("node").alias(end), F.col("component").alias(f"at_{end}")), end, "left").withColumn(f"at_{end}", F.coalesce(f"at_{end}", end))
    return pairs.where("at_a <> at_b")


def extended(reached: DataFrame, new: DataFrame) -> DataFrame:
    """(node, component) with new links: components are merged, not found anew."""
    ends = share(placed(new.select("a", "b"), reached), "ends")
    merged = components(ends.select("at_a", "at_b"), "at_a", "at_b").select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
    every = reached.select("node", "component").union(nodes.select("node", F.col("node").alias("component")))
    return share(every.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "reached")


def _shingled(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    known = WordHashes()
    for batch in pieces(batches):
        sets = [shingle_set(x, k, known) for x in batch.column("text").to_pylist()]
        n = np.array([len(x) for x in sets], dtype=np.int64)
        at = pa.array(np.repeat(np.arange(len(sets)), n))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(at) for c in ("crowd", "id", "tie")], pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))],
            names=["crowd", "id", "tie", "n", "shingle"],
        )


def rare_shingles(rows: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """(crowd, id, n, shingle, met) of the shingles of which similar rows of a crowd have at least one in common.

    Each crowd's shingles are ordered by how many of its rows have them, rare ones first. Sets of n and more shingles
    that are similar have threshold percent of n in common, so each has a common one among its first
    n - threshold percent of n + 1. Those that no other row has are counted among them, but not returned.
    """
    of = rows.select("crowd", "id").join(texts, "id").select("crowd", "id", F.xxhash64("text").alias("tie"), "text")
    every = share(mapped(of, partial(_shingled, k=k), "crowd bigint, id bigint, tie bigint, n bigint, shingle bigint"), "shingles")
    common = share(every.groupBy("crowd", "shingle").agg(F.count("*").alias("met")).where("met > 1").withColumn("count", F.col("met")), "common")
    found = join_counted(every, common, ["crowd", "shingle"], "count", every.count())
    sets = found.groupBy("crowd", "id", "tie", "n").agg(F.sort_array(F.collect_list(F.struct("met", "shingle"))).alias("found"))
    first = F.expr(f"n - ceil(n * {threshold} / 100) + 1 - (n - size(found))").cast("int")
    taken = sets.withColumn("first", first).where("first > 0").select("crowd", "id", "n", F.explode(F.slice("found", 1, F.col("first"))).alias("x"))
    return taken.select("crowd", "id", "n", "x.shingle", "x.met")


def crowd_links(crowds: DataFrame, texts: DataFrame, reached: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) of rows outside their crowd's largest component with rows of other components.

    In crowds of more than TILE rows such a row is compared with those that share one of its rare shingles, unless more
    than TILE rows have one of these: then, as in smaller crowds, with all rows of its crowd, in tiles.
    """
    at = crowds.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    at = share(at, "regions")
    mixed = at.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("region", "low")
    rows = share(at.join(mixed, "region").select("id", "component", "low"), "mixed")
    # crowds, by components instead of rows: each goes to the least of its regions' leasts, and those to it
    met = share(rows.select("component", "low").distinct(), "met")
    least = met.groupBy("component").agg(F.min("low").alias("to"))
    edges = least.select("component", "to").union(met.join(least, "component").select("low", "to")).where("component <> to").distinct()
    named = components(edges, "component", "to").withColumnRenamed("component", "crowd").withColumnRenamed("node", "component")
    rows = share(rows.select("id", "component").distinct().join(named, "component"), "crowds")
    parts = rows.groupBy("crowd", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("crowd").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("rows"))
    full = share(rows.join(main, "crowd").withColumn("asks", F.col("component") != F.col("main")), "crowds")

    rare = rare_shingles(full.where(F.col("rows") > TILE), texts, k, threshold)
    rare = share(rare.join(full.select("id", "component", "asks"), "id"), "rare")
    often = share(rare.where(F.col("asks") & (F.col("met") > TILE)).select("id").distinct(), "often")
    few = rare.where(F.col("met") <= TILE)
    one = few.where("asks").join(often, "id", "left_anti").select("crowd", "shingle", *[F.col(c).alias(f"{c}_1") for c in ("id", "component", "n")])
    both = one.join(few, ["crowd", "shingle"]).where("component <> component_1").where(F.least("n", "n_1") * 100 >= F.greatest("n", "n_1") * threshold)
    pairs = share(both.select(F.greatest("id", "id_1").alias("a"), F.least("id", "id_1").alias("b")).distinct(), "pairs")

    asks = full.where(F.col("asks") & (F.col("rows") <= TILE)).select("id").union(often)
    asks = share(full.join(asks, "id", "left_semi"), "asks")
    sizes = asks.groupBy("crowd").agg(F.ceil(F.count("*") / TILE).cast("int").alias("ask_tiles"), F.ceil(F.max("rows") / TILE).cast("int").alias("tiles"))
    spread = lambda n: F.pmod(F.xxhash64("id", F.lit("tile")), F.col(n)).cast("int")
    some = ["crowd", "id", "component"]
    asking = asks.join(sizes, "crowd").select(*some, F.lit(True).alias("asks"), spread("ask_tiles").alias("one"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("two"))
    asked = full.join(sizes, "crowd").select(*some, F.lit(False).alias("asks"), spread("tiles").alias("two"), F.explode(F.sequence(F.lit(0), F.col("ask_tiles") - 1)).alias("one"))
    tiled = asking.unionByName(asked).join(texts, "id")

    def linked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _linked(key, table, k, threshold)

    return confirm(pairs, texts, k, threshold).union(tiled.groupBy("crowd", "one", "two").applyInArrow(linked, "a bigint, b bigint")).distinct()


def reach(docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """(node, component) of the class ids that confirmed links connect."""
    pairs, crowds = candidates(classes, threshold)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), utf8("text").alias("text")).where("text is not null")
    ids = share(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowds.select("id")).distinct(), "ids")
    # by shuffle at every size, since ids grow with the texts
    texts = share(rows.join(ids.hint("merge"), "id", "left_semi"), "texts")
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("trees", "depth", -F.col("b"))).alias("b"))
    reached = share(components(share(confirm(best, texts, k, threshold), "links")), "reached")
    rest = share(placed(pairs.select("a", "b"), reached).select("a", "b").join(best, ["a", "b"], "left_anti"), "rest")
    reached = extended(reached, share(confirm(rest, texts, k, threshold), "links"))
    return extended(reached, share(crowd_links(crowds, texts, reached, k, threshold), "links"))


def judged(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id, kept) of each row."""
    signed = share(signatures(docs, k), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = share(full.groupBy("set1", "set2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")), "classes")
    reached = reach(docs, classes, k, threshold)
    at = classes.select("set1", "set2", "id").join(reached.withColumnRenamed("node", "id"), "id", "left")
    at = at.select("set1", "set2", F.coalesce("component", "id").alias("_component"))
    out = signed.select("doc_id", "tie", "n_shingles", "set1", "set2").join(at, ["set1", "set2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "tie", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id that links reach."""
    return judged(docs, k, threshold).drop("tie")


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep."""
    gone = share(judged(docs, k, threshold).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("tie").alias("_tie")).distinct(), "gone")
    same = (docs["doc_id"].cast("bigint") == F.col("_gone")) & (F.xxhash64(docs["text"]) == F.col("_tie"))
    return docs.join(gone.hint("merge"), same, "left_anti")
