"""The query language: a list of operations that folds over a lazily built DataFrame (Q0-Q11)."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import label
from ..graph import PropertyGraph
from ..operators.semantic import batches_of, embed_nodes, similarities
from ..operators.traverse import reach
from .selectors import Name, OneOf, SpecError, edge_selector

DIRECTIONS = ("outgoing", "incoming", "both")
SORT_KEYS = {"name": "name", "type": "type", "label": "label"}


@dataclass(frozen=True)
class Find:
    type: OneOf | None = None
    name: Name | None = None
    id: str | None = None
    label: OneOf | None = None
    path: str | None = None

    @classmethod
    def parse(cls, raw: dict) -> Find:
        path = raw.get("path")
        return cls(
            OneOf.parse(raw["type"], "type") if raw.get("type") is not None else None,
            Name.parse(raw["name"]) if raw.get("name") is not None else None,
            raw.get("id"),
            OneOf.parse(raw["label"], "label") if raw.get("label") is not None else None,
            path,
        )

    def on(self, node_type: Column, name: Column, label_: Column, path: Column | None = None, id_: Column | None = None) -> Column:
        out = F.lit(True)
        for selector, column in ((self.type, node_type), (self.name, name), (self.label, label_)):
            if selector is not None:
                out &= selector.on(column)
        if self.path is not None and path is not None:
            out &= path.contains(self.path)
        if self.id is not None and id_ is not None:
            out &= id_ == self.id
        return out


@dataclass(frozen=True)
class Connect:
    edge: OneOf
    direction: str = "outgoing"
    least: int = 1
    most: int = 1
    target: Find | None = None

    @classmethod
    def parse(cls, raw: dict) -> Connect:
        if "edge" not in raw:
            raise SpecError("connect: edge is needed")
        direction = raw.get("direction") or "outgoing"
        if direction not in DIRECTIONS:
            raise SpecError(f"connect: unknown direction {direction!r}")
        depth = raw.get("depth", 1)
        if isinstance(depth, dict):
            least, most = depth.get("min", 1), depth.get("max", depth.get("min", 1))
        else:
            least = most = depth
        if isinstance(least, bool) or isinstance(most, bool) or not isinstance(least, int) or not isinstance(most, int) or least < 0 or most < least:
            raise SpecError("connect: depth is a number or {min, max}")
        return cls(edge_selector(raw["edge"]), direction, least, most, Find.parse(raw["target"]) if raw.get("target") else None)


@dataclass(frozen=True)
class Filter:
    find: Find


@dataclass(frozen=True)
class SemanticFilter:
    like: str
    threshold: float = 0.3


@dataclass(frozen=True)
class Group:
    by: str


@dataclass(frozen=True)
class Sort:
    by: str
    descending: bool = False


@dataclass(frozen=True)
class Limit:
    count: int
    offset: int = 0


def parse_op(raw: dict) -> Any:
    kind = raw.get("op")
    if kind == "find":
        return Find.parse(raw)
    if kind == "connect":
        return Connect.parse(raw)
    if kind == "filter":
        return Filter(Find.parse({k: raw.get(k) for k in ("type", "label", "name")}))
    if kind == "semantic_filter":
        if not isinstance(raw.get("like"), str):
            raise SpecError("semantic_filter: like is needed")
        return SemanticFilter(raw["like"], float(raw.get("threshold", 0.3)))
    if kind in ("group", "sort"):
        if raw.get("by") not in SORT_KEYS:
            raise SpecError(f"{kind}: by is one of {', '.join(SORT_KEYS)}")
        if kind == "group":
            return Group(raw["by"])
        if raw.get("direction", "asc") not in ("asc", "desc"):
            raise SpecError("sort: direction is asc or desc")
        return Sort(raw["by"], raw.get("direction") == "desc")
    if kind == "limit":
        count, offset = raw.get("count"), raw.get("offset", 0)
        if not isinstance(count, int) or not isinstance(offset, int) or min(count, offset) < 0:
            raise SpecError("limit: count and offset are numbers from 0 on")
        return Limit(count, offset)
    raise SpecError(f"unknown operation {kind!r}")


@dataclass(frozen=True)
class Spec:
    ops: tuple = ()
    mode: str = "auto"
    named: str | None = None

    @classmethod
    def parse(cls, raw: str | dict) -> Spec:
        """A bare spec, or one below ``query`` or ``spec``; JSON text or what it stands for."""
        raw = json.loads(raw) if isinstance(raw, str) else raw
        if not isinstance(raw, dict):
            raise SpecError("a query is an object")
        for wrapper in ("query", "spec"):
            if isinstance(raw.get(wrapper), dict | str):
                return cls.parse(raw[wrapper])
        ops = raw.get("ops", [])
        if not isinstance(ops, list):
            raise SpecError("ops is a list")
        mode = raw.get("mode", "auto")
        if mode not in ("query", "tool", "auto"):
            raise SpecError(f"unknown mode {mode!r}")
        return cls(tuple(map(parse_op, ops)), mode, raw.get("named"))


@dataclass
class Result:
    """nodes (id, type, name, label) in order, groups (key, nodes, count) if asked for; counts are taken on demand."""

    nodes: DataFrame
    groups: DataFrame | None = None
    legacy: bool = False
    began: float = field(default_factory=time.monotonic)

    def count(self) -> int:
        return self.nodes.count()

    def to_json(self) -> str:
        rows = [r.asDict() for r in self.nodes.collect()]
        out: dict = {"nodes": rows, "edges": [], "paths": [], "count": len(rows), "legacy": self.legacy}
        if self.groups is not None:
            out["groups"] = [{"key": r["key"], "count": r["count"], "nodes": [n.asDict() for n in r["nodes"]]} for r in self.groups.orderBy("key").collect()]
        out["meta"] = {"execution_us": int(1e6 * (time.monotonic() - self.began)), "nodes_visited": len(rows), "plan": None}
        return json.dumps(out)


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("node_type").alias("type"), "name", label().alias("label"))


class Executor:
    """Runs specs on a graph; by default on what overlay and base make together."""

    def __init__(self, graph: PropertyGraph, base_only: bool = False, embed=None, model=None, on_demand: bool = True):
        """embed gives a query's vector; model those of a batch of nodes without one, by default by embed."""
        self.graph = graph.without_overlay() if base_only else graph.merged()
        self.embed = embed
        self.model = (model or (batches_of(embed) if embed else None)) if on_demand else None

    def run(self, spec: Spec | str | dict) -> Result:
        spec = spec if isinstance(spec, Spec) else Spec.parse(spec)
        if spec.named:
            from .named import named_ops

            ops = named_ops(spec.named)
            return Result(self._fold(ops)[0], legacy=True)
        nodes, groups = self._fold(spec.ops)
        return Result(nodes, groups)

    def _fold(self, ops) -> tuple[DataFrame, DataFrame | None]:
        nodes, groups = _shown(self.graph.nodes.where(F.lit(False))), None
        for op in ops:
            if isinstance(op, Group):
                groups = self.group(nodes, op)
            else:
                nodes = self.apply(nodes, op)
        return nodes, groups

    def apply(self, nodes: DataFrame, op: Any) -> DataFrame:
        if isinstance(op, Find):
            return _shown(self.graph.nodes.where(op.on(F.col("node_type"), F.col("name"), label(), F.col("path"), F.col("id"))))
        if isinstance(op, Connect):
            return self.connect(nodes, op)
        if isinstance(op, Filter):
            return nodes.where(op.find.on(F.col("type"), F.col("name"), F.col("label")))
        if isinstance(op, SemanticFilter):
            return self.semantic_filter(nodes, op)
        if isinstance(op, Sort):
            key = F.col(SORT_KEYS[op.by])
            return nodes.orderBy(key.desc_nulls_last() if op.descending else key.asc_nulls_first(), "id")
        if isinstance(op, Limit):
            return nodes.offset(op.offset).limit(op.count)
        raise TypeError(op)

    def connect(self, nodes: DataFrame, op: Connect) -> DataFrame:
        """Nodes at a distance from least to most along matching edges from any node of the set.

        A node's distance is the number of edges of the shortest walk of at least one edge; each direction is its
        own pass. A target drops nodes it doesn't fit from the result, not from the walk.
        """
        edges = self.graph.edges.where(op.edge.on(F.col("edge_type")))
        passes = ("outgoing", "incoming") if op.direction == "both" else (op.direction,)
        found = None
        for direction in passes:
            a, b = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
            steps = edges.select(F.col(a).alias("source"), F.col(b).alias("target")).distinct()
            met = reach(nodes.select("id"), steps, op.most, op.least).select("id")
            found = met if found is None else found.union(met)
        out = self.graph.nodes.join(found.distinct(), "id", "left_semi")
        if op.target is not None:
            out = out.where(op.target.on(F.col("node_type"), F.col("name"), label(), F.col("path"), F.col("id")))
        return _shown(out)

    def semantic_filter(self, nodes: DataFrame, op: SemanticFilter) -> DataFrame:
        """Nodes whose vector has a cosine over the threshold with that of the text; without embed, none.

        Nodes of the set that have no stored vector get one on demand, unless that was ruled out.
        """
        vector = self.embed(op.like) if self.embed else None
        if vector is None:
            return nodes.where(F.lit(False))
        near = self.graph.nodes.join(nodes.select("id"), "id", "left_semi")
        near = similarities(embed_nodes(near, self.model) if self.model else near, vector).where(F.col("similarity") > op.threshold)
        return nodes.join(near.select("id"), "id", "left_semi").select(*nodes.columns)

    def group(self, nodes: DataFrame, op: Group) -> DataFrame:
        """(key, count, nodes); a null key is an empty one."""
        key = F.coalesce(F.col(SORT_KEYS[op.by]), F.lit(""))
        return nodes.groupBy(key.alias("key")).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("id", "type", "name", "label"))).alias("nodes"))


def explain(spec: Spec | str | dict) -> list[str]:
    """The steps in words, and a warning where a connect has nothing to start from."""
    spec = spec if isinstance(spec, Spec) else Spec.parse(spec)
    out = []
    for i, op in enumerate(spec.ops, 1):
        if isinstance(op, Find):
            parts = [f"{k}={v}" for k, v in vars(op).items() if v is not None]
            out.append(f"{i}. find {' '.join(parts) or 'all nodes'}")
        elif isinstance(op, Connect):
            depth = str(op.most) if op.least == op.most else f"{op.least}..{op.most}"
            out.append(f"{i}. connect {op.edge} {op.direction} depth {depth}")
            if i == 1:
                out.append("warning: connect comes first, so it has no nodes to start from")
        elif isinstance(op, Filter):
            out.append(f"{i}. filter " + " ".join(f"{k}={v}" for k, v in vars(op.find).items() if v is not None))
        elif isinstance(op, SemanticFilter):
            out.append(f"{i}. semantic_filter like {op.like!r} over {op.threshold}")
        elif isinstance(op, Group):
            out.append(f"{i}. group by {op.by}")
        elif isinstance(op, Sort):
            out.append(f"{i}. sort by {op.by} {'desc' if op.descending else 'asc'}")
        elif isinstance(op, Limit):
            out.append(f"{i}. limit {op.count} offset {op.offset}")
    return out
