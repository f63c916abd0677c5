"""Selectors of the query language, as boolean columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import glob_pattern
from ..schema import EDGE_ALIASES


class SpecError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class OneOf:
    """One of some values, or none of them. A null is none of any values."""

    values: tuple[str, ...]
    negated: bool = False

    @classmethod
    def parse(cls, raw: Any, what: str, aliases: dict[str, str] | None = None) -> OneOf:
        negated = isinstance(raw, dict)
        if negated:
            if set(raw) != {"not"}:
                raise SpecError(f"{what}: only 'not' may be a key")
            raw = raw["not"]
        values = [raw] if isinstance(raw, str) else raw
        if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
            raise SpecError(f"{what}: a string or a list of strings is needed")
        return cls(tuple((aliases or {}).get(v, v) for v in values), negated)

    def on(self, column: Column) -> Column:
        found = F.coalesce(column.isin(*self.values), F.lit(False)) if self.values else F.lit(False)
        return ~found if self.negated else found

    def __str__(self) -> str:
        return ("not " if self.negated else "") + "|".join(self.values)


@dataclass(frozen=True)
class Name:
    """How a name must look: exact, glob, starts_with or ends_with."""

    kind: str
    value: str

    KINDS = {"exact": "exact", "glob": "glob", "starts_with": "starts_with", "startsWith": "starts_with", "ends_with": "ends_with", "endsWith": "ends_with"}

    @classmethod
    def parse(cls, raw: Any) -> Name:
        if isinstance(raw, str):
            return cls("exact", raw)
        if not isinstance(raw, dict) or len(raw) != 1:
            raise SpecError("name: a string or one of exact, glob, starts_with, ends_with is needed")
        ((key, value),) = raw.items()
        if key not in cls.KINDS or not isinstance(value, str):
            raise SpecError(f"name: unknown form {key!r}")
        return cls(cls.KINDS[key], value)

    def on(self, column: Column) -> Column:
        if self.kind == "exact":
            return column == self.value
        if self.kind == "glob":
            return column.rlike(glob_pattern(self.value))
        return column.startswith(self.value) if self.kind == "starts_with" else column.endswith(self.value)

    def __str__(self) -> str:
        return f"{self.kind} {self.value}"


def edge_selector(raw: Any) -> OneOf:
    return OneOf.parse(raw, "edge", EDGE_ALIASES)
