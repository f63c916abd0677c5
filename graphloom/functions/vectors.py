"""Vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for null or empty vectors, unlike lengths and zero norms."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(F.coalesce(usable, F.lit(False)), _dot(a, b) / norm).otherwise(F.lit(0.0))


def embedding_of(column: Column) -> Column:
    """A vector from its JSON text; null if it isn't a list of numbers."""
    return F.from_json(column, "array<float>")
