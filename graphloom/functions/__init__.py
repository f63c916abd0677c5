"""Scalar functions, as column expressions."""

from .ids import node_id
from .text import (
    age_text, camel_case, enriched_text, file_name, freshness, glob_pattern, is_common_name, is_trait_path, label,
    parent_dir, return_type, semantic_candidate, snake_case, token_estimate, truncate_words,
)
from .vectors import cosine, embedding_of

__all__ = [
    "age_text", "camel_case", "cosine", "embedding_of", "enriched_text", "file_name", "freshness", "glob_pattern",
    "is_common_name", "is_trait_path", "label", "node_id", "parent_dir", "return_type", "semantic_candidate",
    "snake_case", "token_estimate", "truncate_words",
]
