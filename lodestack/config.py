"""Configuration of an index: defaults and merging."""

from __future__ import annotations

import copy

#: Defaults (fixed values).
DEFAULT_CONFIG = {
    "text_search_config": "english",
    "embedding": {"provider": "bedrock", "model": "amazon.titan-embed-text-v2:0", "dimensions": 1024},
    "field_weights": {"title": 3.0, "body": 1.0},
    "rrf_k": 60,
    "rrf_weights": {"lexical": 1.0, "vector": 1.0},
    "kind_weights": {},
    "min_lexical_score": 0,
    "min_vector_score": 0,
    "max_segment_tokens": 1000,
    "max_segments_per_document": 150,
}
DEEP = ("embedding", "field_weights", "rrf_weights")


def merge_config(overrides: dict, base: dict | None = None) -> dict:
    """base with overrides; only the parts of DEEP are merged within, all others are replaced whole."""
    base = DEFAULT_CONFIG if base is None else base
    merged = copy.deepcopy({**base, **overrides})
    for part in DEEP:
        merged[part] = {**(base.get(part) or DEFAULT_CONFIG[part]), **(overrides.get(part) or {})}
    return merged
