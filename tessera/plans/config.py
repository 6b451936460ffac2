"""Configuration: a tree of defaults, a YAML file over it, and dotted settings over both."""

from __future__ import annotations

import copy
import itertools

import yaml

DEFAULTS = {
    "chunking": {"strategy": "paragraph", "chunk_size": 360, "chunk_overlap": 80, "prepend_title": False},
    "retrieval": {"candidate_k": 12, "top_k": 5, "hybrid": True, "vector_weight": 0.7, "bm25_weight": 0.3, "rrf_k": 60, "metric": "cosine"},
    "rerank": {"mode": "none", "weight": 0.45, "input_k": 0, "top_k": 5},
    "query": {"rules": False, "nlp": False, "llm": "none", "num_variants": 3},
    "crag": {"high": 0.6, "low": 0.3, "grade_k": 5},
}


def merged(base: dict, over: dict) -> dict:
    """A new tree: over's values, and base's where over has none."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def parsed(value: str):
    """A setting's text as a boolean, null, integer or float where it is one."""
    words = {"true": True, "false": False, "null": None}
    if value.lower() in words:
        return words[value.lower()]
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def with_settings(tree: dict, settings: list[str]) -> dict:
    """The tree with settings of the form a.b=c."""
    for s in settings:
        path, equals, value = s.partition("=")
        if not equals:
            raise ValueError(f"a setting has the form a.b=c: {s}")
        for key in reversed(path.split(".")):
            value = {key: value if isinstance(value, dict) else parsed(value)}
        tree = merged(tree, value)
    return tree


def load(text: str = "", settings: list[str] = ()) -> dict:
    return with_settings(merged(DEFAULTS, yaml.safe_load(text) or {}), list(settings))


def grid(vary: dict[str, list]) -> list[dict]:
    """Every combination of the values of dotted keys, as dictionaries."""
    return [dict(zip(vary, values, strict=True)) for values in itertools.product(*vary.values())]
