"""A run's settings and a request's answer schema, checked on the driver before any task starts."""

from __future__ import annotations

import copy
from dataclasses import dataclass

STRATEGIES = ("auto", "direct", "hierarchical")


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; what can't be is an error that names the field."""

    strategy: str = "auto"
    target_words: int = 300
    max_output_tokens: int = 4096
    context_window: int | None = None
    margin_floor: int = 256
    margin_share: float = 0.05
    segment_tokens: int | None = None
    overlap_tokens: int = 0
    merge_ceiling: int | None = None
    max_in_flight: int = 1
    verify: bool = True

    def __post_init__(self):
        for name in ("target_words", "max_output_tokens", "max_in_flight"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("context_window", "segment_tokens"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        if not 0 <= self.margin_share < 1 or self.margin_floor < 0:
            raise ValueError("margin_share must be from 0 to below 1 and margin_floor not negative")
        if self.overlap_tokens < 0 or (self.segment_tokens is not None and self.overlap_tokens >= self.segment_tokens):
            raise ValueError("overlap_tokens must be less than segment_tokens")
        if self.merge_ceiling is not None and self.merge_ceiling < 2:
            raise ValueError("merge_ceiling must be at least 2")


def narrowed(schema: dict, *, segment_ids: list[str] | None = None, quotes: list[str] | None = None, level: int | None = None) -> dict:
    """A JSON schema that allows only these segment ids, quotations and level, wherever properties of those names are; the given one isn't changed."""
    allowed = {"segment_id": {"enum": segment_ids}, "quote": {"enum": quotes}, "level": {"const": level}}
    allowed = {k: v for k, v in allowed.items() if next(iter(v.values())) is not None}

    def walk(node):
        if isinstance(node, dict):
            for name, sub in (node.get("properties") or {}).items():
                if name in allowed:
                    sub.update(copy.deepcopy(allowed[name]))
            for sub in node.values():
                walk(sub)
        elif isinstance(node, list):
            for sub in node:
                walk(sub)

    out = copy.deepcopy(schema)
    walk(out)
    return out
