"""Named bundles of retrieval parameters and the steps of an ingest."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Preset:
    """How a batch of queries is answered."""

    name: str
    route_mode: str = "text"
    retrieval_k: int = 150
    final_top_k: int = 10
    context_tokens: int = 10_000
    min_score_ratio: float = 1.0
    visual_bonus: str = "none"
    visual_weight: float = 2.5
    image_output: bool = False
    rrf_k: int = 10


# The tested combinations.
PRESETS = {
    p.name: p
    for p in (
        Preset("extra-low", min_score_ratio=0.2),
        Preset("low", min_score_ratio=0.4),
        Preset("medium", retrieval_k=80, final_top_k=20),
        Preset("high", final_top_k=80, context_tokens=16_000),
        Preset("low-with-image-input", min_score_ratio=0.4, image_output=True),
        Preset("medium-with-image-input", retrieval_k=80, final_top_k=20, image_output=True),
        Preset("medium-with-visual-recall", route_mode="text-visual-naive", final_top_k=20, visual_bonus="page-naive", visual_weight=1.0),
    )
}

ALIASES = {"compact": "low", "default": "low", "high-recall": "high", "compact-with-image-input": "low-with-image-input", "default-with-image-input": "low-with-image-input", "visual-recall": "medium-with-visual-recall"}


def resolve(name: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "FOLIANT_") -> Preset:
    """A preset with what the environment sets on top."""
    env = os.environ if env is None else env
    name = env.get(f"{prefix}PRESET", name or "medium")
    name = ALIASES.get(name.strip(), name.strip())
    if name not in PRESETS:
        raise ValueError(f"preset must be one of {sorted(PRESETS)}")
    preset, changes = PRESETS[name], {}
    for f in fields(Preset):
        raw = env.get(prefix + f.name.upper())
        if raw is not None and f.name != "name":
            kind = type(getattr(preset, f.name))
            changes[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return replace(preset, **changes)


STAGES = ("parse", "section", "patch", "caption", "chunk", "tag", "index")


def stage_slice(first: str = STAGES[0], last: str = STAGES[-1], *, tagging: bool = True) -> tuple[str, ...]:
    """The stages from first to last, tagging only if it is asked for (Q1)."""
    a, b = STAGES.index(first), STAGES.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return tuple(s for s in STAGES[a : b + 1] if s != "tag" or tagging)
