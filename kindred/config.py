"""Settings of the engine, overridable by environment variables KINDRED_<NAME>."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace

#: weight of a tag by category; other categories weigh 1.0; 0.0 leaves a tag out. Fixed values.
CATEGORY_WEIGHTS = {0: 1.0, 1: 0.3, 3: 1.5, 4: 2.5, 5: 2.0, 6: 0.0, 7: 0.5, 8: 1.2}
#: (weight of collaborative vectors, weight of tag vectors) by mode. Fixed values.
WEIGHT_PRESETS = {"favorites": (1.0, 0.3), "tags": (0.3, 1.0)}
MODE_NAME = re.compile(r"[a-zA-Z0-9_-]+")


@dataclass(frozen=True)
class EngineConfig:
    model_dir: str = "models"
    weight_presets: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(WEIGHT_PRESETS))
    embedding_dim: int = 64
    n_top_tags: int = 100
    excluded_tags: frozenset[str] = frozenset()
    category_weights: dict[int, float] = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))
    m_shared_tags: int = 6
    sgd_lr: float = 0.01
    sgd_reg: float = 0.001
    max_norm: float = 10.0
    keep_versions: int = 3
    retention_days: int = 14
    seed: int = 42

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> EngineConfig:
        env, out = dict(os.environ if env is None else env), EngineConfig()
        for f in fields(EngineConfig):
            raw = env.get(f"KINDRED_{f.name.upper()}")
            if raw is None:
                continue
            now = getattr(out, f.name)
            if isinstance(now, frozenset):
                value = frozenset(json.loads(raw))
            elif f.name == "category_weights":
                value = {int(k): float(v) for k, v in json.loads(raw).items()}
            elif isinstance(now, dict):
                value = {k: tuple(v) for k, v in json.loads(raw).items()}
            else:
                value = type(now)(raw)
            out = replace(out, **{f.name: value})
        return out


def checked_mode(mode: str) -> str:
    """The mode, if its name can be part of a path."""
    if not MODE_NAME.fullmatch(mode):
        raise ValueError(f"invalid mode name: {mode!r}")
    return mode
