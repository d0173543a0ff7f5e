"""Settings of the engine, passed explicitly."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    max_memories: int = 1_000_000
    similarity_threshold: float = 0.14
    max_results: int = 10
    recency_weight: float = 0.05
    importance_weight: float = 0.25
    activation_weight: float = 0.1
    supersedes_demotion: float = 0.40
    graph_hops: int = 2
    graph_anchors: int = 20
    rrf_k: int = 60
    lsh_tables: int = 16
    lsh_bits: int = 10
    min_candidates: int = 5
    half_life_secs: float = 604_800.0
    prune_below: float = 0.01
    duplicate_threshold: float = 0.95
    max_labels: int = 10
    score_cap: float = 0.50
    diversity_cap: int = 3
    power_law: bool = True
    actr: bool = False
    rescue_only: bool = True
    max_bytes: int = 0
    embedding_dim: int = 384


DEFAULT = Config()
#: Lengths of known embedders' vectors by a part of their name, in order of precedence.
MODEL_DIMS = (
    ("bge-small", 384), ("bge-base", 768), ("bge-large", 1024), ("bge-m3", 1024), ("gte-large", 1024), ("gte-base", 768), ("minilm-l6", 384), ("minilm-l12", 384),
    ("text-embedding-3-small", 1536), ("text-embedding-3-large", 3072), ("text-embedding-ada", 1536), ("nomic-embed-text", 768), ("mxbai-embed-large", 1024), ("all-minilm", 384), ("snowflake-arctic-embed", 1024),
)


def model_dim(model: str, config: "Config | None" = None) -> int:
    """Length of a model's vectors by its name, else what is configured."""
    return next((dim for part, dim in MODEL_DIMS if part in model.lower()), (config or DEFAULT).embedding_dim)


#: Presets by size of the store.
PRESETS = {
    "minimal": replace(DEFAULT, max_memories=100_000, similarity_threshold=0.16),
    "standard": replace(DEFAULT, max_memories=500_000),
    "full": DEFAULT,
    "maximum": replace(DEFAULT, max_memories=5_000_000),
}


def loaded(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "ANAMNESIS_", base: Config = DEFAULT) -> Config:
    """Defaults, then a TOML file, then environment variables (prefix and the field's name in capitals). Unknown keys are left out."""
    told: dict = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            told |= tomllib.load(f)
    env = os.environ if environ is None else environ
    told |= {f.name: env[prefix + f.name.upper()] for f in fields(Config) if prefix + f.name.upper() in env}

    def cast(name: str, value):
        kind = type(getattr(base, name))
        return str(value).strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)

    return replace(base, **{k: cast(k, v) for k, v in told.items() if k in {f.name for f in fields(Config)}})
