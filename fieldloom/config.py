"""Settings of retrieval, one frozen record; values come from defaults, environment, then overrides."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: fixed values: BM25 constants, and the weight of each field; any other field weighs 1
BM25_K1, BM25_B = 1.5, 0.75
FIELD_WEIGHTS = {
    "reported_issue": 5.0, "fault_title": 5.0, "fault_code": 5.0, "file_name": 4.0, "part_name": 4.0, "part_number_name": 4.0, "part_code": 4.0,
    "part_number": 4.0, "fault_description": 4.0, "solution": 2.0, "chunk_text": 2.0, "remarks": 1.0, "raw_text": 1.0, "path_text": 1.0,
}
MODES = ("auto", "bm25", "hybrid")
#: fixed values: name parts that mark a secret setting
SECRET_NAMES = ("key", "token", "secret", "password")


def as_bool(x: object, default: bool = False) -> bool:
    if x is None or isinstance(x, bool):
        return default if x is None else x
    return str(x).strip().lower() in ("1", "true", "yes", "on", "y")


def optional_int(x: object) -> int | None:
    return None if x is None or str(x).strip() == "" else int(str(x))


def clamp(x: object, low: float, high: float) -> float:
    return min(max(float(x), low), high)


def parse_list(x: object) -> list[str]:
    parts = x.replace("\n", ",").split(",") if isinstance(x, str) else list(x or [])
    return [s for s in (str(p).strip() for p in parts) if s]


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """over wins; nested mappings merge."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def redact(x: object) -> object:
    """The same structure with the values of secret names as three asterisks; empty ones stay empty."""
    if isinstance(x, Mapping):
        return {k: "***" if v and any(s in str(k).lower() for s in SECRET_NAMES) and not isinstance(v, (Mapping, list)) and not str(k).lower().endswith("_env") else redact(v) for k, v in x.items()}
    return [redact(v) for v in x] if isinstance(x, list) else x


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "auto"
    work_order_mode: str = "auto"
    manual_mode: str = "auto"
    embeddings: bool = False
    provider: str = "hash"
    model: str = "hash-64"
    bm25_top_k: int = 20
    vector_top_k: int = 20
    hybrid_alpha: float = 0.75
    work_order_candidate_top_k: int = 50
    work_order_min_relative_score: float = 0.45
    work_order_max_hits: int = 10
    manual_candidate_top_k: int = 30
    manual_min_relative_score: float = 0.55
    manual_max_hits: int = 5

    def resolve(self, mode: str) -> str:
        """auto defers to the general mode, and that to whether embeddings exist; hybrid without them is bm25."""
        wanted = self.mode if mode == "auto" else mode
        if wanted not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        return "hybrid" if wanted in ("auto", "hybrid") and self.embeddings else "bm25"

    def mode_for(self, channel: str) -> str:
        return self.resolve(self.work_order_mode if channel == "work_orders" else self.manual_mode)

    def candidates(self, channel: str, top_k: int) -> int:
        deep = max(top_k, self.bm25_top_k)
        if channel == "work_orders":
            return max(deep, self.work_order_candidate_top_k, self.work_order_max_hits)
        return max(deep, self.manual_candidate_top_k, self.manual_max_hits) if channel == "manual_typical_faults" else deep

    def vector_depth(self, channel: str, top_k: int) -> int:
        return max(self.candidates(channel, top_k), self.vector_top_k)

    def cut(self, channel: str) -> tuple[float, int] | None:
        """(least relative score, most hits) of the channels that are cut; None for those that keep their top hits."""
        if channel == "work_orders":
            return clamp(self.work_order_min_relative_score, 0, 1), self.work_order_max_hits
        return (clamp(self.manual_min_relative_score, 0, 1), self.manual_max_hits) if channel == "manual_typical_faults" else None


def load(overrides: Mapping | None = None, env: Mapping[str, str] | None = None, prefix: str = "FIELDLOOM_") -> RetrievalConfig:
    """Defaults, then environment variables named prefix + FIELD, then overrides."""
    env = os.environ if env is None else env
    out = RetrievalConfig()
    for f in fields(out):
        for found in (env.get(prefix + f.name.upper()), (overrides or {}).get(f.name)):
            if found is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: as_bool(found) if kind is bool else kind(found)})
    return out
