"""Settings of every operator, and how odd values are read."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    # rendering
    max_injected_tokens: float = 300
    max_item_tokens: float = 60
    chars_per_token: float = 2.5
    gist_budget_ratio: float = 0.3
    language: str = "zh"
    # self portrait
    self_portrait_enabled: bool = True
    self_portrait_max_tokens: float = 120
    self_portrait_max_items: int = 12
    self_portrait_max_self_observed: int = 4
    self_persona_max_tokens: float = 80
    self_portrait_merge_threshold: float = 0.6
    self_portrait_min_confidence: float = 0.8
    self_portrait_model_min_confidence: float = 0.85
    self_portrait_promote_sessions: int = 2
    self_reflect_enabled: bool = True
    self_reflect_every_turns: float = 12
    self_reflect_min_turn: float = 4
    self_reflect_max_per_session: float = 3
    self_intro_enabled: bool = True
    self_intro_min_turn: float = 2
    self_intro_max_asks: float = 2
    # replay
    sleep_sessions: int = 3
    sleep_max_chars_per_session: float = 120_000
    sleep_max_chars_total: float = 300_000
    sleep_max_backfill: float = 20
    sleep_assistant_context: float = 3
    sleep_max_gists: float = 8
    # references, approval, branches, audit
    refs_enabled: bool = True
    refs_max: float = 5
    write_policy: str = "auto"
    pending_max: float = 50
    branch_aware: bool = True
    audit_max: float = 50
    # embeddings
    embedder_recall_mode: str = "off"
    embedder_weight: float = 0.5
    # retrieval
    search_stemming: bool = True
    search_bigram: bool = True
    search_length_penalty: float = 0.3
    recall_top_k: int = 8
    recall_min_query_chars: int = 12
    recall_min_hits: int = 2
    recall_min_match: float = 0.4
    recall_cooldown_turns: int = 3
    # capture and writing
    capture_mode: str = "rule"
    pii_policy: str = "mask"
    repeat_mention_boost: float = 0.1
    capture_max_per_turn: int = 3
    capture_min_confidence: float = 0.6
    capture_per_hour: int = 20
    echo_threshold: float = 0.9
    gist_min_markers: float = 2
    trust_tool_writes: bool = False
    # governance
    consolidate_max_records: int = 200
    consolidate_interval_minutes: int = 30
    merge_similarity: float = 0.7
    archive_after_days: float = 180
    archive_below_importance: float = 0.15
    summarize_above: int = 5
    solidification_max_per_compaction: int = 3

    def with_(self, **changes: Any) -> Config:
        return replace(self, **changes)

    @classmethod
    def from_spark(cls, spark, prefix: str = "spark.memlake.") -> Config:
        """Settings from the session's configuration, under a prefix (`spark.memlake.recall_top_k`)."""
        out = {}
        for f in fields(cls):
            value = spark.conf.get(prefix + f.name, None)
            if value is not None:
                kind = type(f.default)
                out[f.name] = value.lower() == "true" if kind is bool else kind(value)
        return cls(**out)


DEFAULTS = Config()


def budget(value: Any, fallback: float) -> float:
    """Budgets must be finite and positive."""
    ok = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and value > 0
    return value if ok else fallback


def cap(value: Any, fallback: float) -> float:
    """Caps may be 0 (off) or infinite."""
    ok = isinstance(value, int | float) and not isinstance(value, bool) and not math.isnan(value) and value >= 0
    return value if ok else fallback


def refs_max(cfg: Config) -> float:
    return cap(cfg.refs_max, DEFAULTS.refs_max)


def pending_max(cfg: Config) -> float:
    """0 or less: no limit; not finite: the default."""
    return cfg.pending_max if isinstance(cfg.pending_max, int | float) and math.isfinite(cfg.pending_max) else DEFAULTS.pending_max


def audit_max(cfg: Config) -> int:
    ok = isinstance(cfg.audit_max, int | float) and math.isfinite(cfg.audit_max) and cfg.audit_max >= 0
    return int(cfg.audit_max if ok else DEFAULTS.audit_max)


def length_penalty(cfg: Config) -> float:
    v = cfg.search_length_penalty
    return v if isinstance(v, int | float) and math.isfinite(v) and v >= 0 else DEFAULTS.search_length_penalty


def blend_weight(cfg: Config) -> float:
    v = cfg.embedder_weight
    return v if isinstance(v, int | float) and math.isfinite(v) and 0 <= v <= 1 else DEFAULTS.embedder_weight


def write_policy(cfg: Config) -> str:
    text = cfg.write_policy.strip().lower() if isinstance(cfg.write_policy, str) else ""
    return text if text in ("ask", "off") else "auto"


def language(value: Any) -> str:
    return "en" if isinstance(value, str) and value.strip().lower() == "en" else "zh"
