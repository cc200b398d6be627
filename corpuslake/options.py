"""Operator options: thresholds, weights and word tables, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Content types, tiers, type weights, concept bonuses, synonyms, intents, prompts that need no search.
DURABLE_TYPES = ("vault", "memory")
EPHEMERAL_TYPES = ("observation", "pattern", "learning", "decision", "summary", "code", "relationship", "hint", "plan", "worklog")
ALL_TYPES = DURABLE_TYPES + EPHEMERAL_TYPES
EPHEMERAL_PREFIXES = ("obs", "pattern", "summary", "code", "rel", "hint", "plan", "learning", "decision", "worklog")
TYPE_WEIGHTS = {"journal": 0.65, "note": 0.55, "work": 0.60, "inbox": 0.3, "incident-log": 0.7, "decision": 0.8, "unknown": 0.5}
CONCEPTS = ((r"\b(decision|architecture|design)\b", 0.1), (r"\b(incident|outage|postmortem)\b", 0.15), (r"\b(TODO|FIXME|HACK)\b", 0.05))
IMPORTANCE_BOOST = {"critical": 0.12, "high": 0.10, "medium": 0.0, "low": -0.05}
LEVEL_SCORES = {"critical": 0.95, "high": 0.8, "medium": 0.5, "low": 0.3}
SYNONYMS = {
    "auth": ("authentication", "authorization", "login", "oauth"),
    "db": ("database", "postgres", "sqlite", "sql"),
    "k8s": ("kubernetes", "cluster", "pods", "deployment"),
    "config": ("configuration", "settings", "environment", "env"),
    "api": ("endpoint", "rest", "http", "request"),
    "deploy": ("deployment", "release", "ci/cd", "pipeline"),
    "test": ("testing", "pytest", "unittest", "spec"),
    "bug": ("error", "issue", "defect", "fix"),
    "perf": ("performance", "optimization", "latency", "speed"),
    "ui": ("interface", "frontend", "component", "react"),
    "infra": ("infrastructure", "terraform", "cloud", "aws"),
    "doc": ("documentation", "readme", "guide", "docs"),
    "sec": ("security", "vulnerability", "cve", "audit"),
    "monitor": ("monitoring", "observability", "metrics", "alerting"),
    "log": ("logging", "logs", "trace", "debug"),
}
INTENTS = (
    (r"\bhow\s+(?:to|do|can)\b", "how-to", ("guide", "steps", "tutorial")),
    (r"\bwhy\s+(?:did|do|was|is)\b", "rationale", ("reason", "decision", "rationale")),
    (r"\bwhen\s+(?:did|was|will)\b", "timeline", ("date", "timeline", "history")),
    (r"\bshould\s+(?:i|we)\b", "decision", ("decision", "tradeoff", "recommendation")),
)
CONFIRMATIONS = ("yes", "no", "ok", "sure", "thanks", "thank you", "go ahead", "done", "next", "continue", "correct", "right", "got it", "sounds good", "perfect", "great", "fine", "agreed", "yep", "nope", "nah", "yeah", "yup", "okay")
SELF_PROMPT = "analyzing a conversation turn between a user and an AI assistant"
#: Secret shapes; our own table, each with a name.
SECRETS = (("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"), ("assigned_token", r"(?i)\b(?:token|secret|api_key)\s*=\s*\"[0-9a-f]{32,}\""), ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"))


@dataclass(frozen=True)
class Scoring:
    weights: dict = field(default_factory=lambda: dict(TYPE_WEIGHTS))
    concepts: tuple = CONCEPTS
    concept_cap: float = 0.2
    recency_max: float = 0.1
    half_life_days: float = 7.0
    retrieval_max: float = 0.1


@dataclass(frozen=True)
class Search:
    n_results: int = 5
    most_results: int = 20
    overfetch: int = 3
    most_fetched: int = 60
    threshold: float = 0.5
    budget: int = 8000
    reference_cost: int = 120
    least_cost: int = 50


@dataclass(frozen=True)
class Chunking:
    levels: tuple = (2, 3)
    most_chars: int = 1500
    least_chars: int = 200


@dataclass(frozen=True)
class Promotion:
    importance: float = 0.85
    retrievals: float = 3.0
    age_days: int = 30
    age_importance: float = 0.7


@dataclass(frozen=True)
class Mining:
    least_turn_chars: int = 200
    short_turn_chars: int = 150
    base_budget: int = 2000
    budget_per_token: float = 0.04
    most_budget: int = 8000
    dollars_in: float = 1.0
    dollars_out: float = 5.0
    most_observations: int = 3
