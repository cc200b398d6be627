"""Importance and relevance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.options import IMPORTANCE_BOOST, LEVEL_SCORES, Scoring


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, which least and greatest alone would skip."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def recency_boost(updated: Column, as_of: Column) -> Column:
    days = days_between(as_of, updated)
    return F.when(days <= 1, 0.08).when(days <= 7, 0.05).otherwise(0.0)


def relevance(distance: Column, importance: Column, updated: Column, score: Column, as_of: Column) -> Column:
    """1 - d/2 with an importance boost (numeric score first, else the named level) and a recency boost."""
    levels = F.create_map(*[F.lit(x) for kv in IMPORTANCE_BOOST.items() for x in kv])
    boost = F.when(score.isNotNull(), (score - 0.5) * 0.24).otherwise(F.coalesce(F.try_element_at(levels, importance), F.lit(0.0)))
    return clamp(1.0 - clamp(distance, 0.0, 2.0) / 2.0 + boost + recency_boost(updated, as_of))


def cosine_distance(a: Column, b: Column) -> Column:
    """0..2 in double precision (V2); null for null, empty or unequally long vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), clamp(1.0 - dot(a, b) / F.greatest(norms, F.lit(1e-30)), 0.0, 2.0))


def type_weight(kind: Column, options: Scoring = Scoring()) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in options.weights.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, kind), F.lit(options.weights.get("unknown", 0.5)))


def concept_bonus(content: Column, options: Scoring = Scoring()) -> Column:
    """Sum of the bonuses of the patterns that occur, capped; case does not matter."""
    total = F.lit(0.0)
    for pattern, bonus in options.concepts:
        total = total + F.when(content.rlike("(?i)" + pattern), bonus).otherwise(0.0)
    return F.least(total, F.lit(options.concept_cap))


def recency_bonus(created: Column, as_of: Column, options: Scoring = Scoring()) -> Column:
    if options.half_life_days <= 0:
        return F.lit(0.0)
    days = F.greatest(days_between(as_of, created), F.lit(0.0))
    return F.when(created.isNotNull(), F.round(F.lit(options.recency_max) * F.exp(-0.693 * days / options.half_life_days), 4)).otherwise(0.0)


def retrieval_bonus(count: Column, options: Scoring = Scoring()) -> Column:
    return F.when(count > 0, F.least(F.lit(options.retrieval_max), F.round(F.log2(count + 1) / 10, 4))).otherwise(0.0)


def named_importance(text: Column) -> Column:
    """A number, clamped; else a named level; else null."""
    levels = F.create_map(*[F.lit(x) for kv in LEVEL_SCORES.items() for x in kv])
    return F.coalesce(clamp(text.try_cast("double")), F.try_element_at(levels, F.lower(F.trim(text))))


def importance(content: Column, kind: Column, stated: Column, created: Column, retrievals: Column, as_of: Column, options: Scoring = Scoring()) -> Column:
    return importance_with(concept_bonus(content, options), kind, stated, created, retrievals, as_of, options)


def importance_with(concepts: Column, kind: Column, stated: Column, created: Column, retrievals: Column, as_of: Column, options: Scoring = Scoring()) -> Column:
    """importance() from a concept bonus that is there already, so that no text need pass a join."""
    base = F.coalesce(named_importance(stated), type_weight(kind, options))
    return clamp(base + concepts + recency_bonus(created, as_of, options) + retrieval_bonus(retrievals, options))


def level(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")
