"""Relevance, confidence and decay formulas as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
SIM_WEIGHT, CONF_WEIGHT, RECENCY_WEIGHT, USAGE_WEIGHT = 0.65, 0.20, 0.10, 0.05
RECENCY_RATE = 0.01
TIER_FACTORS = {"T0": 1.2, "T1": 1.1, "T2": 1.0, "T3": 0.8}
SOURCE_WEIGHTS = {"user_direct": 1.0, "user_indirect": 0.7, "tool_api": 0.85, "system": 0.75, "agent_inference": 0.5, "agent_reflection": 0.5}
ARCHIVE_BELOW = 0.15
SKILL_GAIN, SKILL_LOSS, SKILL_FLOOR = 0.10, 0.85, 0.15
SKILL_START = 0.5
HOP_DECAY = 0.6
SIMILAR = 0.82

DAY = 86400.0


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a double; both timestamps without time zone."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(DAY * 1e6)


def recency(now: Column, updated_at: Column) -> Column:
    return F.exp(-RECENCY_RATE * F.greatest(F.lit(0.0), days_between(now, updated_at)))


def usage(count: Column, most: Column) -> Column:
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.log1p(count) / F.log1p(most))


def composite(similarity: Column, confidence: Column, recent: Column, used: Column) -> Column:
    return SIM_WEIGHT * similarity + CONF_WEIGHT * confidence + RECENCY_WEIGHT * recent + USAGE_WEIGHT * used


def tier_factor(tier: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in TIER_FACTORS.items():
        out = F.when(tier == name, F.lit(factor)).otherwise(out)
    return out


def bm25_similarity(rank: Column) -> Column:
    """A BM25 rank, negative and better when smaller, as a similarity in (0, 1)."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), rank))))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def decayed(confidence: Column, rate: Column, days: Column) -> Column:
    return F.when(rate == 0, confidence).otherwise(clamp01(confidence * F.exp(-rate * days)))


def bayes_update(prior: Column, prior_weight: Column, rate: Column, days: Column, source_weight: Column, observed: Column) -> Column:
    return clamp01((prior * prior_weight * F.exp(-rate * days) + source_weight * observed) / (prior_weight + 1))


def source_weight(source: Column, default: float = 0.5) -> Column:
    out = F.lit(default)
    for name, w in SOURCE_WEIGHTS.items():
        out = F.when(source == name, F.lit(w)).otherwise(out)
    return out


def skill_outcome(confidence: Column, success: Column) -> Column:
    return F.when(success, F.least(F.lit(1.0), confidence + SKILL_GAIN)).otherwise(confidence * SKILL_LOSS)


def approx_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return dot / (norm(a) * norm(b))


def fit_width(v: Column, width: int) -> Column:
    """v padded with zeros or cut to ``width`` components."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)
