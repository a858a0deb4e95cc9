"""Score functions of the fused ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RecencyRule:
    kinds: tuple[str, ...]
    half_life_days: float
    floor: float


def rrf(lexical_rank: Column, vector_rank: Column, k: float, lexical_weight: float = 1.0, vector_weight: float = 1.0) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + rank), F.lit(0.0))
    return part(lexical_weight, lexical_rank) + part(vector_weight, vector_rank)


def kind_weight(kind: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    return F.when(kind.isNull(), F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit(1.0)))


def recency_multiplier(rule: RecencyRule | None, kind: Column, published_at: Column, now: Column) -> Column:
    """Decays from 1 towards the rule's floor with age; neutral without a rule, a listed kind or a date that parses."""
    if rule is None:
        return F.lit(1.0)
    then = F.try_to_timestamp(published_at)
    days = F.greatest((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400e6), F.lit(0.0))
    decayed = F.lit(rule.floor) + F.lit(1 - rule.floor) * F.pow(F.lit(2.0), -days / F.lit(float(rule.half_life_days)))
    return F.when(kind.isin(*rule.kinds) & then.isNotNull(), decayed).otherwise(F.lit(1.0))
