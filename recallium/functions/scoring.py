"""Scores as Column expressions: similarity, decay, boosts, intervals, bucketing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n)).otherwise(F.transform(a, lambda v: v.cast("double")))


def cls_pool(tokens: Column) -> Column:
    """The first token's vector, at length 1."""
    return _unit(F.transform(tokens[0], lambda v: v.cast("double")))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the vectors of unmasked tokens (mask above 0), at length 1; zeros where all are masked.

    A fold over the tokens inside the row: no explode, no shuffle.
    """
    weighed = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda v: v.cast("double") * m))
    total = F.aggregate(F.slice(weighed, 2, 1 << 30), weighed[0], lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))
    return _unit(F.transform(total, lambda v: v / count))


def _unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def age_days(captured_at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", captured_at, now) / F.lit(86400e6))


def time_decay(base: Column, captured_at: Column, salience: Column, pinned: Column, now: Column, days: float = 30.0, floor: float = 0.1) -> Column:
    """base x (0.5 + salience) x max(floor, e^(-age / days)) x 1.5 if pinned."""
    decay = F.greatest(F.lit(floor), F.exp(-age_days(captured_at, now) / days))
    return base * (0.5 + F.coalesce(salience, F.lit(0.5))) * decay * F.when(pinned, 1.5).otherwise(1.0)


def decay_reasons(captured_at: Column, salience: Column, pinned: Column, now: Column, days: float = 30.0, floor: float = 0.1) -> Column:
    age = age_days(captured_at, now)
    decay = F.greatest(F.lit(floor), F.exp(-age / days))
    return F.filter(F.array(F.when(pinned, "pinned"), F.when(salience > 0.7, F.format_string("high_salience:%.2f", salience)), F.when(age > 0, F.format_string("decay:%.2fx", decay))), lambda x: x.isNotNull())


def entity_matches(mine: Column, asked: Column) -> Column:
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return F.array_sort(F.array_distinct(F.array_intersect(low(mine), low(asked))))


def entity_boost(base: Column, mine: Column, asked: Column, each: float = 0.3, most: float = 1.0) -> Column:
    n = F.coalesce(F.size(entity_matches(mine, asked)), F.lit(0))
    return base * (1.0 + F.least(F.greatest(n, F.lit(0)) * each, F.lit(most)))


def rerank_score(score: Column, salience: Column, pinned: Column, captured_at: Column, now: Column) -> Column:
    """The score after a cross-encoder: mild salience, no decay but for 90 days; a salience of 0 counts as 0.5."""
    s = F.when(F.coalesce(salience, F.lit(0.0)) == 0, 0.5).otherwise(salience)
    return score * (0.925 + 0.15 * s) * F.when(age_days(captured_at, now) < 90, 1.0).otherwise(0.95) * F.when(pinned, 1.5).otherwise(1.0)


def next_salience(s: Column, step: float = 0.1) -> Column:
    """One recall's bump, kept in [0, 1], to six places."""
    s = F.least(F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.round(s + step * (1.0 - s), 6)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, to three places."""
    n = n.cast("double")
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.round(F.greatest(F.lit(0.0), mid - half), 3), F.round(F.least(F.lit(1.0), mid + half), 3)


def hash_modulo(text: Column, modulus: int) -> Column:
    """The 256-bit SHA-256 of a text modulo a number below 2**31, folded digit by digit."""
    digits = F.split(F.sha2(text, 256), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda r, d: F.when(d == "", r).otherwise((r * 16 + F.conv(d, 16, 10).cast("long")) % modulus))


def variant_of(user: Column, experiment: Column, weights: list[tuple[str, int]]) -> Column:
    """The variant whose cumulative share first reaches the user's bucket; the bound itself belongs to it."""
    total = sum(w for _, w in weights)
    bucket = hash_modulo(F.concat_ws(":", user.cast("string"), experiment.cast("string")), total)
    out, cum = None, 0
    for name, w in weights:
        cum += w
        hit = bucket <= cum
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(weights[0][0])
