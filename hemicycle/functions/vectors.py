"""Distances and scores over ARRAY<DOUBLE> columns, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemicycle.functions.clean import col

_ZERO = F.lit


def total(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def proportions(v) -> Column:
    """Clipped at 0 and divided by the sum; a zero vector becomes uniform."""
    clipped = F.transform(col(v), lambda x: F.greatest(x, F.lit(0.0)))
    s = total(clipped)
    return F.when(s > 0, F.transform(clipped, lambda x: x / s)).otherwise(F.transform(col(v), lambda x: F.lit(1.0) / F.size(col(v))))


def _divergence(p: Column, m: Column) -> Column:
    return total(F.zip_with(p, m, lambda x, y: F.when((x > 0) & (y > 0), x * F.log2(x / y)).otherwise(0.0)))


def js_distance(a, b) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two vectors' proportions."""
    p, q = proportions(a), proportions(b)
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), (_divergence(p, m) + _divergence(q, m)) / 2))


def cosine_similarity(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def cosine_distance(a, b) -> Column:
    """1 - cosine; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(0.0)


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def entropy(v, base2: bool = False, floor: float = 1e-12) -> Column:
    """Natural logarithm with values held above a floor, or base 2 over the positive ones."""
    if base2:
        return -total(F.transform(col(v), lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))
    return -total(F.transform(col(v), lambda x: F.greatest(x, F.lit(floor)) * F.ln(F.greatest(x, F.lit(floor)))))


def argmax(v) -> Column:
    """Index of the greatest, the first of equals."""
    return (F.array_position(col(v), F.array_max(col(v))) - 1).cast("int")


def top_two(v) -> Column:
    s = F.sort_array(col(v), asc=False)
    return F.struct(F.get(s, F.lit(0)).alias("first"), F.get(s, F.lit(1)).alias("second"))


def expected_index(v) -> Column:
    """Sum of i * p over sum of p; null for a zero vector."""
    weighted = total(F.transform(col(v), lambda x, i: x * i))
    return F.try_divide(weighted, F.nullif(total(v), F.lit(0.0)))


def tempered(v, temperature: float) -> Column:
    """Probabilities re-scaled by a temperature."""
    e = F.transform(col(v), lambda x: F.exp(F.ln(F.greatest(x, F.lit(1e-12))) / temperature))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def pad(v, n: int) -> Column:
    """Cut or filled with zeros to n."""
    return F.slice(F.concat(F.coalesce(col(v), F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def contradiction(js, flip) -> Column:
    """struct(entailment, contradiction, neutral, raw), each within [0, 1]; a missing distance or flip is 0."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    j, f = (F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in (js, flip))
    entail, contra = clip(1 - j), clip(0.7 * j + 0.3 * f)
    return F.struct(entail.alias("entailment"), contra.alias("contradiction"), clip(1 - entail - contra).alias("neutral"), clip(0.6 * contra + 0.3 * j + 0.1 * f).alias("raw"))


def feature_vector(signals: Sequence[str], topics: str, rhetoric: Sequence[str], length: str, recency_days: str, kind: str, kinds: Sequence[str], n_topics: int = 100) -> Column:
    """Signals, topics cut or filled to n_topics, rhetoric, log length, years, one-hot kind; missing is 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.concat(
        F.array(*map(zero, signals)), pad(topics, n_topics), F.array(*map(zero, rhetoric)), F.array(F.log1p(zero(length)), zero(recency_days) / 365.25), F.array(*(F.when(F.col(kind) == k, 1.0).otherwise(0.0) for k in kinds))
    )
