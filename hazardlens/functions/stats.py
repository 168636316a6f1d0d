"""Numbers: Wilson bound, rounding, model outputs, weights, hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def rate(positives: Column, total: Column) -> Column:
    return F.when(total > 0, positives / total).otherwise(F.lit(0.0))


def wilson(positives: Column, total: Column, z: float = fixed.Z) -> Column:
    """Lower bound of the Wilson interval, 0 for no rows and never below 0."""
    n, p = total.cast("double"), positives.cast("double") / total
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(total > 0, F.greatest((centre - margin) / (1 + z * z / n), F.lit(0.0))).otherwise(F.lit(0.0))


def probability(margin: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return 1 / (1 + F.exp(-margin / t))


def confidence(p: Column) -> Column:
    """How sure the winning class is; never under one half."""
    return F.greatest(p, 1 - p)


def positive_weight(positives: Column, total: Column) -> Column:
    return F.when(positives == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(fixed.POS_WEIGHT_CAP)), (total - positives) / positives))


def hash_bucket(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.encode(key.cast("string"), "utf-8")), F.lit(n))


def status(conf: Column, error: Column | None = None) -> Column:
    routed = F.when(conf >= fixed.CONFIDENCE_THRESHOLD, "processed").otherwise("needs_review")
    return routed if error is None else F.when(error.isNotNull(), "processing_failed").otherwise(routed)


def zero_safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def canonical(tags: Column) -> Column:
    """Known rules in display order."""
    return F.filter(F.array(*[F.lit(r) for r in fixed.RULES]), lambda r: F.array_contains(tags, r))


def multi_hot(tags: Column) -> Column:
    """A 0/1 vector over the rules; an unknown tag is an error."""
    known = F.array(*[F.lit(r) for r in fixed.RULES])
    vector = F.transform(known, lambda r: F.array_contains(tags, r).cast("int"))
    return F.when(F.size(F.array_except(tags, known)) > 0, F.raise_error(F.lit("unknown rule"))).otherwise(vector)


def over_threshold(scores: Column, threshold: float) -> Column:
    """``array<struct<rule_name, confidence>>`` of scores (by rule) at or over the threshold, surest first."""
    named = F.zip_with(F.array(*[F.lit(r) for r in fixed.RULES]), scores, lambda r, s: F.struct((-F.bround(s, 3)).alias("o"), r.alias("rule_name"), s.alias("s")))
    ranked = F.transform(F.filter(named, lambda x: x["s"] >= threshold), lambda x: F.struct(x["o"].alias("o"), F.array_position(F.array(*[F.lit(r) for r in fixed.RULES]), x["rule_name"]).alias("n"), x["rule_name"].alias("rule_name")))
    return F.transform(F.array_sort(ranked), lambda x: F.struct(x["rule_name"].alias("rule_name"), (-x["o"]).alias("confidence")))
