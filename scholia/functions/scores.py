"""Scores and conditional lookups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least citations by tier and age in years (4: four and more).
TIER_BASE = {"tier1": [3, 5, 8, 12, 15], "tier2": [2, 4, 6, 9, 12], "tier3": [1, 3, 5, 7, 10], "tier4": [1, 2, 3, 5, 7]}
# Velocity at least -> score; age in years up to -> score; weights.
VELOCITY = [(50, 1.0), (20, 0.8), (10, 0.6), (5, 0.4), (2, 0.2)]
RECENCY = [(1, 1.0), (2, 0.8), (3, 0.6), (5, 0.4)]
BREAKTHROUGH = {"velocity": 0.3, "keywords": 0.25, "authors": 0.2, "venue": 0.15, "recency": 0.1}
TIER_WEIGHT = {"tier1": 1.0, "tier2": 0.8, "tier3": 0.6, "tier4": 0.4}


def ladder(c: Column, steps: list[tuple[float, float]], otherwise: float = 0.0, least: bool = True) -> Column:
    """The value of the first step that ``c`` reaches (or stays under)."""
    out = None
    for bound, value in steps:
        test = c >= bound if least else c <= bound
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def base_threshold(tier: Column, year: Column, as_of_year: int) -> Column:
    """An unknown tier counts as tier4."""
    age = F.greatest(F.lit(0), F.least(F.lit(as_of_year) - year, F.lit(4))).cast("int")
    rows = F.create_map(*[x for k, v in TIER_BASE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.element_at(F.coalesce(F.element_at(rows, tier), F.array(*map(F.lit, TIER_BASE["tier4"]))), age + 1)


def adaptive_threshold(base: Column, p75: Column, p70: Column, most: Column, floor: int = 1) -> Column:
    """.6 of the 75th percentile and .4 of the base, cut to an integer, at most
    the 70th percentile; the largest count if all lie under the floor."""
    mixed = F.least((0.6 * p75 + 0.4 * base).cast("long"), p70.cast("long"))
    mixed = F.when((mixed >= floor) & (most < floor), most).otherwise(mixed)
    return F.greatest(mixed, F.lit(0)).cast("long")


def velocity(citations: Column, year: Column, as_of_year: int) -> Column:
    return F.when(citations > 0, citations / F.greatest(F.lit(1), F.lit(as_of_year) - F.coalesce(year, F.lit(as_of_year)))).otherwise(0.0)


def breakthrough(citations: Column, year: Column, keywords: Column, known_authors: Column, tier: Column, as_of_year: int) -> Column:
    age = F.greatest(F.lit(1), F.lit(as_of_year) - F.coalesce(year, F.lit(as_of_year)))
    prestige = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TIER_WEIGHT.items() for x in p]), tier), F.lit(TIER_WEIGHT["tier4"]))
    w = BREAKTHROUGH
    score = (w["velocity"] * ladder(velocity(citations, year, as_of_year), VELOCITY) + w["keywords"] * F.least(F.lit(1.0), keywords / 5)
             + w["authors"] * F.least(F.lit(1.0), known_authors * 0.3) + w["venue"] * prestige + w["recency"] * ladder(age, RECENCY, 0.2, least=False))
    return F.least(F.lit(1.0), score)


def version_score(status: Column, published: Column, preprint: Column, rank: Column, top_rank: int, confidence: Column, size: Column) -> Column:
    """0 to 100: validity 20, publication 20, source 30, confidence 20, size 10."""
    return (F.when(status == "valid", 20.0).when(status == "unknown", 10.0).otherwise(0.0) + F.when(published, 20.0).when(preprint, 5.0).otherwise(0.0)
            + rank / top_rank * 30.0 + confidence * 20.0 + F.when(size > 100_000, 10.0).when(size > 50_000, 5.0).otherwise(0.0))


def match_confidence(title: Column, author: Column, same_venue_year: Column) -> Column:
    base = 0.6 * title + 0.4 * author
    return F.when(same_venue_year, F.least(F.lit(1.0), base * 1.15)).otherwise(base)


def weighted(parts: dict[float, Column] | list[tuple[float, Column]]) -> Column:
    pairs = parts.items() if isinstance(parts, dict) else parts
    return sum((w * c for w, c in pairs), F.lit(0.0))


# Substrings of error messages -> (kind, permanent).
ERRORS = [("404", "not_found", True), ("403", "forbidden", True), ("410", "gone", True), ("invalid pdf", "invalid_content", True), ("timeout", "timeout", False), ("429", "rate_limited", False), ("connection", "connection", False), ("50", "server_error", False)]


def error_kind(message: Column) -> Column:
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.struct(F.lit("unknown").alias("kind"), F.lit(False).alias("permanent"))
    for part, kind, permanent in reversed(ERRORS):
        out = F.when(low.contains(part), F.struct(F.lit(kind).alias("kind"), F.lit(permanent).alias("permanent"))).otherwise(out)
    return out


# Typical and greatest GPU counts by kind.
GPU_LIMITS = {"V100": (64, 1024), "A100": (128, 4096), "H100": (128, 8192), "T4": (16, 256), "P100": (32, 512), "K80": (32, 512), "TPU": (256, 8192)}


def gpu_count_verdict(kind: Column, count: Column) -> Column:
    table = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in GPU_LIMITS.items() for x in (k, v[i])]), kind)
    return F.when(count <= 0, "error").when(count > table(1), "error").when(count > table(0), "warning").otherwise("ok")


def scaling_verdict(parameters: Column, hours: Column, slack: float = 10.0) -> Column:
    """GPU hours should lie within 20 to 500 per billion parameters."""
    low, high = parameters / 1e9 * 20, parameters / 1e9 * 500
    return F.when((hours >= low) & (hours <= high), "ok").when((hours >= low / slack) & (hours <= high * slack), "warning").otherwise("error")


def scaling_gap(hours: Column, parameters: Column) -> Column:
    """log10 of hours over the power law; within .7 is consistent."""
    return F.log10(F.try_divide(hours, F.pow(parameters, F.lit(0.7)) / 1e6))
