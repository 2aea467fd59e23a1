"""Taxonomy classification and accounting over domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Taxonomy = dict[str, list[str]]


def categories(text: Column, taxonomy: Taxonomy) -> Column:
    """All categories with a keyword in the text, in the taxonomy's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in taxonomy.items()]))


def multi_label(rows: DataFrame, key: str, text: Column, taxonomy: Taxonomy, other: str = "other") -> DataFrame:
    """One row per key and category; a key with none has ``other`` alone."""
    found = categories(text, taxonomy)
    return rows.select(key, F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))).alias("category"))


def single_label(rows: DataFrame, key: str, text: Column, taxonomy: Taxonomy, other: str = "other") -> DataFrame:
    return rows.select(key, F.coalesce(F.get(categories(text, taxonomy), F.lit(0)), F.lit(other)).alias("category"))


def inflation(multi: DataFrame, single: DataFrame, category: str = "category") -> DataFrame:
    """Counts either way and their ratio."""
    a, b = multi.groupBy(category).agg(F.count("*").alias("multi")), single.groupBy(category).agg(F.count("*").alias("single"))
    return a.join(b, category, "full").na.fill(0).withColumn("inflation", F.coalesce(F.try_divide("multi", "single"), F.lit(0.0)))


def corrected_multi(method: DataFrame, compared: DataFrame, category: str, n: str) -> DataFrame:
    return method.join(compared, category).withColumn("corrected", F.coalesce(F.col(n) * F.try_divide("multi", "single"), F.lit(0.0)))


def detection_rates(rows: DataFrame, domain: str, found: Column) -> DataFrame:
    return rows.groupBy(domain).agg(F.count("*").alias("n"), F.count_if(found).alias("found")).withColumn("rate", F.coalesce(F.try_divide("found", "n"), F.lit(0.0)))


def correction_factors(rates: DataFrame) -> DataFrame:
    """Each rate over the overall rate."""
    whole = rates.agg((F.sum("found") / F.sum("n")).alias("_all"))
    return rates.crossJoin(F.broadcast(whole)).withColumn("factor", F.coalesce(F.try_divide("rate", "_all"), F.lit(0.0))).drop("_all")


def blended_counts(rates: DataFrame, total: float) -> DataFrame:
    """.7 of n / rate and .3 of n, rescaled to a fixed total."""
    x = rates.withColumn("_c", 0.7 * F.coalesce(F.try_divide("n", "rate"), F.col("n")) + 0.3 * F.col("n"))
    return x.withColumn("corrected", F.col("_c") * total / F.sum("_c").over(Window.partitionBy())).drop("_c")


def agreement(left: DataFrame, right: DataFrame, key: str, category: str) -> DataFrame:
    """Which label sets contain the other side's label, both directions."""
    a = left.select(key, F.col(category).alias("_c")).distinct().withColumn("_l", F.lit(1))
    b = right.select(key, F.col(category).alias("_c")).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_r").isNull(), "left_only").otherwise("right_only")
    return a.join(b, [key, "_c"], "full").groupBy(F.col("_c").alias(category), side.alias("side")).agg(F.count("*").alias("n"))


def empirical(text: Column, strong: list[str], weak: list[str], has_data: Column) -> Column:
    """Three per strong word, one per weak word, five for data: empirical from 5, unclear from 2."""
    low = F.lower(text)
    score = sum((F.when(low.contains(w), 3).otherwise(0) for w in strong), F.lit(0)) + sum((F.when(low.contains(w), 1).otherwise(0) for w in weak), F.lit(0)) + F.when(has_data, 5).otherwise(0)
    return F.when(score >= 5, "empirical").when(score >= 2, "unclear").otherwise("theoretical")


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows that pass each step and all before it, and what each step loses."""
    tests, so_far = [], F.lit(True)
    for test in steps.values():
        so_far = so_far & F.coalesce(test, F.lit(False))
        tests.append(F.count_if(so_far))
    counts = rows.agg(F.count("*").alias("_0"), *[t.alias(f"_{i + 1}") for i, t in enumerate(tests)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"_{i + 1}").alias("n"), (F.col(f"_{i}") - F.col(f"_{i + 1}")).alias("lost")) for i, name in enumerate(steps)])).alias("s")).select("s.*")


def drill_down(multi: DataFrame, key: str, category: str, only: str, names: DataFrame, name: str, top: int = 20) -> DataFrame:
    """The commonest names among keys that have no category but ``only``."""
    mapped = multi.filter(F.col(category) != only).select(key).distinct()
    rest = multi.filter(F.col(category) == only).join(mapped, key, "left_anti").select(key)
    return names.join(rest, key, "left_semi").groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(top)
