"""Predicates, criteria with reasons, thresholds and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reasons(rows: DataFrame, checks: dict[str, Column], passed: str = "passed", reasons: str = "reasons") -> DataFrame:
    """``checks``: reason -> condition that must hold; null counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    return rows.withColumn(reasons, failed).withColumn(passed, F.size(reasons) == 0)


def rejection_counts(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    n = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_t")))).select("reason", "n", (F.col("n") / F.col("_t")).alias("share"))


def threshold_impact(rows: DataFrame, scenarios: dict[str, Column]) -> DataFrame:
    """How many rows pass under each scenario: one pass."""
    counts = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(f"_{i}") for i, test in enumerate(scenarios.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("scenario"), F.col(f"_{i}").alias("passed"), F.col("_n").alias("n")) for i, name in enumerate(scenarios)])).alias("s")).select("s.*")


def preserve_filter(papers: DataFrame, thresholds: DataFrame, keys: list[str], count: str, breakthrough: Column, default: int = 5) -> DataFrame:
    """keep a breakthrough; drop without citations; else by the (venue, year)
    threshold, ``default`` where none is known. ``reason`` says which."""
    x = papers.join(thresholds, keys, "left")
    reason = (F.when(breakthrough, "breakthrough").when(F.col(count).isNull(), "no_citations").when(F.col(count) >= F.coalesce("threshold", F.lit(default)), "above_threshold").otherwise("below_threshold"))
    return x.withColumn("reason", reason).withColumn("kept", F.col("reason").isin("breakthrough", "above_threshold"))


def borderline(value: Column, least: float, tolerance: float) -> Column:
    return F.abs(value - least) <= least * tolerance


def violations(rules: dict[str, Column]) -> Column:
    """Array of the names of broken rules; a null test is a broken rule."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def violation_counts(rows: DataFrame, rules: dict[str, Column], key: str, examples: int = 10) -> DataFrame:
    """Per rule: how many rows break it, and the first of them by key."""
    broken = rows.select(key, F.explode(violations(rules)).alias("rule"))
    return broken.groupBy("rule").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def paper_contract(as_of_year: int) -> dict[str, Column]:
    return {"title": F.length(F.trim("title")) > 0, "venue": F.length(F.trim("venue")) > 0, "year": F.col("year").between(2019, as_of_year), "identifier": F.coalesce("paper_id", "doi", "arxiv_id", "openalex_id").isNotNull()}


def range_rules(fields: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """In range is fine, null is no violation; ten times beyond is critical."""
    out = {}
    for c, (low, high) in fields.items():
        out[f"{c}_range"] = F.coalesce(F.col(c).between(low, high), F.lit(True))
        out[f"{c}_critical"] = F.coalesce(F.col(c).between(low / 10, high * 10), F.lit(True))
    return out


def schema_contract(rows: DataFrame, needed: list[str]) -> list[str]:
    """Columns that a stage needs and doesn't get."""
    return [c for c in needed if c not in rows.columns]


def download_todo(papers: DataFrame, state: DataFrame, key: str, retry_failed: bool) -> DataFrame:
    """Papers that aren't done and haven't failed for good; failed ones count as
    to do again if asked."""
    x = papers.join(state.select(key, "status", "permanent"), key, "left")
    again = F.lit(True) if retry_failed else F.lit(False)
    return x.filter(F.col("status").isNull() | (F.col("status") != "done") & ~F.coalesce("permanent", F.lit(False)) & ((F.col("status") != "failed") | again))
