"""Assessments built of several scores, and report rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import grade
from scholia.operators.filters import with_reasons


def stage_report(checks: dict[str, DataFrame], least: dict[str, float]) -> DataFrame:
    """A row per check (each a one-row DataFrame with ``score``) with grade and
    verdict, and one for their mean."""
    rows = [df.select(F.lit(name).alias("check"), F.col("score").cast("double").alias("score"), F.lit(least.get(name, 0.8)).alias("least")) for name, df in checks.items()]
    all_ = reduce(lambda a, b: a.unionByName(b), rows)
    mean = all_.agg(F.lit("overall").alias("check"), F.avg("score").alias("score"), F.avg("least").alias("least"))
    return all_.unionByName(mean).select("check", "score", grade(F.col("score")).alias("grade"), (F.col("score") >= F.col("least")).alias("passed"))


def as_text(report: DataFrame) -> DataFrame:
    """One line per check, as a text sink takes it."""
    return report.select(F.format_string("%-20s %6.3f %2s %s", "check", "score", "grade", F.when(F.col("passed"), "ok").otherwise("FAILED")).alias("value"))


def as_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("value"))


def paper_filter(rows: DataFrame, richness: Column, confidence: Column, category: Column, ranking: Column, strict: bool, least: float = 0.6) -> DataFrame:
    """Three criteria with reasons: all of them, or a weighted score above
    ``least`` with hard floors on richness and ranking."""
    checks = {"richness": richness >= 0.3, "confidence": confidence >= 0.5, "authorship": category.isin("academic", "collaborative"), "venue": ranking <= 3}
    x = with_reasons(rows, checks)
    score = 0.4 * F.least(F.lit(1.0), richness / 0.6) + 0.3 * category.isin("academic", "collaborative").cast("double") + 0.3 * (1 - F.least(ranking, F.lit(5)) / 5)
    x = x.withColumn("score", score)
    return x if strict else x.withColumn("passed", (F.col("score") >= least) & (richness >= 0.1) & (ranking <= 5))


def richness_bucket(richness: Column, experimental: Column, confidence: Column) -> Column:
    return F.when((richness >= 0.7) & experimental & (confidence >= 0.7), "high").when((richness >= 0.4) & (confidence >= 0.5), "medium").when(richness >= 0.2, "low").otherwise("minimal")


def bucket_report(rows: DataFrame, bucket: str) -> DataFrame:
    """Counts, percentages, and the weighted score of the whole: 1, .7, .3, 0."""
    n = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    w = F.when(F.col(bucket) == "high", 1.0).when(F.col(bucket) == "medium", 0.7).when(F.col(bucket) == "low", 0.3).otherwise(0.0)
    whole = n.agg(F.sum("n").alias("_t"), (F.sum(F.col("n") * w) / F.sum("n")).alias("dataset_score"))
    return n.crossJoin(F.broadcast(whole)).select(bucket, "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"), "dataset_score")


def recommendations(per_venue: DataFrame, venue: str) -> DataFrame:
    """Few papers, few breakthroughs, or a spread above twice the mean."""
    notes = F.array_compact(F.array(F.when(F.col("n") < 20, F.lit("few papers")), F.when(F.col("breakthroughs") < 2, F.lit("few breakthroughs")), F.when(F.col("std") > 2 * F.col("mean"), F.lit("wide spread"))))
    return per_venue.select(venue, F.explode(notes).alias("note"))


def filtering_quality(before: DataFrame, after: DataFrame, key: str, venue: str, high: Column) -> DataFrame:
    """What a filter kept: rows, venues, high-impact rows."""
    x = before.join(after.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    out = x.agg(F.count("*").alias("n"), F.count("_k").alias("kept"), F.countDistinct(venue).alias("venues"), F.countDistinct(F.when(F.col("_k").isNotNull(), F.col(venue))).alias("venues_kept"), F.count_if(high).alias("high"), F.count_if(high & F.col("_k").isNotNull()).alias("high_kept"))
    return out.withColumn("warning", F.when(F.col("high_kept") < 0.95 * F.col("high"), "high-impact rows lost").when(F.col("venues_kept") < F.col("venues"), "venues lost").otherwise("none"))


def source_metrics(rows: DataFrame, source: str, hit: Column, latency: Column, fields: list[str]) -> DataFrame:
    cover = [F.avg(F.col(f).isNotNull().cast("double")).alias(f"has_{f}") for f in fields]
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("hit_rate"), F.avg(latency).alias("latency"), *cover)


# The sources that enrich papers, and the kinds of identifiers that are theirs.
ENRICHERS = {"openalex": "openalex", "semanticscholar": "s2_paper"}


def enrichment_statistics(papers: DataFrame) -> DataFrame:
    """Per source of ENRICHERS: papers that have anything of it (an identifier,
    a citation record or an abstract), citation records, abstracts. Columns as
    in ``schema.PAPER_DDL``; nulls have nothing."""
    parts = []
    for source, kind in ENRICHERS.items():
        said = lambda c: F.coalesce(F.exists(c, lambda r: r["source"] == source), F.lit(False))  # noqa: B023,E731
        named = F.coalesce(F.exists("identifiers", lambda r: r["data"]["identifier_type"] == kind), F.lit(False))  # noqa: B023
        if source == "openalex":
            named = named | F.coalesce(F.length("openalex_id") > 0, F.lit(False))
        cited, told = said("citations"), said("abstracts")
        parts.append(F.struct(F.lit(source).alias("source"), (named | cited | told).cast("int").alias("e"), cited.cast("int").alias("c"), told.cast("int").alias("a")))
    x = papers.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")
    return x.groupBy("source").agg(F.sum("e").alias("papers_enriched"), F.sum("c").alias("citations_found"), F.sum("a").alias("abstracts_found"))


def failures(rows: DataFrame, ident: str, kind: str, permanent: str) -> DataFrame:
    """Failed rows as they are handed on: permanent failures first, then by kind
    and id, each with how many its kind has."""
    n = rows.groupBy(permanent, kind).agg(F.count("*").alias("of_kind"))
    return rows.join(F.broadcast(n), [permanent, kind]).orderBy(F.desc(permanent), kind, ident)  # kinds of errors, a handful
