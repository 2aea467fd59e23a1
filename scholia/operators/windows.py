"""Ranking, top-k, first-occurrence and frame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """One row per key: the first in order. ``order`` must be total."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def top_n(rows: DataFrame, keys: list, order: list, n: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def top_with_fill(rows: DataFrame, year: str, domain: str, order: list, per_domain: int, least: int, most: int) -> DataFrame:
    """The best ``per_domain`` of each (year, domain); a year short of ``least``
    is filled with its best others; no year exceeds ``most``."""
    first = F.row_number().over(Window.partitionBy(year, domain).orderBy(*order))
    ranked = rows.withColumn("_in", (first <= per_domain).cast("int"))
    chosen = F.sum("_in").over(Window.partitionBy(year))
    place = F.row_number().over(Window.partitionBy(year).orderBy(F.desc("_in"), *order))
    limit = F.least(F.lit(most), F.greatest(F.lit(least), chosen))
    return ranked.withColumns({"_limit": limit, "selection_rank": place}).filter(F.col("selection_rank") <= F.col("_limit")).drop("_in", "_limit")


def percentile_rank(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Where each value stands in its group: values below it, in percent."""
    w = Window.partitionBy(by)
    return rows.withColumn("percentile", (F.rank().over(w.orderBy(value)) - 1) / F.count("*").over(w) * 100)


def bursts(events: DataFrame, by: str, ts: str, tie: str, gap_seconds: int = 60) -> DataFrame:
    """Keys with three events or more, two of them within ``gap_seconds`` of the
    one before; severity is the share of such events."""
    t = F.col(ts).cast("timestamp").cast("double")
    gap = t - F.lag(t).over(Window.partitionBy(by).orderBy(ts, tie))
    per = events.withColumn("_rapid", (gap < gap_seconds).cast("int")).groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.sum("_rapid"), F.lit(0)).alias("rapid"))
    return per.filter("n >= 3 and rapid >= 2").withColumn("severity", F.col("rapid") / F.col("n"))


def trailing_count(events: DataFrame, by: str, ts: str, seconds: int, name: str = "recent") -> DataFrame:
    """Events of the key in the last ``seconds``, this one included."""
    w = Window.partitionBy(by).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn(name, F.count("*").over(w))


def recent_trend(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """improving, declining or stable by the last three values; converged when
    the last five change by less than .01 on average."""
    w = Window.partitionBy(by).orderBy(order)
    v = F.col(value)
    step = v - F.lag(v).over(w)
    a, b = F.lag(v, 2).over(w), F.lag(v, 1).over(w)
    trend = F.when((v > b) & (b > a), "improving").when((v < b) & (b < a), "declining").otherwise("stable")
    flat = F.avg(F.abs("_step")).over(w.rowsBetween(-3, 0)) < 0.01
    return rows.withColumn("_step", step).withColumns({"trend": trend, "converged": F.coalesce(flat, F.lit(False))}).drop("_step")


def rank_and_percentile(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """Rank by total and (N - rank + 1) / N in percent; for dimension tables,
    whose rows fit one task."""
    w = Window.orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("percentile", F.round((F.count("*").over(Window.partitionBy()) - F.col("rank") + 1) / F.count("*").over(Window.partitionBy()) * 100, 2))


def cumulative_share(rows: DataFrame, value: str, tie: str) -> DataFrame:
    w = Window.orderBy(F.desc(value), tie)
    total = F.sum(value).over(Window.partitionBy())
    return rows.withColumns({"rank": F.row_number().over(w), "share": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total})


def stratified_sample(rows: DataFrame, stratum: str, key: Column, quota: int) -> DataFrame:
    """``quota`` rows of each stratum, by the order of a hash: repeatable."""
    return top_n(rows.withColumn("_h", F.md5(key.cast("string").cast("binary"))), [stratum], ["_h"], quota).drop("_h")
