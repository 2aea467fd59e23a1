"""Alerts held back by controls: stretches of time in which alerts don't go out.

Controls are rows (kind, pattern, starts, ends), ``ends`` not included:

* global holds everything back,
* maintenance and emergency hold back all but critical alerts,
* rule holds back the alerts of all rules whose name ``pattern`` is found in,
  whatever the case.

Of several that hold, an alert names the first in that order, and among rule
controls the first pattern. Patterns are matched against a table of rules, not
against alerts. Stretches of one kind and pattern that touch are one stretch;
they are cut into buckets of time, so alerts find theirs by equal (rule,
bucket), one row at most: no nested loop, no alert twice, and the alerts of a
busy rule are spread over its buckets. Controls are broadcast if they are few
by count. Alerts may be a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators.joins import small

ORDER = ["global", "maintenance", "emergency"]
BUCKET = 3600


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def stretches(controls: DataFrame, rules: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(rule, bucket, holds: array of (rank, name, lo, hi)); rule null: all."""
    c = controls.filter("starts < ends").select("kind", "pattern", _us("starts").alias("lo"), _us("ends").alias("hi"))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    general = c.filter(F.col("kind").isin(ORDER)).select(F.lit(None).cast("string").alias("rule"), rank.cast("int").alias("rank"), F.col("kind").alias("name"), "lo", "hi")
    patterns = c.filter("kind = 'rule' and pattern is not null")
    found = rules.select("rule").filter("rule is not null").distinct().join(small(patterns.select("pattern").distinct()), F.expr("rule rlike concat('(?i)', pattern)"))  # two dimensions: rules by patterns
    named = found.join(patterns, "pattern").select("rule", F.lit(len(ORDER) + 1).alias("rank"), "pattern", "lo", "hi").withColumnRenamed("pattern", "name")
    both = general.unionByName(named)
    w = Window.partitionBy("rule", "rank", "name").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(w))
    one = both.groupBy("rule", "rank", "name", "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    size = bucket * 1_000_000
    cut = one.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    return cut.groupBy("rule", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "lo", "hi"))).alias("holds"))


def held_back(alerts: DataFrame, controls: DataFrame, rules: DataFrame, at: str = "at", rule: str = "rule", severity: str = "severity", bucket: int = BUCKET) -> DataFrame:
    """``alerts`` with ``held_by``: the kind, or for rules the pattern, of the
    control that holds it back; null if it goes out."""
    holds = stretches(controls, rules, bucket)
    general = small(holds.filter("rule is null").select(F.col("bucket").alias("_b1"), F.col("holds").alias("_h1")))
    named = small(holds.filter("rule is not null").select(F.col("rule").alias("_r2"), F.col("bucket").alias("_b2"), F.col("holds").alias("_h2")))
    x = alerts.withColumn("_at", _us(at)).withColumn("_b", F.floor(F.col("_at") / (bucket * 1_000_000)))
    x = x.join(general, F.col("_b") == F.col("_b1"), "left").join(named, (F.col(rule) == F.col("_r2")) & (F.col("_b") == F.col("_b2")), "left")
    both = F.concat(*[F.coalesce(h, F.expr("cast(array() as array<struct<rank:int,name:string,lo:bigint,hi:bigint>>)")) for h in (F.col("_h1"), F.col("_h2"))])
    critical = F.coalesce(F.lower(F.col(severity)) == "critical", F.lit(False))
    hit = F.filter(both, lambda h: (h["lo"] <= F.col("_at")) & (F.col("_at") < h["hi"]) & (~critical | ~h["rank"].isin(2, 3)))
    return x.withColumn("held_by", F.array_min(hit)["name"]).drop("_at", "_b", "_b1", "_h1", "_r2", "_b2", "_h2")


def tally(held: DataFrame) -> DataFrame:
    """Per control that held alerts back: how many, and the share of all."""
    return held.groupBy("held_by").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).filter("held_by is not null")  # one row a control
