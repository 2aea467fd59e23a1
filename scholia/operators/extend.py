"""Extension points: analyzers, collectors, rule tables, validators, hooks.

What is registered is a function of Columns or DataFrames, so a plug-in is part
of the plan like anything else. Hooks see DataFrames before and after a step,
and a step's counts, which Spark observes while the step's own job runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Registry:
    """Names to things; a name can be given once."""

    def __init__(self):
        self.known: dict[str, object] = {}

    def register(self, name: str, thing) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = thing

    def names(self) -> list[str]:
        return sorted(self.known)


class Analyzers(Registry):
    """Analyzers: (text -> value, text and value -> confidence), Columns both."""

    def apply(self, text: Column) -> Column:
        """struct<value, confidence, by> of the most confident analyzer that
        found a value; equal confidences go to the lesser name. Null if none did."""
        if not self.known:
            raise ValueError("no analyzer is registered")
        found = []
        for i, name in enumerate(self.names()):
            analyze, confidence = self.known[name]
            value = analyze(text)
            found.append(F.when(value.isNotNull(), F.struct(confidence(text, value).cast("double").alias("confidence"), F.lit(-i).alias("o"), value.alias("value"), F.lit(name).alias("by"))))
        best = F.array_max(F.array_compact(F.array(*found)))
        return F.when(best.isNotNull(), F.struct(best["value"].alias("value"), best["confidence"].alias("confidence"), best["by"].alias("by")))


class Collectors(Registry):
    """Collectors of candidate addresses: a function of the row's columns that
    gives an array of URLs (none: empty or null), and a confidence."""

    def discover(self, rows: DataFrame, ident: str) -> DataFrame:
        """(ident, url, by, confidence), one row a candidate; a URL that several
        collectors give is the most confident one's (then the lesser name's)."""
        def named(name: str, collect: Column, sure: float) -> Column:
            return F.transform(F.coalesce(collect, F.array().cast("array<string>")), lambda u: F.struct(F.lit(float(sure)).alias("confidence"), F.lit(name).alias("by"), u.alias("url")))

        each = [named(name, *self.known[name]) for name in self.names()]
        if not each:
            raise ValueError("no collector is registered")
        x = rows.select(ident, F.explode(F.concat(*each)).alias("_c")).select(ident, "_c.*").filter("url <> ''")
        best = F.max_by(F.struct("by", "confidence"), F.struct(F.col("confidence"), -F.col("_o")))
        order = F.array_position(F.array(*map(F.lit, sorted(self.known))), F.col("by"))
        return x.withColumn("_o", order).groupBy(ident, "url").agg(best.alias("_b")).select(ident, "url", "_b.by", "_b.confidence")


RULES = "rule string, field string, least double, most double, pattern string, required boolean, severity string"


def broken_rules(rows: DataFrame, ident: str, rules: DataFrame, fields: list[str]) -> DataFrame:
    """(ident, rule, field, severity): the rules of a table (RULES; nulls don't
    bind) that rows break. Fields become rows and meet their rules by name, so
    any number of rules is one hash join. Text that isn't a number breaks a
    rule with bounds; null breaks only ``required``."""
    long = rows.select(ident, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", "_v"))
    x = long.join(F.broadcast(rules) if rules.limit(10_001).count() <= 10_000 else rules, "field")
    n = F.expr("try_cast(_v as double)")
    bounded = F.col("least").isNotNull() | F.col("most").isNotNull()
    outside = bounded & (n.isNull() | F.coalesce(n < F.col("least"), F.lit(False)) | F.coalesce(n > F.col("most"), F.lit(False)))
    shaped = F.col("pattern").isNotNull() & ~F.expr("_v rlike pattern")
    bad = F.when(F.col("_v").isNull(), F.coalesce("required", F.lit(False))).otherwise(outside | shaped)
    return x.filter(bad).select(ident, "rule", "field", "severity")


def custom(check: Callable[[object], bool]) -> Callable[[Column], Column]:
    """A Python predicate as a Column function, in Arrow batches; null and an
    error in the predicate are False."""
    def one(x) -> bool:
        try:
            return x is not None and bool(check(x))
        except Exception:  # whatever a caller's predicate does, the row is invalid
            return False

    @F.pandas_udf(T.BooleanType())
    def run(col: pd.Series) -> pd.Series:
        return col.map(one).astype(bool)

    return run


class Hooks:
    """Callbacks around steps. ``before(step, df)`` and ``after(step, df, seen)``
    are called by ``run``; ``seen`` is a function that gives the step's observed
    numbers once an action on its result has run."""

    def __init__(self):
        self.before: list[Callable] = []
        self.after: list[Callable] = []

    def run(self, step: str, function: Callable[[DataFrame], DataFrame], df: DataFrame, **metrics: Column) -> DataFrame:
        for f in self.before:
            f(step, df)
        watch = Observation(step)
        out = function(df).observe(watch, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()])
        for f in self.after:
            f(step, out, lambda: watch.get)
        return out


def per_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """A started query that hands each batch, and its number, to ``callback``."""
    return stream.writeStream.outputMode(mode).foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chained(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda a, f: f(a), steps, df)
