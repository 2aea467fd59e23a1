"""Exact quantiles of groups of any size, few or many.

``F.percentile`` keeps all distinct values of a group in one task. Here equal
values of a group are counted first; the counted values, in the order (group,
value), are dealt out over ranges, so that a large group lies in many of them;
each range's counts per group give every value its ranks; and the values whose
ranks a quantile falls between are picked by one aggregate over all groups and
all quantiles. No task holds a group, and what meets per group in one place is
a number per range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators.graph import shared_folder


def same_join(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` and ``b`` joined by ``by``, nulls equal; b's copies of it go. ``b``
    is an aggregate, so adaptive execution knows its size before it joins; with
    an empty ``by`` it is one row."""
    renamed = b.select(*[F.col(c).alias(f"_{c}_") for c in by], *[c for c in b.columns if c not in by])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by], F.lit(True))
    return a.join(renamed if by else F.broadcast(renamed), on, how).drop(*[f"_{c}_" for c in by])


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): how often each group has each value; nulls go."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def _ranks(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """``counts`` with ``_lo`` and ``_hi``: the ranks from 0 that a value takes
    in its group, ``_hi`` not included."""
    spark = counts.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written down: which range a value lies in must not change when a task is run again
    runs = counts.repartitionByRange(parts, *by, value).withColumn("_run", F.spark_partition_id()).checkpoint()
    sums = runs.groupBy("_run", *by).agg(F.sum("n").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*by).orderBy("_run")) - F.col("_s")).drop("_s")
    within = F.sum("n").over(Window.partitionBy("_run", *by).orderBy(value))
    x = same_join(runs.withColumn("_within", within), before, ["_run", *by])
    hi = F.col("_before") + F.col("_within")
    return x.select(*by, value, "n", (hi - F.col("n")).alias("_lo"), hi.alias("_hi"))


def quantiles(counts: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column a share): the quantiles of ``counted``'s groups, linear
    between the two values that a share falls between."""
    x = _ranks(counts, by, value)
    x = same_join(x, counts.groupBy(*by).agg(F.sum("n").alias("_n")), by)
    picks = []
    for i, share in enumerate(shares.values()):
        place = (F.col("_n") - 1) * F.lit(share)
        for end, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col(value))).alias(f"_{end}{i}"))
    got = x.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, (name, share) in enumerate(shares.items()):
        place = (F.col("_n") - 1) * F.lit(share)
        part = place - F.floor(place)
        low, high = F.col(f"_a{i}").cast("double"), F.col(f"_b{i}").cast("double")
        out.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return got.select(*by, *out)


def with_quantiles(stats: DataFrame, rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``stats``, a row a group, with the quantiles of the groups of ``rows``."""
    return same_join(stats, quantiles(counted(rows, by, value), by, value, shares), by, "left")
