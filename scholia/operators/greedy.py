"""Choices made in order, without walking through the rows in order.

A row's fate hangs on its earlier neighbours. So whoever has none that is still
undecided is settled, what that decides for the later ones is settled too, and
so on in rounds, each a few joins over the undecided links alone. Random orders
settle in a few rounds. Where a round settles little (a long chain in order) or
little is left, the rest is folded per connected component, links only.

Every round is cut with a checkpoint in the cluster's shared folder.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators.graph import connected, shared_folder

#: Links up to which the rest is folded, and the share that a round must settle.
FEW, LEAST_SHARE = 100_000, 0.2


def _slow(before: int, after: int) -> bool:
    return after <= FEW or after > (1 - LEAST_SHARE) * before


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts, empty)


def beaten(links: DataFrame, few: int | None = None) -> DataFrame:
    """(node): rows that lose when, in order, a row loses to any earlier
    neighbour that hasn't lost itself. links (a, b) with a < b."""
    few = FEW if few is None else few
    shared_folder(links.sparkSession)
    left = links.select("a", "b").filter("a < b").distinct().checkpoint()
    count, lost, kind = left.count(), [], left.schema["a"].dataType.simpleString()
    none = left.select(F.col("a").alias("node")).limit(0)
    while count > few:
        free = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = left.join(free, "a").select(F.col("b").alias("node")).distinct().checkpoint()
        lost.append(gone)
        now = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        now = now.join(free, "a", "left_anti").checkpoint()
        was, count, left = count, now.count(), now
        if count > (1 - LEAST_SHARE) * was:
            break
    if count:
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            out, later = set(), pdf.sort_values("a").groupby("a", sort=True).b.apply(list)
            for a, bs in later.items():
                if a not in out:
                    out.update(bs)
            return pd.DataFrame({"node": list(out)})

        tagged = left.join(connected(left).withColumnRenamed("node", "a"), "a")
        lost.append(tagged.groupBy("root").applyInPandas(fold, f"node {kind}"))
    return _union(lost, none)


def leaders(rows: DataFrame, ident: str, pairs: DataFrame, few: int | None = None) -> DataFrame:
    """``rows`` with ``leader``: in order of ``ident``, a row that no leader has
    taken leads all later free rows it is paired with (pairs a < b)."""
    links = pairs.select("a", "b").filter("a < b").distinct()
    gone = beaten(links, few).checkpoint()
    led = links.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").groupBy(F.col("b").alias(ident)).agg(F.min("a").alias("leader"))
    return rows.join(led, ident, "left").withColumn("leader", F.coalesce("leader", ident))


def matching(pairs: DataFrame, order: list[str], a: str = "a", b: str = "b", few: int | None = None) -> DataFrame:
    """Pairs taken in ``order``; one that touches a row already taken is left
    out. In a round, a pair that comes first at both its ends is taken. Pairs
    equal in ``order`` must be equal in both ends."""
    few = FEW if few is None else few
    shared_folder(pairs.sparkSession)
    key = F.struct(*order)
    left = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).checkpoint()
    count, taken = left.count(), []
    while count > few:
        ends = left.select(F.col(a).alias("node"), key.alias("_o")).unionByName(left.select(F.col(b).alias("node"), key.alias("_o")))
        first = ends.groupBy("node").agg(F.min("_o").alias("_first"))
        x = left.join(first.select(F.col("node").alias(a), F.col("_first").alias("_fa")), a).join(first.select(F.col("node").alias(b), F.col("_first").alias("_fb")), b)
        got = x.filter((key == F.col("_fa")) & (key == F.col("_fb"))).select(pairs.columns).checkpoint()
        taken.append(got)
        used = got.select(F.col(a).alias("_n")).unionByName(got.select(F.col(b).alias("_n"))).distinct()
        now = left.join(used, F.col(a) == F.col("_n"), "left_anti").join(used, F.col(b) == F.col("_n"), "left_anti").checkpoint()
        was, count, left = count, now.count(), now
        if count > (1 - LEAST_SHARE) * was:
            break
    if count:
        def take(pdf: pd.DataFrame) -> pd.DataFrame:
            used, keep = set(), []
            pdf = pdf.sort_values(order, kind="stable")
            for x, y in zip(pdf[a], pdf[b]):
                keep.append(x not in used and y not in used)
                if keep[-1]:
                    used |= {x, y}
            return pdf[keep]

        tagged = left.join(connected(left, a, b).withColumnRenamed("node", a), a)
        rest = tagged.groupBy("root").applyInPandas(take, tagged.schema).select(pairs.columns)
        taken.append(rest)
    return _union(taken, pairs.limit(0))


def first_by_any(rows: DataFrame, keys: list[str], ordinal: str, few: int | None = None) -> DataFrame:
    """In order, a row is kept unless a *kept* earlier row shares one of its
    keys; null keys share nothing. ``ordinal`` is unique. In a round, a row that
    comes first under each of its keys is kept and the others there go."""
    few = FEW if few is None else few
    shared_folder(rows.sparkSession)
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("k"), F.col(k).cast("string").alias("v"))) for i, k in enumerate(keys)])))
    left = rows.select(F.col(ordinal).alias("o"), each.alias("_e")).select("o", "_e.k", "_e.v")
    lost, count, was = [], None, None
    while True:
        # keys that two undecided rows share; a row without any is kept
        many = left.groupBy("k", "v").agg(F.min("o").alias("first"), F.count("*").alias("n")).filter("n > 1")
        left = left.join(many, ["k", "v"]).select("k", "v", "o", "first").checkpoint()
        was, count = count, left.count()
        if count <= few or (was is not None and count > (1 - LEAST_SHARE) * was):
            break
        kept = left.groupBy("o").agg(F.min(F.col("o") == F.col("first")).alias("ok")).filter("ok").select("o")
        gone = left.filter("o > first").join(kept.withColumnRenamed("o", "first"), "first", "left_semi").select("o").distinct().checkpoint()
        lost.append(gone)
        left = left.join(gone, "o", "left_anti").join(kept, "o", "left_anti").select("k", "v", "o")
    if count:
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            seen, out = set(), []
            for o, mine in pdf.sort_values("o").groupby("o", sort=True):
                held = set(zip(mine.k, mine.v))
                if held & seen:
                    out.append(o)
                else:
                    seen |= held
            return pd.DataFrame({"o": out}, dtype=pdf.o.dtype)

        links = left.filter("o > first").select(F.col("first").alias("a"), F.col("o").alias("b"))
        tagged = left.join(connected(links).withColumnRenamed("node", "o"), "o")
        lost.append(tagged.groupBy("root").applyInPandas(fold, f"o {rows.schema[ordinal].dataType.simpleString()}"))
    gone = _union(lost, rows.select(F.col(ordinal).alias("o")).limit(0)).withColumnRenamed("o", ordinal)
    return rows.join(gone, ordinal, "left_anti").select(rows.columns)


# ---------------------------------------------------------------- silences


def spaced(rows: DataFrame, by: list[str], at: str, tie: str, seconds: int) -> DataFrame:
    """The rows that fire when each one that fires silences its key for
    ``seconds``; of rows of one time the first by ``tie``.

    A row's successor, if it fires, is the first row ``seconds`` later or more.
    Time is cut into buckets of that length: the successor lies in the next
    bucket, or is the first row of the next bucket that has any, so successors
    are found within buckets, however many rows a key has. What fires is what
    the first row of its key reaches along successors, found by doubling steps."""
    shared_folder(rows.sparkSession)
    size = seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    columns, rows = rows.columns, rows.withColumn("_key", F.to_json(F.struct(*by)))  # null keys are a key
    by = ["_key"]
    times = rows.filter(F.col(at).isNotNull()).select(*by, us.alias("t")).distinct().withColumn("b", F.floor(F.col("t") / size))
    probe = times.select(*by, (F.col("t") + size).alias("t"), (F.col("b") + 1).alias("b"), F.col("t").alias("of"))
    both = probe.unionByName(times.withColumn("of", F.lit(None).cast("long")))
    # backwards in time, rows before probes of the same time
    w = Window.partitionBy(*by, "b").orderBy(F.desc("t"), F.col("of").asc_nulls_first())
    near = both.withColumn("next", F.last(F.when(F.col("of").isNull(), F.col("t")), ignorenulls=True).over(w)).filter("of is not null")
    buckets = times.groupBy(*by, "b").agg(F.min("t").alias("first"))
    # a bucket may lack rows but have probes, so probes' buckets are looked up among all
    looked = buckets.unionByName(near.filter("next is null").select(*by, "b").distinct().withColumn("first", F.lit(None).cast("long")))
    back = Window.partitionBy(*by).orderBy(F.desc("b"), F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    later = looked.withColumn("later", F.last("first", ignorenulls=True).over(back)).filter("first is null").select(*by, "b", "later")
    step = near.join(later, [*by, "b"], "left").select(*by, F.col("of").alias("t"), F.coalesce("next", "later").alias("next"))
    heads = times.groupBy(*by).agg(F.min("t").alias("t"))
    # only rows that some row has as its successor, or heads, can fire
    may = step.select(*by, F.col("next").alias("t")).filter("t is not null").unionByName(heads).distinct()
    step = step.join(may, [*by, "t"]).filter("next is not null").checkpoint()
    fired = heads.checkpoint()
    while True:
        reached = fired.join(step, [*by, "t"]).select(*by, F.col("next").alias("t"))
        now = fired.unionByName(reached).distinct().checkpoint()
        if now.count() == fired.count():
            break
        fired = now
        ahead = step.select(*by, F.col("t").alias("next"), F.col("next").alias("after"))
        step = step.join(ahead, [*by, "next"]).select(*by, "t", F.col("after").alias("next")).checkpoint()
    first = rows.withColumn("t", us).withColumn("_r", F.row_number().over(Window.partitionBy("_key", "t").orderBy(tie))).filter("_r = 1")
    return first.join(fired, ["_key", "t"], "left_semi").select(columns)
