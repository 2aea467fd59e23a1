"""Lookup cascades, enrichment, matching and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators.windows import first_of

#: Rows up to which a dimension is broadcast.
SMALL = 200_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """A broadcast hint when a count shows that ``df`` is small enough."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def settled(df: DataFrame) -> DataFrame:
    """A small aggregate, computed once and written down: its count, its
    broadcast and its readers don't compute it again. Hinted as ``small``."""
    from scholia.operators.graph import shared_folder
    shared_folder(df.sparkSession)
    return small(df.checkpoint())


def by_text(rows: DataFrame, text: Column, **made) -> DataFrame:
    """``rows`` and columns made of ``text``: name=function of a column. Dear
    functions are worked out once for each distinct text (null is one), dealt
    out over the tasks however few files hold the rows."""
    keyed = rows.withColumn("_text", text)
    each = keyed.select(F.col("_text").alias("_of")).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = settled(each.select("_of", *[f(F.col("_of")).alias(name) for name, f in made.items()]))
    return keyed.join(each, F.col("_text").eqNullSafe(F.col("_of"))).drop("_text", "_of")


def lookup_cascade(rows: DataFrame, steps: list[tuple[DataFrame, Column, str]], key: str, value: str, name: str = "found") -> DataFrame:
    """Left joins in order; the first step that knows the key wins. steps:
    (dimension with ``key`` and ``value``, lookup expression, label)."""
    out, values, labels = rows, [], []
    for i, (dim, expr, label) in enumerate(steps):
        d = first_of(dim.filter(F.col(key).isNotNull()).select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), [f"_k{i}"], [f"_v{i}"])
        out = out.withColumn(f"_e{i}", expr).join(small(d), F.col(f"_e{i}") == F.col(f"_k{i}"), "left")
        values.append(F.col(f"_v{i}"))
        labels.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(label)))
    spare = [f"_{x}{i}" for i in range(len(steps)) for x in "kve"]
    return out.withColumns({name: F.coalesce(*values), f"{name}_by": F.coalesce(*labels, F.lit("none"))}).drop(*spare)


def enrich(papers: DataFrame, mapping: DataFrame, data: DataFrame, key: str, source: str) -> DataFrame:
    """Papers keep their row whether or not a source knows them."""
    return papers.join(mapping, key, "left").join(data, source, "left")


def merge_sources(parts: list[DataFrame], key: str, scalars: list[str], arrays: list[str], order: str) -> DataFrame:
    """One row per key: scalars from the first part that has them, arrays joined."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    first = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("_part", order))).alias(c) for c in scalars]
    joined = [F.flatten(F.collect_list(F.coalesce(c, F.array()))).alias(c) for c in arrays]
    return both.groupBy(key).agg(*first, *joined)


def resume(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New results, and old ones that they don't replace."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def exact_duplicates(rows: DataFrame, key: Column, ident: str, source: str | None = None) -> DataFrame:
    """Groups of more than one row with one key (of more than one source)."""
    g = rows.withColumn("_k", key).filter("_k is not null").groupBy("_k").agg(F.count("*").alias("n"), F.min(ident).alias("first_id"), *([F.countDistinct(source).alias("sources")] if source else []))
    return g.filter("n > 1" + (" and sources > 1" if source else "")).withColumnRenamed("_k", "key")


def blocked_pairs(rows: DataFrame, ident: str, block: Column) -> DataFrame:
    """Pairs a < b within a block; the block must be selective, for the pairs of
    a block grow with its square."""
    r = rows.withColumn("_b", block).filter("_b is not null")
    a, b = r.select([F.col(c).alias(f"{c}_a") for c in r.columns]), r.select([F.col(c).alias(f"{c}_b") for c in r.columns])
    return a.join(b, (F.col("_b_a") == F.col("_b_b")) & (F.col(f"{ident}_a") < F.col(f"{ident}_b"))).drop("_b_a", "_b_b")


def greedy_groups(pairs: DataFrame, order: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Pairs are taken in order; a pair that touches a grouped row is skipped."""
    from scholia.operators.greedy import matching
    return matching(pairs, order, a, b)


def best_match(rows: DataFrame, name: Column, candidates: DataFrame, candidate: str, score, least: float, arms: list[tuple[str, Column]]) -> DataFrame:
    """Distinct names against a bounded candidate dimension: an arm's condition
    wins in order, then the highest score of at least ``least``."""
    names = rows.select(name.alias("_n")).distinct()
    pairs = names.join(small(candidates.select(F.col(candidate).alias("_c"))), F.lit(True))
    arm = F.coalesce(*[F.when(test, F.lit(i)) for i, (_, test) in enumerate(arms)], F.lit(len(arms)))
    pairs = pairs.withColumn("_arm", arm).withColumn("_s", F.when(F.col("_arm") < len(arms), F.lit(1.0)).otherwise(score(F.col("_n"), F.col("_c"))))
    best = first_of(pairs.filter(F.col("_s") >= least), ["_n"], ["_arm", F.desc("_s"), "_c"])
    labels = F.array(*[F.lit(x) for x, _ in arms], F.lit("fuzzy"))
    return best.select(F.col("_n").alias("name"), F.col("_c").alias("match"), F.element_at(labels, F.col("_arm") + 1).alias("by"), F.col("_s").alias("confidence"))


def compare_long(one: DataFrame, two: DataFrame, keys: list[str], value: str, tolerance: float = 0.1) -> DataFrame:
    """Full outer comparison by relative tolerance."""
    x = one.select(*keys, F.col(value).alias("one")).join(two.select(*keys, F.col(value).alias("two")), keys, "full")
    agree = F.when(F.col("one").isNull() | F.col("two").isNull(), False).otherwise(F.abs(F.col("one") - F.col("two")) <= tolerance * F.greatest(F.abs("one"), F.abs("two")))
    return x.withColumn("agree", agree)


def overlap(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Sizes of both, left only, right only, and coverage in percent."""
    x = one.select(key).distinct().withColumn("_a", F.lit(1)).join(two.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    out = x.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("both") * 100.0, F.col("both") + F.col("left_only")), F.lit(0.0)))


def merge_by_mapping(counts: DataFrame, mapping: DataFrame, name: str, canonical: str, values: list[str]) -> DataFrame:
    """Sums under the canonical name; unmapped names stay."""
    return counts.join(small(mapping), name, "left").groupBy(F.coalesce(canonical, name).alias(name)).agg(*[F.sum(v).alias(v) for v in values])


def missing_expected(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return expected.join(seen.select(key).distinct(), key, "left_anti")


def grid_coverage(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Every combination of the values of two dimensions, with its count; the
    grid is the result, so both should be small."""
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = n.select(a).distinct().crossJoin(small(n.select(b).distinct()))
    return grid.join(n, [a, b], "left").na.fill(0, ["n"])


def priority_routing(rows: DataFrame, routes: DataFrame, key: str, source: str, position: str) -> DataFrame:
    """Each row's sources in order, with a score of 10 - position."""
    return rows.join(small(routes), key).withColumn("score", 10 - F.col(position)).withColumn("turn", F.row_number().over(Window.partitionBy(*rows.columns).orderBy(position, source)))
