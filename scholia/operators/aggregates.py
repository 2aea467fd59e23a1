"""Citation statistics and reports: one pass, exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.scores import adaptive_threshold, base_threshold
from scholia.operators.joins import settled
from scholia.operators.quantiles import counted, quantiles, same_join, with_quantiles

PERCENTS = [10, 25, 50, 75, 80, 90, 95, 99]


def shares(percents=PERCENTS) -> dict[str, float]:
    return {f"p{p}": p / 100 for p in percents}


def citation_report(papers: DataFrame, venue="venue", year="year", count="citations") -> DataFrame:
    """Statistics by venue, by venue and year, by year, and overall; ``level``
    tells which. Moments come from grouping sets of one aggregate; percentiles
    from the counted values of all levels' groups at once, so that neither the
    whole nor a large venue meets in a task."""
    v, y, c = F.col(venue), F.col(year), F.col(count)
    level = F.when(F.grouping(v) + F.grouping(y) == 2, "overall").when(F.grouping(v) == 1, "year").when(F.grouping(y) == 1, "venue").otherwise("venue_year")
    sets = [[v], [v, y], [y], []]
    stats = papers.groupingSets(sets, v, y).agg(level.alias("level"), F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
    once = counted(papers, [venue, year], count)
    levels = F.explode(F.array(*[F.struct((v if a else F.lit(None)).alias("v"), (y if b else F.lit(None)).alias("y"), F.lit(name).alias("level")) for a, b, name in ((1, 0, "venue"), (1, 1, "venue_year"), (0, 1, "year"), (0, 0, "overall"))]))
    rolled = once.select(levels.alias("_l"), c, "n").groupBy("_l", c).agg(F.sum("n").alias("n")).select(F.col("_l.v").alias(venue), F.col("_l.y").alias(year), F.col("_l.level").alias("level"), c, "n")
    return same_join(stats, quantiles(rolled, ["level", venue, year], count, shares()), ["level", venue, year], "left")


def adaptive_thresholds(papers: DataFrame, as_of_year: int, venue="venue", year="year", count="citations", tier="tier") -> DataFrame:
    """Per venue and year: threshold, confidence, how many reach it, alternatives."""
    once = counted(papers, [venue, year], count)
    per = papers.groupBy(venue, year).agg(F.count("*").alias("n"), F.max(tier).alias("tier"), F.max(count).alias("most"))
    per = same_join(per, quantiles(once, [venue, year], count, shares([50, 70, 75, 80, 90])), [venue, year], "left")
    base = base_threshold(F.col("tier"), F.col(year), as_of_year)
    per = settled(per.withColumn("threshold", adaptive_threshold(base, F.col("p75"), F.col("p70"), F.col("most"))))
    # what reaches a threshold is counted on the counted values
    above = once.withColumnRenamed("n", "_k").join(per.select(venue, year, "threshold"), [venue, year]).groupBy(venue, year).agg(F.sum(F.when(F.col(count) >= F.col("threshold"), F.col("_k")).otherwise(0)).alias("above"))
    return per.join(above, [venue, year]).select(venue, year, "n", "threshold", F.least(F.lit(1.0), F.col("n") / 50).alias("confidence"), "above",
                                                  *[F.col(f"p{p}").cast("long").alias(f"alternative_{p}") for p in (50, 80, 90)])


def histogram(papers: DataFrame, count="citations") -> DataFrame:
    c = F.col(count)
    bucket = F.when(c <= 5, "0-5").when(c <= 20, "6-20").when(c <= 50, "21-50").when(c <= 100, "51-100").otherwise("100+")
    return papers.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sample_skewness(c: Column) -> Column:
    """n / ((n-1)(n-2)) times the sum of cubed z, z by population deviation;
    0 below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(c) > 0), F.skewness(c) * n * n / F.nullif((n - 1) * (n - 2), F.lit(0.0))).otherwise(0.0)


def collection_statistics(papers: DataFrame, value: str) -> DataFrame:
    c = F.col(value)
    out = papers.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), sample_skewness(c).alias("skew"), F.sum(c).alias("total"))
    return with_quantiles(out, papers, [], value, {"median": 0.5, "q25": 0.25, "q75": 0.75})


def h_index(papers: DataFrame, by: str, count: str) -> DataFrame:
    """The largest i with i rows of at least i. Counts of equal values are
    aggregated first, so one group's papers never meet in a task."""
    per = papers.groupBy(by, F.col(count).cast("long").alias("_c")).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc("_c")))
    return per.withColumn("_k", run).groupBy(by).agg(F.max(F.least("_k", F.greatest("_c", F.lit(0)))).alias("h_index"))


def growth_rate(papers: DataFrame, by: str, year: str, count: str) -> DataFrame:
    """(last / first) ** (1 / span) - 1 of the yearly means; 0 where undefined."""
    means = papers.groupBy(by, year).agg(F.avg(count).alias("m"))
    per = means.groupBy(by).agg(F.min_by("m", year).alias("a"), F.max_by("m", year).alias("b"), (F.max(year) - F.min(year)).alias("span"))
    return per.select(by, F.when((F.col("span") > 0) & (F.col("a") > 0) & (F.col("b") > 0), F.pow(F.col("b") / F.col("a"), 1 / F.col("span")) - 1).otherwise(0.0).alias("growth"))


def yearly_trend(papers: DataFrame, by: str, year: str, count: str) -> DataFrame:
    """Pearson correlation of the years' order with their means; +-0.3 decides."""
    means = papers.groupBy(by, year).agg(F.avg(count).alias("m"))
    ranked = means.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(year)).cast("double"))
    r = F.corr("i", "m")
    return ranked.groupBy(by).agg(F.when(F.isnan(r), None).otherwise(r).alias("r")).withColumn("trend", F.when(F.col("r") > 0.3, "increasing").when(F.col("r") < -0.3, "decreasing").otherwise("stable"))


def diversity(papers: DataFrame, by: str) -> DataFrame:
    """Shannon entropy of the shares of ``by``."""
    n = papers.groupBy(by).count()
    total = n.agg(F.sum("count").alias("_t"))
    return n.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("count") / F.col("_t") * F.ln(F.col("count") / F.col("_t")))).alias("entropy"))


def venue_statistics(papers: DataFrame, venue: str, year: str, count: str, author: str) -> DataFrame:
    """Totals, distinct authors, peak year (highest mean) and busiest year."""
    years = papers.groupBy(F.lower(venue).alias("venue"), year).agg(F.count("*").alias("n"), F.avg(count).alias("m"), F.sum(count).alias("s"))
    per = years.groupBy("venue").agg(F.sum("n").alias("papers"), F.sum("s").alias("citations"), F.max_by(F.col(year), F.struct("m", -F.col(year))).alias("peak_year"), F.max_by(F.col(year), F.struct("n", -F.col(year))).alias("busiest_year"),
                                    F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    authors = papers.groupBy(F.lower(venue).alias("venue")).agg(F.countDistinct(author).alias("authors"))
    return per.join(authors, "venue")


def quality_indicators(papers: DataFrame, as_of_year: int, venue: str, year: str, count: str, breakthrough: Column) -> DataFrame:
    c = F.col(count)
    out = papers.agg(F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.avg((c == 0).cast("double")).alias("zero_rate"),
                     F.countDistinct(venue).alias("venues"), F.avg(breakthrough.cast("double")).alias("breakthrough_rate"), F.avg((F.col(year) >= as_of_year - 3).cast("double")).alias("recent_rate"))
    return with_quantiles(out, papers, [], count, {"median": 0.5})


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """Counts and precision, recall, F1, accuracy, 0 where undefined."""
    n = rows.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(~truth & ~said).alias("tn"), F.count_if(truth & ~said).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    n = n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return n.withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def cost_ledger(rows: DataFrame, extractor: str, operation: str, cost: str) -> DataFrame:
    e, o = F.col(extractor), F.col(operation)
    return rows.groupingSets([[e], [o], []], e, o).agg(F.count("*").alias("n"), F.sum(cost).alias("total"), F.avg(cost).alias("mean"), F.min(cost).alias("least"), F.max(cost).alias("most"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("std"))


def pivot_by_year(rows: DataFrame, year: str, category: str, values: list[str], row: str | None = None) -> DataFrame:
    """Year x category counts (of distinct ``row`` if given); empty cells are 0."""
    what = F.countDistinct(row) if row else F.count(F.lit(1))
    return rows.groupBy(year).pivot(category, values).agg(what).na.fill(0)


def proportions(counts: DataFrame, year: str, n: str) -> DataFrame:
    """Each count as a percentage of its year's total."""
    return counts.withColumn("percent", F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(year)))


def cooccurrence(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Pairs of labels of one key, and 100 * pairs / the rarer label's keys."""
    d = rows.select(key, label).distinct()
    n = d.groupBy(label).agg(F.count("*").alias("n"))
    a, b = d.select(key, F.col(label).alias("a")), d.select(key, F.col(label).alias("b"))
    pairs = a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("pairs"))
    na, nb = n.select(F.col(label).alias("a"), F.col("n").alias("na")), n.select(F.col(label).alias("b"), F.col("n").alias("nb"))
    return pairs.join(na, "a").join(nb, "b").select("a", "b", "pairs", (F.col("pairs") * 100.0 / F.least("na", "nb")).alias("strength"))


def label_sets(rows: DataFrame, key: str, label: str) -> DataFrame:
    """How many keys have each combination of labels."""
    sets = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(label)), "+").alias("labels"))
    return sets.groupBy("labels").agg(F.count("*").alias("n"))


def corrected_counts(rows: DataFrame, domain: str, n: str, rate: Column, total: float) -> DataFrame:
    """Counts divided by their detection rate, then scaled to a fixed total."""
    raised = rows.withColumn("_c", F.try_divide(F.col(n), rate))
    whole = raised.agg(F.sum("_c").alias("_t"))
    return raised.crossJoin(F.broadcast(whole)).select(domain, n, (F.col("_c") * total / F.col("_t")).alias("corrected"))
