"""Data-quality scores of a collection: each a single aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import present

# Form of a DOI and of an author's name.
DOI_FORM = r"^10\.\d{4,}/[-._;()/:a-zA-Z0-9]+$"
NAME_FORM = r"(?U)^[\w\s\-\.',]+$"


def _rate(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def completeness(rows: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """.8 of the required fields' presence and .2 of the optional ones'."""
    x = rows.agg(*[_rate(present(F.col(c).cast("string"))).alias(f"has_{c}") for c in required + optional], F.count("*").alias("n"))
    mean = lambda cols: sum((F.col(f"has_{c}") for c in cols), F.lit(0.0)) / max(len(cols), 1)
    x = x.withColumn("score", 0.8 * mean(required) + 0.2 * mean(optional))
    return x.withColumn("passed", (F.col("score") >= 0.8))


def duplicate_title_score(rows: DataFrame, title: str) -> DataFrame:
    """1 - 2 * rate of titles (lower case) seen before, 0 at least."""
    n = rows.filter(present(F.col(title))).groupBy(F.lower(title).alias("t")).count()
    return n.agg(F.sum(F.col("count") - 1).alias("repeats"), F.sum("count").alias("n")).withColumn("score", F.greatest(F.lit(0.0), 1 - 2 * F.col("repeats") / F.col("n")))


def venue_consistency(rows: DataFrame, venue: str) -> DataFrame:
    """Venues (in lower case) that are spelt in more than one way."""
    per = rows.groupBy(F.lower(venue).alias("v")).agg(F.countDistinct(venue).alias("forms"))
    return per.agg(F.count("*").alias("venues"), F.count_if(F.col("forms") > 1).alias("inconsistent")).withColumn("score", 1 - F.col("inconsistent") / F.col("venues"))


def year_validity(rows: DataFrame, year: Column, as_of_year: int) -> DataFrame:
    y = year.cast("string").try_cast("int") if hasattr(year, "try_cast") else year.cast("int")
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(y.between(1950, as_of_year + 1), F.lit(False))).alias("invalid")).withColumn("score", 1 - F.col("invalid") / F.col("n"))


def url_accuracy(rows: DataFrame, url: str) -> DataFrame:
    ok = F.try_parse_url(F.col(url), F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(F.col(url), F.lit("HOST")).isNotNull()
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("valid")).withColumn("score", F.col("valid") / F.col("n"))


def doi_accuracy(rows: DataFrame, doi: Column) -> DataFrame:
    bare = F.regexp_replace(doi, r"^(https?://)?(dx\.)?doi\.org/", "")
    return rows.agg(F.count(doi).alias("n"), F.count_if(bare.rlike(DOI_FORM)).alias("valid")).withColumn("score", F.coalesce(F.try_divide("valid", "n"), F.lit(1.0)))


def name_accuracy(rows: DataFrame, names: str) -> DataFrame:
    """Over all authors of all rows (array<string>)."""
    x = rows.select(F.explode(names).alias("a"))
    return x.agg(F.count("*").alias("n"), F.count_if((F.length("a") >= 2) & F.col("a").rlike(NAME_FORM)).alias("valid")).withColumn("score", F.coalesce(F.try_divide("valid", "n"), F.lit(1.0)))


def venue_coverage(rows: DataFrame, venue: str) -> DataFrame:
    """min(1, 10 * distinct / total) less the share of unknown, 0 at least; and
    whether the largest venue has ten times the mean."""
    per = rows.groupBy(venue).agg(F.count("*").alias("n"))
    unknown = F.sum(F.when(F.coalesce(F.lower(venue), F.lit("unknown")).isin("unknown", "n/a", ""), F.col("n")).otherwise(0))
    x = per.agg(F.count("*").alias("venues"), F.sum("n").alias("n"), F.max("n").alias("most"), unknown.alias("unknown"))
    return x.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 10 * F.col("venues") / F.col("n")) - F.col("unknown") / F.col("n")), "imbalanced": F.col("most") > 10 * F.col("n") / F.col("venues")})


def year_coverage(rows: DataFrame, year: str, as_of_year: int) -> DataFrame:
    x = rows.agg(F.min(year).alias("first"), F.max(year).alias("last"))
    return x.withColumns({"score": F.least(F.lit(1.0), (F.col("last") - F.col("first") + 1) / 5), "recent": F.col("last") >= as_of_year - 1})


def source_coverage(rows: DataFrame, source: str) -> DataFrame:
    known = F.countDistinct(F.when(F.lower(source) != "unknown", F.col(source)))
    return rows.agg(known.alias("sources")).withColumn("score", F.when(F.col("sources") == 0, 0.5).otherwise(F.least(F.lit(1.0), F.col("sources") / 3)))


def domain_balance(rows: DataFrame, domain: str) -> DataFrame:
    n = rows.groupBy(domain).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return n.withColumn("share", F.col("n") / total).withColumn("verdict", F.when(F.col("share") > 0.5, "dominant").when((F.col("share") < 0.05) & (total > 100), "rare").otherwise("ok"))


def temporal_balance(rows: DataFrame, year: str, first: int, last: int) -> DataFrame:
    years = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    n = rows.groupBy(F.col(year).cast("int").alias("year")).agg(F.count("*").alias("n"))
    x = F.broadcast(years).join(n, "year", "left").na.fill(0, ["n"])
    return x.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy())), F.lit(0.0))).withColumn("enough", F.col("share") >= 0.05)


def identical_counts(rows: DataFrame, count: str, ident: str, least: int = 100, more_than: int = 5) -> DataFrame:
    """Counts above ``least`` that more than ``more_than`` rows share."""
    return rows.filter(F.col(count) > least).groupBy(count).agg(F.count("*").alias("n"), F.min(ident).alias("example")).filter(F.col("n") > more_than)


def field_coverage(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Per group and field: share present, distinct values, mean and deviation."""
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("x")).select(by, "x.*")
    return long.groupBy(by, "field").agg(F.count("*").alias("n"), F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"), F.countDistinct("v").alias("values"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


# Affiliations whose type is known, and the weights of a validation.
KNOWN_AFFILIATIONS = [("MIT Computer Science", "academic"), ("Stanford University AI Lab", "academic"), ("Carnegie Mellon University", "academic"), ("University of Toronto Vector Institute", "academic"), ("Mila - Quebec AI Institute", "academic"),
                      ("Google Research", "industry"), ("OpenAI", "industry"), ("Microsoft Research", "industry"), ("Meta AI Research", "industry"), ("DeepMind", "industry")]
VALIDATION_WEIGHTS = (0.4, 0.3, 0.3)


def edge_cases(papers: DataFrame, ident: str, academic: Column, industry: Column, unknown: Column, confidence: Column) -> DataFrame:
    """(ident, reason, value) for papers that need a look: confidence under .5,
    more than half of the authors unknown, an industry share of .2 to .3."""
    share = F.try_divide(industry, academic + industry)
    missing = F.try_divide(unknown, academic + industry + unknown)
    found = F.array(F.when(confidence < 0.5, F.struct(F.lit("low_confidence").alias("reason"), confidence.cast("double").alias("value"))),
                    F.when(missing > 0.5, F.struct(F.lit("high_unknown_percentage").alias("reason"), missing.cast("double").alias("value"))),
                    F.when((share >= 0.2) & (share <= 0.3), F.struct(F.lit("borderline_threshold").alias("reason"), share.cast("double").alias("value"))))
    return papers.select(ident, F.explode(F.array_compact(found)).alias("_x")).select(ident, "_x.*")


def classification_validation(papers: DataFrame, category: str, confidence: Column, classify) -> DataFrame:
    """One row: papers, mean, least and largest confidence, how many are low
    (under .5) or high (over .8), the share for review, the accuracy of
    ``classify`` (affiliation -> type) on affiliations whose type is known, and
    the weighted score."""
    known = papers.sparkSession.createDataFrame(KNOWN_AFFILIATIONS, "affiliation string, type string")
    right = known.select((classify(F.col("affiliation")) == F.col("type")).alias("ok"), "type")
    right = right.groupBy().agg(*[F.avg(F.when(F.col("type") == t, F.col("ok").cast("double"))).alias(f"{t}_accuracy") for t in ("academic", "industry")])
    c = confidence
    facts = papers.agg(F.count("*").alias("papers"), F.coalesce(F.avg(c), F.lit(0.0)).alias("average_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"), F.count_if(c < 0.5).alias("low_confidence"),
                       F.count_if(c > 0.8).alias("high_confidence"), F.coalesce(F.avg((F.col(category) == "needs_review").cast("double")), F.lit(1.0)).alias("review_share"))
    a, b, d = VALIDATION_WEIGHTS
    out = facts.crossJoin(F.broadcast(right))  # one row each
    score = a * (F.col("academic_accuracy") + F.col("industry_accuracy")) / 2 + b * F.col("average_confidence") + d * F.greatest(F.lit(0.0), 1 - F.col("review_share"))
    return out.withColumn("score", F.least(F.lit(1.0), score))
