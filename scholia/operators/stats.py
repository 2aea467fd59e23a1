"""Outliers, trends, calibration and consistency."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.operators.joins import settled
from scholia.operators.quantiles import counted, quantiles, with_quantiles


def _spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    moments = rows.groupBy(by).agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"))
    return with_quantiles(moments, rows, [by], value, {"_q1": 0.25, "_med": 0.5, "_q3": 0.75})


def outliers(rows: DataFrame, by: str, value: str, z: float = 3.0, iqr: float = 1.5, mad: float = 3.5) -> DataFrame:
    """is_z, is_iqr, is_mad and is_outlier (two votes of three). Too small or
    spreadless groups: z needs 3 values, quartiles 4 (without a spread: z), the
    median deviation 10 (below: quartiles). Rows without a group are left out."""
    rows = rows.filter(F.col(by).isNotNull())
    x = rows.join(settled(_spread(rows, by, value)), by)
    far = x.select(by, F.abs(F.col(value) - F.col("_med")).alias("_dev"))
    x = x.join(settled(quantiles(counted(far, [by], "_dev"), [by], "_dev", {"_mad": 0.5})), by, "left")
    v = F.col(value)
    is_z = (F.col("_n") >= 3) & (F.col("_std") > 0) & F.coalesce(F.abs(F.try_divide(v - F.col("_mean"), F.col("_std"))) > z, F.lit(False))
    width = F.col("_q3") - F.col("_q1")
    is_iqr = F.when(F.col("_n") < 4, False).when(width == 0, is_z).otherwise((v < F.col("_q1") - iqr * width) | (v > F.col("_q3") + iqr * width))
    is_mad = F.when(F.col("_n") < 10, is_iqr).otherwise(F.coalesce(F.abs(F.try_divide(0.6745 * (v - F.col("_med")), F.col("_mad"))) > mad, F.lit(False)))
    x = x.withColumns({"is_z": F.coalesce(is_z, F.lit(False)), "is_iqr": F.coalesce(is_iqr, F.lit(False)), "is_mad": F.coalesce(is_mad, F.lit(False))})
    votes = F.col("is_z").cast("int") + F.col("is_iqr").cast("int") + F.col("is_mad").cast("int")
    return x.withColumn("is_outlier", votes >= 2).drop("_n", "_mean", "_std", "_q1", "_med", "_q3", "_mad")


def linear_trend(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least squares per group: slope, intercept, r2, the slope's standard error,
    1.96 error bounds, and the deviation of residuals."""
    n = F.regr_count(y, x)
    fit = rows.groupBy(by).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("_syy"), F.regr_sxx(y, x).alias("_sxx"))
    err = F.sqrt(F.greatest(F.lit(0.0), F.try_divide((1 - F.col("r2")) * F.col("_syy"), F.col("_sxx") * (F.col("n") - 2))))
    fit = fit.withColumn("std_err", F.when(F.col("n") > 2, err))
    direction = F.when(F.abs("slope") < F.col("std_err"), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    residual = F.sqrt(F.greatest(F.lit(0.0), F.try_divide((1 - F.col("r2")) * F.col("_syy"), F.col("n"))))
    return fit.withColumns({"low": F.col("slope") - 1.96 * F.col("std_err"), "high": F.col("slope") + 1.96 * F.col("std_err"), "direction": direction, "residual_std": residual}).drop("_syy", "_sxx")


def forecast(fit: DataFrame, at: Column, ahead: dict[str, float]) -> DataFrame:
    """Predictions ``ahead`` of ``at`` with 1.96 residual deviations."""
    cols = {}
    for name, d in ahead.items():
        mid = F.col("intercept") + F.col("slope") * (at + d)
        cols |= {name: mid, f"{name}_low": mid - 1.96 * F.col("residual_std"), f"{name}_high": mid + 1.96 * F.col("residual_std")}
    return fit.withColumns(cols)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return h


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| > t)."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def p_value(slope: pd.Series, err: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a slope; a row per group, so few rows."""
    return pd.Series([None if not e or e != e or k <= 2 else t_two_sided(abs(s / e), k - 2) for s, e, k in zip(slope, err, n)], dtype="float64")


def calibration(rows: DataFrame, field: str, manual: str, automated: str) -> DataFrame:
    """Per field the line from automated to manual values; reliable above r2 .7."""
    fit = rows.groupBy(field).agg(F.regr_count(manual, automated).alias("n"), F.regr_slope(manual, automated).alias("slope"), F.regr_intercept(manual, automated).alias("intercept"), F.regr_r2(manual, automated).alias("r2"))
    return fit.filter("n >= 5").withColumn("reliable", F.col("r2") > 0.7)


def temporal_consistency(rows: DataFrame, by: str, year: str, value: str) -> DataFrame:
    """exp(slope) - 1 of ln(value) over years: yearly growth."""
    ok = rows.filter(F.col(value) > 0)
    return ok.groupBy(by).agg(F.count("*").alias("n"), (F.exp(F.regr_slope(F.ln(value), F.col(year).cast("double"))) - 1).alias("growth"))


def cross_consistency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Coefficient of variation and the share beyond 2 deviations; consistent
    when they are at most 1 and .2."""
    v = F.col(value)
    s = rows.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
    out = rows.join(s, by).groupBy(by).agg(F.first("n").alias("n"), F.first(F.try_divide("std", "mean")).alias("cv"), F.avg((F.abs(v - F.col("mean")) > 2 * F.col("std")).cast("double")).alias("outlier_share"))
    return out.withColumn("consistent", (F.col("cv") <= 1) & (F.col("outlier_share") <= 0.2))


def clusters(vectors: DataFrame, column: str, k: int, seed: int = 42) -> DataFrame:
    """K-means over an array<float> column (Spark ML, k-means|| start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    x = vectors.withColumn("_features", array_to_vector(F.col(column).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(x).transform(x).drop("_features")


def text_clusters(rows: DataFrame, text: str, k: int, seed: int = 42, features: int = 1000) -> DataFrame:
    """TF-IDF of 1- and 2-grams, then K-means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, VectorAssembler
    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern="\\W+", minTokenLength=2), NGram(n=2, inputCol="_w", outputCol="_2"), CountVectorizer(inputCol="_w", outputCol="_c1", vocabSize=features // 2),
              CountVectorizer(inputCol="_2", outputCol="_c2", vocabSize=features // 2), VectorAssembler(inputCols=["_c1", "_c2"], outputCol="_c"), IDF(inputCol="_c", outputCol="_features"), KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("_w", "_2", "_c1", "_c2", "_c", "_features")


# Known extremes, usual values, and title words that explain an outlier.
KNOWN_EXTREMES = {"parameters": {"gpt3": 175e9, "palm": 540e9, "gpt4": 1.76e12}, "gpu_hours": {"gpt3": 3.64e6, "palm": 6e6}}
USUAL = {"gpu_hours": 1000, "parameters": 1e8, "training_time": 24, "batch_size": 32, "gpu_count": 8, "epochs": 100, "gpu_memory": 32}
NOVEL, LARGE, SMALL = ["novel", "new", "introducing", "proposing"], ["large", "giant", "massive", "billion"], ["efficient", "lightweight", "tiny", "small"]
EARLY = {"parameters": (2018, 1e10, "Unusually large for "), "gpu_hours": (2015, 1e5, "Very high GPU hours for ")}


def outlier_context(field: str, value: Column, title: Column, year: Column, citations: Column) -> Column:
    """struct<reasons, severity> of an outlying value. Each test that holds adds
    its reason; a test moves the severity only from those named with it."""
    low = F.lower(F.coalesce(title, F.lit("")))
    any_of = lambda words: F.greatest(*[low.contains(w) for w in words])
    extreme = F.coalesce(*[F.when(F.abs(value - k) / k < 0.3, F.lit(f"Similar to known extreme: {n}")) for n, k in KNOWN_EXTREMES.get(field, {}).items()], F.lit(None).cast("string"))
    before, beyond, words = EARLY.get(field, (0, 0.0, ""))
    tests = [
        (extreme.isNotNull(), extreme, "expected", None),
        (extreme.isNull() & any_of(NOVEL), F.lit("Paper describes novel architecture"), "possible", ["unknown"]),
        (extreme.isNull() & any_of(LARGE), F.lit("Paper explicitly mentions large scale"), "expected", ["unknown", "possible"]),
        (any_of(SMALL) & (value > 2 * USUAL.get(field, 1.0)), F.lit("High value despite efficiency claims"), "suspicious", None),
        ((year < before) & (value > beyond), F.concat(F.lit(words), year.cast("string")), "suspicious", None),
        (citations > 1000, F.lit("Highly cited paper - might be breakthrough"), "possible", ["unknown", "possible"]),
    ]
    severity = F.lit("unknown")
    for test, _, to, only in tests:
        moves = F.coalesce(test, F.lit(False)) & (severity.isin(*only) if only else F.lit(True))
        severity = F.when(moves, to).otherwise(severity)
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), reason) for test, reason, _, _ in tests]))
    return F.struct(F.when(F.size(reasons) == 0, F.array(F.lit("No specific context identified"))).otherwise(reasons).alias("reasons"), severity.alias("severity"))


def corroborated(field: str, value: Column, of: dict[str, Column]) -> Column:
    """Whether other extracted values support an extreme one; absent ones are 0."""
    v = lambda n, d=0.0: F.coalesce(of[n].cast("double"), F.lit(d)) if n in of else F.lit(d)
    against = {"parameters": (value > 1e10) & (v("gpu_hours") < 1000), "gpu_hours": (value > 1e5) & (v("parameters") < 1e8) & (v("training_time") < 100), "batch_size": (value > 1000) & (v("gpu_memory") < 16)}
    return ~against.get(field, F.lit(False))


def consistent(field: str, value: Column, of: dict[str, Column]) -> Column:
    """Whether a value fits what other fields let expect: hours by accelerators
    and days, parameters by the size of the model (.25e9 a GB)."""
    v = lambda n, d=0.0: F.coalesce(of[n].cast("double"), F.lit(d)) if n in of else F.lit(d)
    if field == "gpu_hours":
        expected, most = v("gpu_count", 1.0) * v("training_time"), 0.5
    elif field == "parameters":
        expected, most = v("model_size_gb") * 0.25e9, 1.0
    else:
        return F.lit(True)
    return ~F.coalesce((expected > 0) & (F.abs(value - expected) / F.nullif(expected, F.lit(0.0)) > most), F.lit(False))


def keep_outlier(field: str, value: Column, severity: Column, of: dict[str, Column]) -> Column:
    """Uncorroborated and suspicious values go, expected ones stay, the rest
    stay if they are consistent."""
    return corroborated(field, value, of) & F.when(severity == "expected", True).when(severity == "suspicious", False).otherwise(consistent(field, value, of))


def sample_by_strata(rows: DataFrame, stratum: str, ident: str, size: int, how: str = "equal", seed: int = 42) -> DataFrame:
    """``size`` rows, chosen by a hash of (ident, seed). how: "equal" gives each
    stratum the same quota and the first ones, in order, the remainder;
    "proportional" gives each its share rounded down and fills up from all other
    rows; "random" knows no strata. Tables of at most ``size`` rows stay whole."""
    key = F.xxhash64(ident, F.lit(seed))
    if how == "random":
        return rows.orderBy(key, ident).limit(size)
    if how == "equal":
        rows = rows.filter(F.col(stratum).isNotNull())
    rows = rows.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("unknown")) if how == "proportional" else F.col(stratum))
    counts = rows.groupBy("_s").agg(F.count("*").alias("_n"))  # one row a stratum
    total, strata = counts.agg(F.sum("_n"), F.count("*")).first()
    if not total or total <= size:
        return rows.drop("_s")
    if how == "equal":
        quota = F.lit(size // strata) + F.when(F.row_number().over(Window.orderBy("_s")) <= size % strata, 1).otherwise(0)
    else:
        quota = F.floor(F.col("_n") * size / F.lit(total))
    ranked = rows.join(counts.select("_s", quota.alias("_q")), "_s").withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(key, ident)))
    chosen = ranked.filter("_r <= _q").select(rows.columns)
    if how == "proportional":
        rest = ranked.filter("_r > _q").select(rows.columns).orderBy(key, ident).limit(size - chosen.count())
        chosen = chosen.unionByName(rest)
    return chosen.drop("_s")


# What counts as recent on average, and usual means and deviations.
RECENT = 2020
NORMS = {"gpu_hours": (500, 300), "parameters": (100, 200), "batch_size": (32, 16)}
WITHIN = 3.0


def outlier_pattern(outliers: DataFrame, papers: DataFrame, field: str = "field", year: str = "year") -> DataFrame:
    """Per field: how many outliers, of how many papers, their first and last
    year (0 and null are none) and whether they are recent on average."""
    y = F.when(F.col(year) != 0, F.col(year))
    n = outliers.groupBy(F.coalesce(field, F.lit("unknown")).alias("field")).agg(F.count("*").alias("n"), F.min(y).alias("min_year"), F.max(y).alias("max_year"), F.when(F.avg(y) > RECENT, "recent").when(F.count(y) > 0, "historical").alias("concentration"))
    return n.crossJoin(F.broadcast(papers.agg(F.count("*").alias("papers")))).withColumn("rate", F.col("n") / F.nullif("papers", F.lit(0)))  # one row


def within_norms(name: str, value: Column) -> Column:
    """Whether a value is less than three deviations from its usual mean; null
    and values up to 0 aren't judged."""
    mean, std = NORMS[name]
    return F.when(value > 0, F.abs(value - mean) / std < WITHIN)
