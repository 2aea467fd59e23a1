"""Title matches with safety factors and a label of confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import fuzzy
from scholia.functions.text import collapsed

# What titles carry besides their words, removed in this order.
TITLE_NOISE = [r"\s*\(extended abstract\)", r"\s*\(short paper\)", r"\s*\(long paper\)", r"\s*\(poster\)", r"\s*\(demo\)", r"\s*\(vision paper\)", r"\s*\(position paper\)", r"\s*\(supplementary material\)", r"\s*\(appendix\)",
               r"\s*:\s*supplementary.*", r"\s*-\s*supplementary.*", r"\s*\[.*\]$", r"\s*\(.*arxiv.*\)"]
# Labels from the least, and the scores that high and medium take.
LABELS = ["no_match", "low_confidence", "medium_confidence", "high_confidence", "exact"]
HIGH, MEDIUM, LOW = 0.95, 0.85, 0.7
CONTAINED, OTHER_YEARS, NEXT_YEAR, NO_AUTHOR = 0.98, 0.5, 0.95, 0.3


def matching_key(title: Column) -> Column:
    """Lower case, without noise and punctuation, single spaces."""
    out = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    for pattern in TITLE_NOISE:
        out = F.regexp_replace(out, pattern, "")
    return collapsed(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s\-:,]", " "), "[:,-]", " "))


def with_title_match(pairs: DataFrame, title1: str, title2: str, year1: str | None = None, year2: str | None = None, authors1: str | None = None, authors2: str | None = None, checks: bool = True) -> DataFrame:
    """``pairs`` with ``similarity`` and ``label`` of their titles.

    Equal keys are 1, a key inside the other .98, others a blend of four
    ratios, the one part of the titles that runs in Python. Years more than one
    apart halve it, and for blends neighbouring years take .95 (years that are
    null or 0 say nothing). Authors, where both lists have some, take .3 plus .7
    times their overlap. Null and empty titles match nothing."""
    x = pairs.withColumns({"_a": matching_key(F.col(title1)), "_b": matching_key(F.col(title2))})
    a, b = F.col("_a"), F.col("_b")
    x = x.withColumn("_arm", F.when(a == b, 0).when(F.contains(a, b) | F.contains(b, a), 1).otherwise(2))
    same, inside, other = (F.col("_arm") == i for i in range(3))
    x = x.withColumn("_blend", fuzzy.similarity("title_rest")(F.when(other, a), F.when(other, b)))
    score = F.when(same, 1.0).when(inside, CONTAINED).otherwise(F.col("_blend"))
    if checks and year1 and year2:
        gap = F.when((F.col(year1) != 0) & (F.col(year2) != 0), F.abs(F.col(year1) - F.col(year2)))
        score = score * F.when(gap > 1, OTHER_YEARS).when(other & (gap == 1), NEXT_YEAR).otherwise(1.0)
    if checks and authors1 and authors2:
        both = (F.size(authors1) > 0) & (F.size(authors2) > 0)
        x = x.withColumn("_overlap", fuzzy.similarity("author_overlap")(F.when(both, F.col(authors1)), F.when(both, F.col(authors2))))
        score = score * F.coalesce(NO_AUTHOR + (1 - NO_AUTHOR) * F.col("_overlap"), F.lit(1.0))
    empty = (F.coalesce(F.length(title1), F.lit(0)) == 0) | (F.coalesce(F.length(title2), F.lit(0)) == 0)
    x = x.withColumn("similarity", F.when(empty, 0.0).otherwise(score))
    s = F.col("similarity")
    label = F.when(empty, LABELS[0]).when(same & (s >= 1), LABELS[4]).when(s >= HIGH, LABELS[3]).when(s >= MEDIUM, LABELS[2]).when(inside | (s > LOW), LABELS[1]).otherwise(LABELS[0])
    return x.withColumn("label", label).drop("_a", "_b", "_arm", "_blend", "_overlap")


def at_least(label: Column, least: str = "high_confidence") -> Column:
    """Whether a label is ``least`` or better; an unknown ``least`` is high."""
    ranks = F.create_map(*[x for i, name in enumerate(LABELS) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(ranks[label], F.lit(0)) >= (LABELS.index(least) if least in LABELS else 3)
