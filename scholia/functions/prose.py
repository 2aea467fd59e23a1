"""Indicators, domain metrics, affiliations and field rules over prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import collapsed, text_or_empty, word_count

# Phrases of experiments by strength, and terms behind three flags.
PHRASES = {
    "strong": ["we implement", "we develop", "we build", "we design", "we propose and implement", "our implementation", "our system", "our algorithm", "we evaluate", "experimental results",
               "empirical evaluation", "extensive experiments", "real-world experiments", "experimental setup", "experimental validation"],
    "medium": ["we test", "we measure", "we compare", "we analyze", "we benchmark", "performance evaluation", "experimental study", "case study", "simulation results", "synthetic experiments", "controlled experiments"],
    "weak": ["we propose", "we present", "we introduce", "theoretical analysis", "we prove", "we show", "formal analysis", "mathematical framework"]}
FLAGS = {"implementation_mentioned": ["implement", "implementation", "prototype", "system"], "evaluation_mentioned": ["evaluat", "experiment", "benchmark", "test", "measur"],
         "theoretical_focus": ["theorem", "proof", "lemma", "corollary", "formal"]}
# Indicator families with their weights, section words, and signs of an experimental paper.
FAMILIES = {
    "experimental": (0.3, ["experiment", "evaluation", "benchmark", "baseline", "results", "performance", "accuracy", "precision", "recall", "ablation", "comparison", "validation", "test set", "training set",
                           "dataset", "implementation", "code", "empirical", "empirical study", "experimental study", "case study", "user study", "evaluation study"]),
    "methodology": (0.2, ["method", "approach", "algorithm", "technique", "architecture", "model", "framework", "system", "methodology", "procedure", "protocol", "setup", "experimental setup", "experimental design"]),
    "implementation": (0.2, ["implementation", "code", "software", "library", "framework", "platform", "tool", "system", "open source", "github", "repository", "source code", "programming", "development", "built", "developed"]),
    "quantitative": (0.15, ["metrics", "measurement", "quantitative", "statistical", "analysis", "score", "rating", "numerical", "data", "statistics", "significance", "correlation", "regression"])}
SECTIONS = {"results": r"\b(?:results?|findings?|outcomes?)\b", "experiments": r"\b(?:experiments?|experimental)\b", "evaluation": r"\b(?:evaluation|evaluating|evaluated)\b",
            "methodology": r"\b(?:methodology|methods?|approach)\b", "implementation": r"\b(?:implementation|implementing|implemented)\b"}
SIGNS = {
    "results_section": ["results section", "experimental results", "evaluation results", "results and discussion", "findings"],
    "implementation_details": ["implementation details", "hyperparameters", "training details", "experimental setup", "implementation notes"],
    "performance_metrics": ["performance metrics", "evaluation metrics", "accuracy score", "precision recall", "f1 score", "auc score"],
    "comparative_analysis": ["comparison with", "compared to", "baseline comparison", "state-of-the-art", "outperforms", "competitive with"],
    "statistical_analysis": ["statistical significance", "p-value", "confidence interval", "statistical test", "significance test"],
    "reproducibility": ["reproducible", "code available", "open source", "github repository", "replication"]}
SECTION_BOOST, SIGN_BOOST, EXPERIMENTAL_AT, SIGNS_AT = 0.02, 0.01, 0.4, 3
CONFIDENCE = {"score": 0.7, "results": 0.15, "methodology": 0.1, "evaluation": 0.05}


def _found(low: Column, words: list[str]) -> Column:
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def indicators(text: Column) -> Column:
    """How many strong, medium and weak phrases a text has, and three flags."""
    low = F.lower(text_or_empty(text))
    return F.struct(*[_found(low, words).alias(name) for name, words in PHRASES.items()], *[(_found(low, words) > 0).alias(name) for name, words in FLAGS.items()])


def experimental(text: Column) -> Column:
    """score (0 to 1), is_experimental and confidence: the shares of four
    families' words that occur, weighted, with a boost for each kind of section
    and each sign."""
    text = text_or_empty(text)
    low = F.lower(text)
    families = sum((weight * _found(low, words) / len(words) for weight, words in FAMILIES.values()), F.lit(0.0))
    section = {name: text.rlike("(?i)" + p) for name, p in SECTIONS.items()}
    sign = {name: _found(low, words) > 0 for name, words in SIGNS.items()}
    signs = sum((x.cast("int") for x in sign.values()), F.lit(0))
    score = F.least(F.lit(1.0), families + SECTION_BOOST * sum((x.cast("int") for x in section.values()), F.lit(0)) + SIGN_BOOST * signs)
    is_ = (score >= EXPERIMENTAL_AT) | section["results"] & section["experiments"] | (signs >= SIGNS_AT) | sign["implementation_details"] & sign["performance_metrics"]
    sure = score * CONFIDENCE["score"] + sum((F.when(section[k], v).otherwise(0.0) for k, v in CONFIDENCE.items() if k in section), F.lit(0.0))
    return F.struct(score.alias("score"), is_.alias("is_experimental"), F.least(F.lit(1.0), sure).alias("confidence"))


# Phrases of records, and papers that are landmarks by name.
SOTA = [r"state[- ]of[- ]the[- ]art", r"sota", r"new\s+record", r"surpass(?:es|ed)?\s+previous", r"outperform(?:s|ed)?", r"best\s+performance", r"achieve(?:s|d)?\s+new", r"superior\s+to\s+existing", r"achieving\s+sota"]
LANDMARKS = ["bert", "gpt", "transformer", "resnet", "efficientnet", "yolo", "vit", "vision transformer", "alphago", "alphafold"]


def is_sota(text: Column, citations: Column, year: Column, as_of_year: int) -> Column:
    """By phrase, by a landmark's name, or by more than 50 citations a year
    (papers of earlier years only)."""
    low = F.lower(text_or_empty(text))
    age = F.lit(as_of_year) - year
    often = (citations > 0) & (age > 0) & (citations > 50 * age)
    return low.rlike("|".join(SOTA)) | (_found(low, LANDMARKS) > 0) | F.coalesce(often, F.lit(False))


# First year of each accelerator, and steps of plausibility.
FIRST_YEAR = {"V100": 2017, "A100": 2020, "H100": 2022, "TPU": 2016}
PARAMETERS_BY_YEAR = [(2018, 1e9, 0.7), (2020, 1e10, 0.6), (2022, 1e11, 0.7), (9999, 1e12, 0.8)]  # up to a year, beyond a count: factor
HOURS_STEPS = [(1e6, 0.5), (1e5, 0.8)]
ANACHRONISM, NO_COMPUTE = 0.3, 0.3


def plausibility(kind: Column, year: Column, hours: Column, parameters: Column, count: Column | None = None, days: Column | None = None) -> Column:
    """1, times a factor for an accelerator before its time, for a model too
    large for its year, for very many hours, and if no compute is known at all
    (null and 0 count as unknown)."""
    known = lambda c: F.coalesce(c.cast("double"), F.lit(0.0)) != 0
    out = F.lit(1.0)
    for name, first in FIRST_YEAR.items():
        out = out * F.when(kind.contains(name) & (year < first), ANACHRONISM).otherwise(1.0)
    size = F.lit(1.0)
    for last, beyond, factor in reversed(PARAMETERS_BY_YEAR):
        size = F.when((year <= last) & (parameters > beyond), factor).otherwise(size)
    long = F.lit(1.0)
    for beyond, factor in reversed(HOURS_STEPS):
        long = F.when(hours > beyond, factor).otherwise(long)
    any_ = known(hours) | known(parameters)
    for c in (count, days):
        any_ = any_ | known(c) if c is not None else any_
    return out * size * long * F.when(any_, 1.0).otherwise(NO_COMPUTE)


def field_agreement(kind: str, one: Column, two: Column, tolerance: float = 0.1) -> Column:
    """Text regardless of case, numbers within a relative tolerance, lists by a
    Jaccard index of .8 or more; null agrees with nothing."""
    if kind == "text":
        same = F.lower(F.trim(one)) == F.lower(F.trim(two))
    elif kind == "number":
        same = F.abs(one - two) <= tolerance * F.greatest(F.abs(one), F.abs(two))
    else:
        same = F.coalesce(F.try_divide(F.size(F.array_intersect(one, two)), F.size(F.array_union(one, two))), F.lit(0.0)) >= 0.8
    return F.coalesce(same, F.lit(False))


def primary_institution(affiliation: Column) -> Column:
    """The first segment that names a university, institute, laboratory or
    company; else the first segment, without a department before it."""
    parts = F.transform(F.split(text_or_empty(affiliation), r"\s*[,;]\s*"), collapsed)
    known = F.get(F.filter(parts, lambda x: F.lower(x).rlike(r"universit|institut|college|laborator|research|school of|corp|inc\b|google|microsoft|facebook|deepmind|openai|nvidia")), F.lit(0))
    return F.coalesce(known, F.regexp_replace(F.get(parts, F.lit(0)), r"(?i)^(?:dept\.?|department|faculty|school) of \w+\s*", ""))


def density(text: Column, words: list[str]) -> Column:
    """Whole-word hits per 100 words."""
    n = F.size(F.split(collapsed(text_or_empty(text)), " "))
    return 100.0 * word_count(text, words) / n
