"""Metrics and benchmarks that language, vision and control papers report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import text_or_empty

# Patterns of each metric, tried in order; the first group is the value, a second its unit.
PATTERNS = {
    "tokens": [r"(\d+\.?\d*)\s*billion\s+(?:tokens?|words?)", r"(\d+\.?\d*)\s*([BMK])\s*(?:tokens?|words?)", r"trained\s+on\s+(\d+\.?\d*)\s*([BMK])?\s*(?:tokens?|words?)"],
    "vocabulary": [r"vocabulary\s+(?:size\s+)?(?:of\s+)?(\d+(?:,\d+)*)", r"(\d+(?:,\d+)*)[- ]?(?:word)?pieces?", r"vocab(?:ulary)?\s+(?:of\s+)?(\d+(?:,\d+)*)"],
    "sequence": [r"(?:max(?:imum)?\s+)?sequence\s+length\s+(?:was\s+)?(?:set\s+to\s+)?(\d+)", r"(\d+)\s+tokens?\s+(?:sequence|context)", r"context\s+(?:window|length)\s+(?:of\s+)?(\d+)"],
    "resolution": [r"(\d+)\s*[x×]\s*(\d+)(?:\s*(?:px|pixels?))?", r"resolution\s+(?:of\s+)?(\d+)\s*[x×]\s*(\d+)", r"(\d+)p\s+(?:images?|frames?)"],
    "fps": [r"(\d+\.?\d*)\s*(?:images?|frames?)\s*(?:per\s*|/)\s*(?:second|sec|s)", r"(\d+\.?\d*)\s*fps", r"throughput\s+(?:of\s+)?(\d+\.?\d*)"],
    "steps": [r"(\d+\.?\d*)\s*([BMK])?\s*(?:environment\s+)?steps?", r"(\d+\.?\d*)\s*([BMK])?\s*(?:training\s+)?frames?", r"trained?\s+(?:for\s+)?(\d+\.?\d*)\s*([BMK])?\s*episodes?"],
    "days": [r"(?:total\s+)?simulation\s+time(?:\s*[:])\s*(\d+\.?\d*)\s*days?", r"(\d+\.?\d*)\s*days?\s+(?:of\s+)?(?:simulation|training)", r"(\d+\.?\d*)\s*(?:gpu|cpu)\s*days?"],
    "environments": [r"(\d+)\s*parallel\s+(?:environments?|workers?|actors?)"],
    "replay": [r"(?:replay\s+)?buffer\s+(?:size\s*[:])\s*(\d+\.?\d*)\s*([BMK])?\s*(?:transitions?)?", r"(\d+\.?\d*)\s*([BMK])\s*transitions?"],
}
UNITS = {"B": 1e9, "M": 1e6, "K": 1e3}
PRE_TRAINING, FINE_TUNING, MULTI_SCALE = r"pre[- ]?train", r"fine[- ]?tun", r"multi[- ]?scale"
AUGMENTATION = ["augment", "randaugment", "autoaugment", "cutmix", "mixup"]
WORDS_A_TOKEN, BASE_PIXELS, MULTI_SCALE_COST, AUGMENTATION_COST, MOST_OVERHEAD = 0.75, 224 * 224, 1.5, 1.2, 3.0
# Benchmarks by domain.
LANGUAGE = ["GLUE", "SuperGLUE", "SQuAD", "WMT", "CommonCrawl", "BERT", "RoBERTa", "GPT", "T5", "MMLU", "HellaSwag", "ARC", "BoolQ", "CoQA", "RACE", "SWAG", "Winograd"]
MODELS_TOO = ["BERT", "GPT", "T5"]
VISION = ["ImageNet", "COCO", "CIFAR", "CIFAR-10", "CIFAR-100", "ADE20K", "Kinetics", "Pascal VOC", "CityScapes", "Open Images", "KITTI", "ModelNet", "ShapeNet"]
CONTROL = ["Atari", "MuJoCo", "OpenAI Gym", "Gym", "StarCraft", "Dota", "Go", "Chess", "Shogi", "Hex", "Hanabi", "DeepMind Control", "DMC", "Minecraft", "NetHack"]
OTHER_NAMES = {"OpenAI Gym": ["gym", "openai gym"], "DeepMind Control": ["dmc", "deepmind control"]}


def _first(text: Column, name: str, make) -> Column:
    """What ``make(pattern)`` gives for the first pattern that is found."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), make(f"(?i){p}")) for p in PATTERNS[name]])


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _number(text: Column, pattern: str) -> Column:
    return F.replace(_group(text, pattern, 1), F.lit(","), F.lit("")).cast("double")


def _scaled(text: Column, units: dict[str, float], billion: bool = False):
    def make(pattern: str) -> Column:
        factor = F.lit(1.0)
        if "[BMK]" in pattern:
            unit = F.upper(_group(text, pattern, 2))
            factor = F.coalesce(*[F.when(unit == u, v) for u, v in units.items()], F.lit(1.0))
        if billion:
            factor = F.when(F.lower(F.regexp_extract(text, pattern, 0)).contains("billion"), 1e9).otherwise(factor)
        return (_number(text, pattern) * factor).cast("long")
    return make


def language_metrics(text: Column) -> Column:
    """struct<tokens, vocabulary, sequence, pre_training, fine_tuning, words>:
    words are .75 of the tokens, null without any."""
    t = text_or_empty(text)
    tokens = _first(t, "tokens", _scaled(t, UNITS, billion=True))
    whole = lambda name: _first(t, name, lambda p: _number(t, p).cast("long"))
    return F.struct(tokens.alias("tokens"), whole("vocabulary").alias("vocabulary"), whole("sequence").alias("sequence"), t.rlike(f"(?i){PRE_TRAINING}").alias("pre_training"), t.rlike(f"(?i){FINE_TUNING}").alias("fine_tuning"),
                    F.when(tokens != 0, (tokens * WORDS_A_TOKEN).cast("long")).alias("words"))


def vision_metrics(text: Column) -> Column:
    """struct<width, height, fps, augmentation, multi_scale, overhead>. A match
    with a "p" in it ("1080p frames", but "640x480 pixels" too) is a height of a
    16:9 picture. Overhead: the picture's share of 224x224, times 1.5 and 1.2
    for several scales and for augmentation, 3 at most."""
    t = text_or_empty(text)

    def size(pattern: str) -> Column:
        high = _group(t, pattern, 1).cast("long")
        tall = F.struct((high * 16 / 9).cast("long").alias("width"), high.alias("height"))
        if pattern.count("(\\d+)") < 2:
            return tall
        return F.when(F.regexp_extract(t, pattern, 0).contains("p"), tall).otherwise(F.struct(high.alias("width"), _group(t, pattern, 2).cast("long").alias("height")))

    picture = _first(t, "resolution", size)
    augmented = reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in AUGMENTATION])
    scales = t.rlike(f"(?i){MULTI_SCALE}")
    cost = F.coalesce(picture["width"] * picture["height"] / BASE_PIXELS, F.lit(1.0)) * F.when(scales, MULTI_SCALE_COST).otherwise(1.0) * F.when(augmented, AUGMENTATION_COST).otherwise(1.0)
    return F.struct(picture["width"].alias("width"), picture["height"].alias("height"), _first(t, "fps", lambda p: _number(t, p)).alias("fps"), augmented.alias("augmentation"), scales.alias("multi_scale"),
                    F.least(cost, F.lit(MOST_OVERHEAD)).alias("overhead"))


def control_metrics(text: Column) -> Column:
    """struct<steps, days, environments, replay, hours>: hours are 24 a day for
    each environment (one if none is told), 0 without days. A replay size in B
    counts as it stands."""
    t = text_or_empty(text)
    days = _first(t, "days", lambda p: _number(t, p))
    many = _first(t, "environments", lambda p: _number(t, p).cast("long"))
    replay = _first(t, "replay", _scaled(t, {k: v for k, v in UNITS.items() if k != "B"}))
    return F.struct(_first(t, "steps", _scaled(t, UNITS)).alias("steps"), days.alias("days"), many.alias("environments"), replay.alias("replay"), F.coalesce(days * 24 * F.coalesce(many, F.lit(1)), F.lit(0.0)).alias("hours"))


def _named(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in pairs]))))


def language_benchmarks(text: Column) -> Column:
    """Sorted names found anywhere in the text; those that are models too only
    if something is evaluated on them, or they are called a benchmark."""
    low = F.lower(text_or_empty(text))
    used = lambda n: low.contains(n) & low.rlike(rf"evaluated?\s+on\s+.*{n}|{n}\s+benchmark")
    return _named([(n, used(n.lower()) if n in MODELS_TOO else low.contains(n.lower())) for n in LANGUAGE])


def vision_benchmarks(text: Column) -> Column:
    """Sorted names; CIFAR by its numbers, with or without the hyphen."""
    low = F.lower(text_or_empty(text))
    numbered = [(f"CIFAR-{k}", low.contains(f"cifar-{k}") | low.contains(f"cifar{k}")) for k in (10, 100)]
    return _named([(n, low.contains(n.lower())) for n in VISION if not n.startswith("CIFAR")] + numbered)


def control_benchmarks(text: Column) -> Column:
    low = F.lower(text_or_empty(text))
    return _named([(n, reduce(lambda a, b: a | b, [low.contains(w) for w in OTHER_NAMES.get(n, [n.lower()])])) for n in CONTROL])
