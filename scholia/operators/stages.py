"""Extension points: extractors with fallbacks, a registry of stage checks and
their runner, and declarative forms. All of them only put Columns and DataFrames
together; the work is one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Extractors:
    """Named extractors (Column of text -> Column of a value), each with a level
    and a test of its value; the first level whose value passes wins."""

    def __init__(self):
        self.known: list[tuple[int, str, Callable[[Column], Column], Callable[[Column], Column]]] = []

    def register(self, name: str, extract: Callable[[Column], Column], level: int = 0, accept: Callable[[Column], Column] | None = None) -> None:
        if any(name == n for _, n, _, _ in self.known):
            raise ValueError(f"extractor {name} is registered already")
        self.known.append((level, name, extract, accept or (lambda v: v.isNotNull())))
        self.known.sort(key=lambda x: x[0])

    def apply(self, text: Column) -> Column:
        """struct<value, by>: null where no extractor is accepted."""
        if not self.known:
            raise ValueError("no extractor is registered")
        arms = [F.when(accept(extract(text)), F.struct(extract(text).alias("value"), F.lit(name).alias("by"))) for _, name, extract, accept in self.known]
        return F.coalesce(*arms)


class Checks:
    """Checks of a stage: DataFrame -> one row (score, detail). ``run`` makes a
    row per check of the stage, and one for all of them by weight."""

    def __init__(self):
        self.known: dict[str, dict[str, tuple[Callable[[DataFrame], DataFrame], float, float]]] = {}

    def register(self, stage: str, name: str, check: Callable[[DataFrame], DataFrame], weight: float = 1.0, least: float = 0.0) -> None:
        if name in self.known.setdefault(stage, {}):
            raise ValueError(f"check {name} of {stage} is registered already")
        self.known[stage][name] = (check, weight, least)

    def stages(self) -> list[str]:
        return sorted(self.known)

    def run(self, stage: str, rows: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
        chosen = {n: c for n, c in self.known.get(stage, {}).items() if n not in skip}
        if not chosen:
            raise ValueError(f"no check of stage {stage}")
        parts = [check(rows).select(F.lit(name).alias("check"), F.col("score").cast("double").alias("score"), F.lit(weight).alias("weight"), F.lit(least).alias("least")) for name, (check, weight, least) in chosen.items()]
        each = reduce(DataFrame.unionByName, parts)
        whole = each.agg(F.lit("overall").alias("check"), (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.sum("weight").alias("weight"), F.avg("least").alias("least"))
        return each.unionByName(whole).withColumn("passed", F.col("score") >= F.col("least"))


def form_errors(fields: dict[str, dict]) -> Column:
    """Errors of one filled form, as an array of "field: error". A field's rule
    may say required, kind ("int", "double", "date"), least, most, options,
    pattern, and needs (a field that must be filled too)."""
    errors = []
    for name, rule in fields.items():
        value = F.col(name)
        text = F.trim(value.cast("string"))
        filled = F.coalesce(text != "", F.lit(False))
        say = lambda test, what, n=name: errors.append(F.when(F.coalesce(test, F.lit(False)), F.lit(f"{n}: {what}")))
        if rule.get("required"):
            say(~filled, "missing")
        if "kind" in rule:
            say(filled & text.try_cast(rule["kind"]).isNull(), f"not a valid {rule['kind']}")
        number = text.try_cast("double")
        if "least" in rule:
            say(number < rule["least"], f"below {rule['least']}")
        if "most" in rule:
            say(number > rule["most"], f"above {rule['most']}")
        if "options" in rule:
            say(filled & ~text.isin(*rule["options"]), "not an option")
        if "pattern" in rule:
            say(filled & ~text.rlike(rule["pattern"]), "of another form")
        if "needs" in rule:
            other = F.trim(F.col(rule["needs"]).cast("string"))
            say(filled & ~F.coalesce(other != "", F.lit(False)), f"needs {rule['needs']}")
    return F.array_compact(F.array(*errors))


def phase(done: dict[str, Column]) -> Column:
    """The first phase, in order, whose condition doesn't hold yet; "complete"."""
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in done.items()], F.lit("complete"))


def detected(spark: SparkSession, path: str) -> list[str]:
    """The stages that a data layout allows. A folder with "collected_papers"
    and a JSON file that holds a list, or an object with "papers" or
    "collection_metadata", allow "collection"; anything else, unreadable and
    missing files too, allows none. Any file system that Spark knows; only the
    head of a file and its field names are looked at."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    if system.getFileStatus(where).isDirectory():
        return ["collection"] if system.exists(jvm.org.apache.hadoop.fs.Path(where, "collected_papers")) else []
    if not path.endswith(".json"):
        return []
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if "_corrupt_record" in rows.columns:
        return []
    begins = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    is_list = begins is not None and begins["c"] == "["
    return ["collection"] if is_list or {"papers", "collection_metadata"} & set(rows.columns) else []


def run_detected(spark: SparkSession, path: str, checks: Checks, rows: DataFrame) -> DataFrame | None:
    """The checks of each detected stage that has any, with its name."""
    parts = [checks.run(stage, rows).withColumn("stage", F.lit(stage)) for stage in detected(spark, path) if stage in checks.stages()]
    return reduce(DataFrame.unionByName, parts) if parts else None


# Where to look next for an extraction: step, then the step after yes, no, and without an answer.
DECISIONS = {
    "start": ("extract_abstract", "check_experimental_section", None),
    "extract_abstract": ("verify_main_text", "check_experimental_section", None),
    "verify_main_text": ("extract_main_text", "flag_inconsistency", None),
    "check_experimental_section": ("extract_experimental", "check_appendix", None),
    "extract_experimental": ("proceed_validation", "check_appendix", None),
    "check_appendix": ("extract_appendix", "check_github", None),
    "extract_appendix": ("proceed_validation", "check_github", None),
    "check_github": ("extract_github", "limited_extraction", None),
    "extract_github": ("proceed_validation", "limited_extraction", None),
    "limited_extraction": (None, None, "proceed_validation"),
    "flag_inconsistency": (None, None, "check_experimental_section"),
}
LAST_STEP = "proceed_validation"


def extraction_path(answers: Column) -> Column:
    """The steps from "start" to "proceed_validation" that a map of answers
    (step to yes, y, no or n, whatever the case) leads through. Where the tree
    says nothing for an answer, or an answer is missing, the next step is the
    last. The tree has no circle, so a path is no longer than it."""
    def arm(i: int) -> Column:
        return F.create_map(*[F.lit(x) for step, to in DECISIONS.items() if to[i] for x in (step, to[i])])

    yes, no, other = arm(0), arm(1), arm(2)

    def step(path: Column, _: Column) -> Column:
        now = F.element_at(path, -1)
        answer = F.lower(answers[now])
        to = F.when(answer.isin("yes", "y"), yes[now]).when(answer.isin("no", "n"), no[now]).otherwise(other[now])
        return F.when(now == LAST_STEP, path).otherwise(F.concat(path, F.array(F.coalesce(to, F.lit(LAST_STEP)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(DECISIONS) + 1)), F.array(F.lit("start")), step)
