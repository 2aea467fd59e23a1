"""Paper scans and sinks: JSON in its several shapes, CSV, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.schema import PAPER_DDL, paper_schema

#: Columns of the flat extraction file.
FLAT = ["paper_id", "title", "year", "domain", "gpu_type", "gpu_count", "training_hours", "parameters_millions", "estimated_gpu_hours", "confidence"]


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """``{"papers": [...]}`` files; a missing paper_id is venue_year_position."""
    files = spark.read.schema(f"papers array<struct<{_struct(PAPER_DDL)}>>").option("multiLine", True).json(path)
    rows = files.select(F.posexplode("papers").alias("_i", "p")).select("_i", "p.*")
    made = F.format_string("%s_%s_%04d", F.coalesce("venue", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.col("_i"))
    return rows.withColumn("paper_id", F.coalesce("paper_id", made)).withColumnRenamed("_i", "ordinal")


def _struct(ddl: str) -> str:
    return ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in paper_schema())


def read_any_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that are a list, {"papers": list}, {"data": list} or an
    object of objects, as ``record`` (variant); broken files are left out."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    tops = F.coalesce(F.try_variant_get("v", "$.papers", "array<variant>"), F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"),
                      F.map_values(F.try_variant_get("v", "$", "map<string,variant>")))
    return text.select(F.posexplode(tops).alias("ordinal", "record"))


def decode_legacy(rows: DataFrame) -> DataFrame:
    """From ``record`` variants: authors as strings or objects, one affiliation
    or several, citations as a number or records."""
    get = lambda p, t: F.try_variant_get("record", p, t)
    authors = F.coalesce(F.try_variant_get("record", "$.authors", "array<variant>"), F.array().cast("array<variant>"))
    name = lambda a: F.coalesce(F.try_variant_get(a, "$.name", "string"), F.try_variant_get(a, "$", "string"))
    affs = lambda a: F.coalesce(F.try_variant_get(a, "$.affiliations", "array<string>"), F.array_compact(F.array(F.try_variant_get(a, "$.affiliation", "string"))))
    return rows.select("ordinal", get("$.paper_id", "string").alias("paper_id"), F.coalesce(get("$.title", "string"), F.lit("")).alias("title"), F.coalesce(get("$.venue", "string"), F.lit("")).alias("venue"),
                       get("$.year", "int").alias("year"), F.coalesce(get("$.doi", "string"), F.lit("")).alias("doi"),
                       F.transform(authors, lambda a: F.struct(name(a).alias("name"), affs(a).alias("affiliations"), F.coalesce(F.try_variant_get(a, "$.email", "string"), F.lit("")).alias("email"))).alias("authors"),
                       F.coalesce(get("$.citations", "bigint"), F.array_max(F.transform(F.try_variant_get("record", "$.citations", "array<variant>"), lambda c: F.try_variant_get(c, "$.data.count", "bigint"))), F.lit(0)).alias("citations"))


def from_scraper(rows: DataFrame, source: str) -> DataFrame:
    """Flat scraper rows as papers with original provenance records."""
    def record(c, field):
        made = F.array(F.struct(F.lit(source).alias("source"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(True).alias("original"), F.struct(F.col(c).alias(field)).alias("data")))
        return F.when(F.col(c).isNotNull(), made).otherwise(F.slice(made, 1, 0))
    return rows.withColumns({"abstracts": record("abstract", "text"), "urls": record("pdf_url", "url"), "citations": record("citation_count", "count")}).drop("abstract", "pdf_url", "citation_count")


def write_papers(papers: DataFrame, path: str) -> None:
    """JSON lines, one paper each, beside a one-row envelope."""
    papers.write.mode("overwrite").json(f"{path}/papers")
    papers.agg(F.count("*").alias("total"), F.array_sort(F.collect_set("venue")).alias("venues"), F.array_sort(F.collect_set("year")).alias("years")).write.mode("overwrite").json(f"{path}/metadata")


def write_flat_csv(rows: DataFrame, path: str) -> None:
    cols = [F.substring(c, 1, 100).alias(c) if c == "title" else F.col(c) for c in FLAT if c in rows.columns]
    rows.select(*cols).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def years(spec: str) -> list[int]:
    """2020-2024, 2020,2022 or 2020."""
    out: list[int] = []
    for part in spec.split(","):
        a, dash, b = part.strip().partition("-")
        out += range(int(a), int(b) + 1) if dash else [int(a)]
    return sorted(set(out))


def merge_mappings(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """Several mapping tables; an earlier layer overrides later ones."""
    from functools import reduce

    from scholia.operators.windows import first_of
    rows = reduce(lambda a, b: a.unionByName(b), [d.select(key, value, F.lit(i).alias("_layer")) for i, d in enumerate(layers)])
    return first_of(rows, [key], ["_layer", value]).drop("_layer")
