"""Sessions, checkpoints, a blob cache and notification sinks, over any file
system that Spark reaches, and a seeded generator of test papers."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "session string, stage string, status string, n bigint, checksum string, written timestamp, path string"


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free checksum of a DataFrame: sums of row hashes."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def save(df: DataFrame, root: str, session: str, stage: str, status: str = "running") -> None:
    """Write a stage's rows through Spark's committer, then its manifest row: a
    checkpoint exists once its manifest does."""
    spark, path = df.sparkSession, f"{root}/data/{session}/{stage}"
    df.write.mode("overwrite").parquet(path)
    n, total = checksum(spark.read.parquet(path))
    row = spark.range(1).select(F.lit(session).alias("session"), F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(n).cast("long").alias("n"), F.lit(total).alias("checksum"), F.current_timestamp().alias("written"), F.lit(path).alias("path"))
    row.coalesce(1).write.mode("append").json(f"{root}/manifest")


def sessions(spark: SparkSession, root: str, statuses: list[str] | None = None) -> DataFrame:
    """The latest manifest row of each session and stage."""
    from scholia.operators.windows import first_of
    rows = first_of(spark.read.schema(MANIFEST).json(f"{root}/manifest"), ["session", "stage"], [F.desc("written"), "checksum"])
    return rows.filter(F.col("status").isin(statuses)) if statuses else rows


def load(spark: SparkSession, root: str, session: str, stage: str) -> DataFrame:
    """A stage's rows; an error if they aren't those that were saved."""
    found = sessions(spark, root).filter((F.col("session") == session) & (F.col("stage") == stage)).first()
    if found is None:
        raise FileNotFoundError(f"no checkpoint of {session}/{stage}")
    df = spark.read.parquet(found["path"])
    if checksum(df) != (found["n"], found["checksum"]):
        raise ValueError(f"checkpoint of {session}/{stage} is damaged")
    return df


def clean(spark: SparkSession, root: str, statuses: list[str], dry_run: bool = True) -> list[str]:
    """Folders of sessions in these states; deleted unless it is a dry run."""
    paths = [r["path"] for r in sessions(spark, root, statuses).select("path").distinct().toLocalIterator()]
    if not dry_run:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            where = jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(conf).delete(where, True)
    return paths


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Cached files with the hash that identifies them; files of one content are
    one blob."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def blob_errors(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files missing from the cache, or with other content than the manifest says."""
    x = manifest.select("path", F.col("sha256").alias("want")).join(found.select("path", "sha256"), "path", "left")
    return x.select("path", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "damaged").alias("error")).filter("error is not null")


def notify(alerts: DataFrame, channels: dict[str, Callable[[list[str]], None]], checkpoint: str, chunk: int = 1000):
    """A stream's alerts to channels by severity, in micro-batches; a channel
    gets all of them as JSON lines, at most ``chunk`` a call."""
    def send(batch: DataFrame, _: int) -> None:
        for severity, channel in channels.items():
            rows = batch.filter(F.col("severity") == severity).select(F.to_json(F.struct("*"))).toLocalIterator()
            while lines := [r[0] for r in itertools.islice(rows, chunk)]:
                channel(lines)

    return alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def console(lines: list[str]) -> None:
    for line in lines:
        print(json.loads(line))


def mock_papers(spark: SparkSession, n: int, seed: int = 42, kind: str = "normal") -> DataFrame:
    """Repeatable papers by hashes of (row, seed). kind: normal (optional fields
    at 95 percent), edge_case (extreme values), corrupted (nulls and nonsense)."""
    h = lambda salt, m: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(m))
    rows = spark.range(n)
    title, year, cites = F.concat(F.lit("Paper "), F.col("id")), (2015 + h("y", 10)).cast("int"), h("c", 500)
    if kind == "edge_case":
        title, year, cites = F.when(h("t", 3) == 0, F.repeat(F.lit("long "), 200)).otherwise(F.lit("")), F.when(h("y", 2) == 0, 1950).otherwise(2100).cast("int"), F.when(h("c", 2) == 0, 0).otherwise(10_000_000).cast("long")
    if kind == "corrupted":
        title, year, cites = F.when(h("t", 2) == 0, title), F.when(h("y", 2) == 0, -1).cast("int"), F.when(h("c", 2) == 0, F.lit(-5).cast("long"))
    optional = lambda c, salt: F.when(h(salt, 100) < 95, c)
    return rows.select(F.format_string("mock_%06d", "id").alias("paper_id"), title.alias("title"), F.concat(F.lit("Venue "), h("v", 12)).alias("venue"), year.alias("year"), cites.alias("citations"),
                       optional(F.concat(F.lit("10.1234/"), F.col("id")), "d").alias("doi"), optional(F.lit("An abstract."), "a").alias("abstract"))
