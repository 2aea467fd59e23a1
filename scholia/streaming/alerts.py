"""Alerts, rates and health over event time. Each operator takes a batch or a
streaming DataFrame; streams need a watermark, which bounds their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.streaming.ordered import Ordered, micros, moment, ready

# The built-in alert rules: name, condition, severity.
RULES = [("low_rate", "papers_per_minute < 10", "warning"), ("high_memory", "memory_percent > 80", "warning"), ("memory_critical", "memory_percent > 95", "critical"),
         ("high_cpu", "cpu_percent > 90", "warning"), ("error_rate", "errors > 0.1 * (processed + errors)", "error")]
ALLOWED = {"papers_per_minute", "memory_percent", "cpu_percent", "errors", "processed"}


def rule(expression: str, allowed: set[str] = ALLOWED) -> Column:
    """A rule's text as a Column over known columns alone; never evaluated by Python."""
    import re
    names = set(re.findall(r"[A-Za-z_]\w*", expression)) - {"and", "or", "not", "AND", "OR", "NOT"}
    if names - allowed:
        raise ValueError(f"unknown columns in rule: {sorted(names - allowed)}")
    return F.expr(expression)


def evaluate(metrics: DataFrame, rules=RULES) -> DataFrame:
    """A row for each metric row and rule that holds."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(rule(e), F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, e, s in rules]))
    return metrics.select("*", F.explode(hits).alias("_h")).select("*", "_h.*").drop("_h")


def rates(events: DataFrame, ts: str, by: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and value means per window and key; later events than ``late`` are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    base = events.withWatermark(ts, late) if events.isStreaming else events
    return base.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "mean")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    base = events.withWatermark(ts, late) if events.isStreaming else events
    return base.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def deduplicated(alerts: DataFrame, ts: str, keys: list[str], within: str = "300 seconds") -> DataFrame:
    """One alert per key within the time."""
    return alerts.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def cooled_down(alerts: DataFrame, by: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """The alerts that fire when each fired one silences its key for ``seconds``
    (batch form; see ``greedy.spaced``)."""
    from scholia.operators.greedy import spaced
    return spaced(alerts, by, ts, tie, seconds)


class Silenced(Ordered):
    """A key's state is the time of its last firing; it ends with the silence."""

    row = "seen boolean"
    state = "fired long"

    def __init__(self, ts: str, seconds: int):
        self.ts, self.span = ts, seconds * 1_000_000

    def read(self, row):
        return micros(row[self.ts]), 0, (True,)  # rows of one time are one firing at most

    def take(self, key, us, row, now):
        if now is not None and us < now[0] + self.span:
            return now, []
        return (us,), [{"key": key[0], "fired_at": moment(us)}]

    def due(self, now):
        return now[0] + self.span

    def lapse(self, key, us, now):
        return None, []


def cooled_down_stream(alerts: DataFrame, by: str, ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, fired_at): the streaming form of ``cooled_down``, in event-time
    order whatever order the rows come in; rows later than ``late`` are dropped,
    and a key that isn't silenced has no state."""
    ready(alerts.sparkSession)
    rows = alerts.filter(F.col(ts).isNotNull()).withColumn(by, F.col(by).cast("string")).withWatermark(ts, late)
    return rows.groupBy(by).transformWithState(Silenced(ts, seconds), "key string, fired_at timestamp", "append", "EventTime")


def health(requests: DataFrame, by: str, ts: str, tie: str, ok: Column, recent: int = 50) -> DataFrame:
    """The state after each request: offline from 10 trailing errors, critical
    from 5, degraded from 3 or by the success rate of the last ``recent``."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    x = requests.withColumn("_ok", F.coalesce(ok, F.lit(False)).cast("int"))
    x = x.withColumn("_n", F.row_number().over(w)).withColumn("_last_ok", F.max(F.when(F.col("_ok") == 1, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    errors = F.col("_n") - F.coalesce("_last_ok", F.lit(0))
    rate = F.avg("_ok").over(w.rowsBetween(-(recent - 1), 0))
    x = x.withColumns({"trailing_errors": errors, "success_rate": rate})
    state = F.when(F.col("trailing_errors") >= 10, "offline").when((F.col("trailing_errors") >= 5) | (F.col("success_rate") < 0.5), "critical").when((F.col("trailing_errors") >= 3) | (F.col("success_rate") < 0.8), "degraded").otherwise("healthy")
    return x.withColumn("health", state).drop("_n", "_ok", "_last_ok")


def suppressed(alerts: DataFrame, by: str, ts: str, tie: str, burst: int = 5, seconds: int = 60) -> DataFrame:
    """``suppress`` when more than ``burst`` alerts of the key, this one counted,
    lie within ``seconds``."""
    w = Window.partitionBy(by).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return alerts.withColumn("recent", F.count("*").over(w)).withColumn("suppress", F.col("recent") > burst)


def effectiveness(alerts: DataFrame, by: str) -> DataFrame:
    n = alerts.groupBy(by).agg(F.count("*").alias("evaluated"), F.count_if("suppress").alias("suppressed"))
    return n.withColumn("rate", F.col("suppressed") / F.col("evaluated"))


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(path)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, and give the result as a table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def eta_hours(done: Column, total: Column, rate_per_minute: Column, each: int = 50) -> Column:
    return F.coalesce(F.try_divide((total - done) * each, rate_per_minute * 60), F.lit(None).cast("double"))


# How health stretches a wait, and what large requests add.
HEALTH_FACTORS = {"healthy": 1.0, "degraded": 2.0, "critical": 5.0, "offline": 10.0}
SIZE_DIVISOR, SIZE_MOST = 10.0, 3.0


def request_waits(requests: DataFrame, by: str, ts: str, tie: str, ok: Column, per_window: int = 100, window: int = 300, base: float = 1.0, cap: float = 60.0, size: Column | None = None) -> DataFrame:
    """How long the next request should wait: until the rolling window has a
    slot, longer the worse the health, or base * 2^failures in a row, ``cap`` at
    most; a request of more than one item times a tenth of its ``size``, 3 at
    most; ``cap`` at most again. Everything comes from the rows before, so it is
    one window per key."""
    x = health(requests, by, ts, tie, ok)
    t = F.col(ts).cast("timestamp").cast("double")
    frame = Window.partitionBy(by).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-window, 0)
    x = x.withColumns({"in_window": F.count("*").over(frame), "_oldest": F.min(t).over(frame)})
    slot = F.when(F.col("in_window") >= per_window, F.col("_oldest") + window - t).otherwise(0.0)
    factor = F.coalesce(*[F.when(F.col("health") == k, v) for k, v in HEALTH_FACTORS.items()])
    back = F.when(F.col("trailing_errors") > 0, F.least(F.lit(cap), base * F.pow(F.lit(2.0), F.least(F.col("trailing_errors"), F.lit(16))))).otherwise(0.0)
    large = F.lit(1.0) if size is None else F.when(size > 1, F.least(size / SIZE_DIVISOR, F.lit(SIZE_MOST))).otherwise(1.0)
    return x.withColumn("wait", F.least(F.lit(cap), F.greatest(slot * factor, back) * large)).drop("_oldest")
