"""The life of alerts: raised, acknowledged, escalated, resolved.

A log has one row an action: (alert, at, seq, action, rule, severity, who);
``seq`` orders actions of one time. Actions:

* raise opens an alert that isn't open; while it is open it changes nothing,
* acknowledge takes an open alert over; later ones are told again,
* clear says that the alert's condition is gone: it resolves an alert that
  nobody has taken over, and no other,
* resolve closes an open alert.

An alert that nobody takes over escalates every ``delay`` seconds, ``most``
times at the most, and one of which nothing is heard for ``quiet`` seconds is
resolved by itself, which also bounds the state of the streaming form. An
action comes before what falls due at the same time. Actions on alerts that
aren't open are ignored.

``lifecycle`` is the batch form, windows over one shuffle by alert;
``lifecycle_stream`` the streaming one (transformWithState, event-time timers).
Both give rows (alert, at, event, reason, level, rule, severity), ``event``
being raised, acknowledged, escalated or resolved; on the same log, up to the
stream's watermark, they give the same rows. An empty log gives none; rows
without alert or time are left out; a null action does nothing but be heard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.streaming.ordered import Ordered, micros, moment, ready

DELAY, MOST, QUIET = 3600, 3, 86400
COLUMNS = ["alert", "at", "event", "reason", "level", "rule", "severity"]
_OUT = "alert {kind}, at timestamp, event string, reason string, level int, rule string, severity string"


def _us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def lifecycle(log: DataFrame, delay: int = DELAY, most: int = MOST, quiet: int = QUIET, until: Column | None = None) -> DataFrame:
    """Transitions up to ``until`` (default: the latest action of all)."""
    given = log.filter("alert is not null and at is not null").select("alert", _us("at").alias("us"), "seq", "action", "rule", "severity", "who")
    if until is None:
        last = given.agg(F.max("us")).first()[0]
        until = F.timestamp_micros(F.lit(last).cast("long"))
    stop = _us(until)
    given = given.filter(F.col("us") <= stop)
    w = Window.partitionBy("alert").orderBy("us", "seq")
    # a resolve, or too long a silence, ends whatever there was
    x = given.withColumn("_before", F.lag(F.struct("us", "action")).over(w))
    breaks = (F.col("_before.action").eqNullSafe("resolve") | (F.col("us") - F.col("_before.us") > quiet * 1_000_000)).cast("int")
    x = x.withColumns({"_part": F.sum(F.coalesce(breaks, F.lit(0))).over(w), "_next": F.lead("us").over(w)})
    p = Window.partitionBy("alert", "_part").orderBy("us", "seq")
    earlier = p.rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda a: F.col("action").eqNullSafe(a)
    x = x.withColumn("_sign", F.last(F.when(is_("raise") | is_("clear"), F.col("action")), ignorenulls=True).over(earlier))
    up = F.col("_sign").eqNullSafe("raise")  # raised, for all we know without acknowledgements
    x = x.withColumn("_taken", F.coalesce(F.max(is_("acknowledge") & up).over(earlier), F.lit(False)))
    x = x.withColumns({"_raises": is_("raise") & ~up & ~F.col("_taken"), "_clears": is_("clear") & up & ~F.col("_taken"), "_takes": is_("acknowledge") & (up | F.col("_taken")), "_ends": is_("resolve") & (up | F.col("_taken"))})
    x = x.withColumn("_of", F.last(F.when(F.col("_raises"), F.struct("rule", "severity")), ignorenulls=True).over(p.rowsBetween(Window.unboundedPreceding, 0)))
    # the silence that ends the last row of a part
    at_end = F.lead("us").over(p).isNull() & ~is_("resolve")
    open_ = F.col("_raises") | F.col("_taken") | F.col("_takes") | (up & ~F.col("_clears"))
    x = x.withColumn("_lapse", F.when(at_end & open_ & (F.col("_next").isNotNull() | (F.col("us") + quiet * 1_000_000 <= stop)), F.col("us") + quiet * 1_000_000))
    back = Window.partitionBy("alert", "_part").orderBy(F.desc("us"), F.desc("seq"))
    x = x.withColumn("_last", F.first(F.col("us")).over(back) + quiet * 1_000_000)
    left = F.last(F.when(F.col("_takes") | F.col("_clears") | F.col("_ends"), F.col("us")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_until", F.least(F.coalesce(left, F.col("_last")), stop + 1))
    step = delay * 1_000_000
    times = F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.col("_until") - 1 - F.col("us")) / step)))

    def one(when, us, event, reason, level=None):
        return F.when(when, F.struct(us.alias("us"), F.lit(event).alias("event"), reason.cast("string").alias("reason"), (F.lit(0) if level is None else level).cast("int").alias("level")))

    us, none = F.col("us"), F.lit(None)
    single = F.array_compact(F.array(one(F.col("_raises"), us, "raised", none), one(F.col("_takes"), us, "acknowledged", F.col("who")), one(F.col("_clears"), us, "resolved", F.lit("cleared")),
                                     one(F.col("_ends"), us, "resolved", F.coalesce("who", F.lit("manual"))), one(F.col("_lapse").isNotNull(), F.col("_lapse"), "resolved", F.lit("quiet"))))
    levels = F.when(F.col("_raises") & (times >= 1), F.sequence(F.lit(1).cast("long"), times.cast("long")))
    climbs = F.coalesce(F.transform(levels, lambda k: F.struct((us + k * step).alias("us"), F.lit("escalated").alias("event"), F.lit(None).cast("string").alias("reason"), k.cast("int").alias("level"))), F.array().cast("array<struct<us:bigint,event:string,reason:string,level:int>>"))
    out = x.select("alert", "_of", F.explode(F.concat(single, climbs)).alias("_e"))
    return out.select("alert", F.timestamp_micros("_e.us").alias("at"), "_e.event", "_e.reason", "_e.level", "_of.rule", "_of.severity")


class Lifecycle(Ordered):
    """The same, action by action. State: status, rule, severity, raised,
    heard (microseconds), level."""

    row = "action string, rule string, severity string, who string"
    state = "status string, rule string, severity string, raised long, heard long, level int"

    def __init__(self, delay: int, most: int, quiet: int):
        self.delay, self.most, self.quiet = delay * 1_000_000, most, quiet * 1_000_000

    def read(self, row):
        return micros(row["at"]), row["seq"], (row["action"], row["rule"], row["severity"], row["who"])

    def take(self, key, us, row, now):
        action, rule, severity, who = row
        if now is None:
            if action != "raise":
                return None, []
            return ("active", rule, severity, us, us, 0), [self._told(key, us, "raised", None, 0, rule, severity)]
        status, rule, severity, raised, _, level = now
        heard = (status, rule, severity, raised, us, level)
        if action == "acknowledge":
            return ("acknowledged", *heard[1:]), [self._told(key, us, "acknowledged", who, 0, rule, severity)]
        if action == "resolve":
            return None, [self._told(key, us, "resolved", who or "manual", 0, rule, severity)]
        if action == "clear" and status == "active":
            return None, [self._told(key, us, "resolved", "cleared", 0, rule, severity)]
        return heard, []

    def _climbs(self, now) -> int | None:
        status, _, _, raised, _, level = now
        return raised + (level + 1) * self.delay if status == "active" and level < self.most else None

    def due(self, now):
        climb, silent = self._climbs(now), now[4] + self.quiet
        return silent if climb is None else min(climb, silent)

    def lapse(self, key, us, now):
        status, rule, severity, raised, heard, level = now
        if us >= heard + self.quiet:
            return None, [self._told(key, us, "resolved", "quiet", 0, rule, severity)]
        return (status, rule, severity, raised, heard, level + 1), [self._told(key, us, "escalated", None, level + 1, rule, severity)]

    @staticmethod
    def _told(key, us, event, reason, level, rule, severity):
        return {"alert": key[0], "at": moment(us), "event": event, "reason": reason, "level": level, "rule": rule, "severity": severity}


def lifecycle_stream(log: DataFrame, late: str = "10 minutes", delay: int = DELAY, most: int = MOST, quiet: int = QUIET) -> DataFrame:
    """Transitions of a streaming log, in append mode."""
    ready(log.sparkSession)
    kind = log.schema["alert"].dataType.simpleString()
    rows = log.filter("alert is not null").withWatermark("at", late)
    return rows.groupBy("alert").transformWithState(Lifecycle(delay, most, quiet), _OUT.format(kind=kind), "append", "EventTime")


def standing(transitions: DataFrame) -> DataFrame:
    """One row an opening: when it was raised, last acknowledged and resolved,
    its highest level and its status."""
    w = Window.partitionBy("alert").orderBy("at", F.when(F.col("event") == "resolved", 0).when(F.col("event") == "raised", 1).otherwise(2))
    x = transitions.withColumn("_k", F.sum((F.col("event") == "raised").cast("int")).over(w))
    at = lambda e: F.max(F.when(F.col("event") == e, F.col("at")))
    out = x.groupBy("alert", "_k").agg(F.first("rule").alias("rule"), F.first("severity").alias("severity"), at("raised").alias("raised_at"), at("acknowledged").alias("acknowledged_at"), at("resolved").alias("resolved_at"), F.max("level").alias("level"))
    status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("active")
    return out.withColumn("status", status).drop("_k")


def alert_summary(alerts: DataFrame, since: Column | None = None, rules: int = 5) -> DataFrame:
    """One row over ``standing``'s rows (raised at ``since`` or later): counts
    by severity and status, mean minutes to resolution, the most frequent rules
    (by count, then name)."""
    x = alerts.filter(F.col("raised_at") >= since) if since is not None else alerts
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "error", "critical")] + [F.count_if(F.col("status") == s).alias(s) for s in ("active", "acknowledged", "resolved")]
    minutes = (_us("resolved_at") - _us("raised_at")) / 60e6
    totals = x.agg(F.count("*").alias("total"), *counts, F.coalesce(F.avg(minutes), F.lit(0.0)).alias("minutes_to_resolution"), F.count_if(F.col("level") > 0).alias("escalated"))
    top = x.groupBy("rule").count().orderBy(F.desc("count"), "rule").limit(rules)
    named = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "rule"))), lambda r: r["rule"]).alias("frequent_rules"))
    return totals.crossJoin(F.broadcast(named))  # one row by one row
