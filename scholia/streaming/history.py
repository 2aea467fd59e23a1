"""Each venue's recent quality outcomes, with age-out.

Outcomes are rows (venue, at, seq, ok, score): ``ok`` whether the paper was
collected, ``seq`` orders outcomes of one time. After each outcome the venue's
record over the last ``hours`` is told: how many were evaluated, collected and
rejected, the share collected, the mean score (null scores count as no score),
and from ``least`` outcomes on the estimates of precision (that share) and
recall (1.2 times it, 1 at most).

``history`` is the batch form, by running sums; ``history_stream`` keeps
the outcomes of the last hours in map state and forgets a venue that has been
silent that long. Rows without venue or time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.streaming.ordered import Ordered, micros, moment, ready

HOURS, LEAST = 24, 10
_HOUR = 3_600_000_000
_OUT = "venue {kind}, at timestamp, seq long, evaluated long, collected long, rejected long, efficiency double, mean_score double, precision double, recall double"


def venue_key(venue: Column, year: Column) -> Column:
    """The venue, with the year behind it where there is one."""
    return F.concat_ws("_", venue, F.when(year != 0, year.cast("string")))


def history(outcomes: DataFrame, hours: int = HOURS, least: int = LEAST, together: bool = False) -> DataFrame:
    """With ``together``, outcomes of one time count for each other, whatever
    their ``seq``; otherwise each counts those up to its own, as the stream does.

    A span's sum is what has come in so far without what has aged out. Each
    time's sums come in at that time and, negated, ``hours`` later; a venue's
    running sums over both are taken within buckets of that length, on top of
    the sums of the buckets before. The work grows with the rows, however many
    a span holds, and one task holds one bucket of one venue."""
    size = hours * _HOUR
    x = outcomes.filter("venue is not null and at is not null").withColumn("_us", F.unix_micros(F.col("at").cast("timestamp")))
    x = x.withColumns({"_n": F.lit(1).cast("long"), "_c": F.coalesce(F.col("ok").cast("long"), F.lit(0)), "_s": F.coalesce(F.col("score").cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)")), "_k": F.col("score").isNotNull().cast("long")})
    sums = ["_n", "_c", "_s", "_k"]
    kept = {c: "decimal(38,6)" if c == "_s" else "long" for c in sums}

    def running(over, c: str) -> Column:
        return F.coalesce(F.sum(c).over(over), F.lit(0)).cast(kept[c])

    come = x.groupBy("venue", "_us").agg(*[F.sum(c).cast(kept[c]).alias(c) for c in sums])
    gone = come.select("venue", (F.col("_us") + size).alias("_us"), *[(-F.col(c)).cast(kept[c]).alias(c) for c in sums])
    moves = come.unionByName(gone).groupBy("venue", "_us").agg(*[F.sum(c).cast(kept[c]).alias(c) for c in sums]).withColumn("_b", F.floor(F.col("_us") / size))
    # buckets are few: one a venue and span of time
    earlier = Window.partitionBy("venue").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = moves.groupBy("venue", "_b").agg(*[F.sum(c).cast(kept[c]).alias(c) for c in sums]).select("venue", "_b", *[running(earlier, c).alias(f"{c}0") for c in sums])
    upto = Window.partitionBy("venue", "_b").orderBy("_us").rowsBetween(Window.unboundedPreceding, 0)
    span = moves.select("venue", "_b", "_us", *[running(upto, c).alias(c) for c in sums]).join(base, ["venue", "_b"]).select("venue", "_us", *[(F.col(c) + F.col(f"{c}0")).cast(kept[c]).alias(f"{c}1") for c in sums])
    if together:
        x = x.select("venue", "at", "seq", "_us").join(span, ["venue", "_us"])
        n, c, s, k = (F.col(f"{v}1") for v in sums)
    else:  # without those of the same time that come later
        later = Window.partitionBy("venue", "_us").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
        x = x.select("venue", "at", "seq", "_us", *[running(later, c).alias(f"{c}2") for c in sums]).join(span, ["venue", "_us"])
        n, c, s, k = (F.col(f"{v}1") - F.col(f"{v}2") for v in sums)
    x = x.withColumns({"evaluated": n, "collected": c, "_s": s, "_k": k})
    share = F.col("collected") / F.col("evaluated")
    enough = F.col("evaluated") >= least
    return x.select("venue", "at", "seq", "evaluated", "collected", (F.col("evaluated") - F.col("collected")).alias("rejected"), share.alias("efficiency"), F.try_divide(F.col("_s").cast("double"), F.col("_k")).alias("mean_score"),
                    F.when(enough, share).alias("precision"), F.when(enough, F.least(F.lit(1.0), share * 1.2)).alias("recall"))


class History(Ordered):
    """State: the time of the last outcome; beside it the outcomes in a map."""

    row = "ok boolean, millionths long"
    state = "last long"

    def __init__(self, hours: int, least: int):
        self.span, self.least = hours * _HOUR, least

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("kept", "us long, tie long", self.row)

    def read(self, row):
        score = row["score"]
        return micros(row["at"]), row["seq"], (bool(row["ok"]), None if score is None else round(score * 1_000_000))

    def begin(self, key):
        self.mine = sorted((tuple(k), tuple(v)) for k, v in self.kept.iterator()) if self.kept.exists() else []
        self.n, self.oks = len(self.mine), sum(v[0] for _, v in self.mine)
        self.total, self.scored = sum(v[1] or 0 for _, v in self.mine), sum(v[1] is not None for _, v in self.mine)
        self.at = 0

    def _forget(self, upto: int) -> None:
        while self.at < len(self.mine) and self.mine[self.at][0][0] <= upto:
            k, (ok, score) = self.mine[self.at]
            self.kept.removeKey(k)
            self.n, self.oks, self.total, self.scored, self.at = self.n - 1, self.oks - ok, self.total - (score or 0), self.scored - (score is not None), self.at + 1

    def take(self, key, us, row, now):
        self._forget(us - self.span)
        ok, score = row
        tie = self.tie
        self.kept.updateValue((us, tie), row)
        self.mine.append(((us, tie), row))
        self.n, self.oks, self.total, self.scored = self.n + 1, self.oks + ok, self.total + (score or 0), self.scored + (score is not None)
        share = self.oks / self.n
        enough = self.n >= self.least
        return (us,), [{"venue": key[0], "at": moment(us), "seq": tie, "evaluated": self.n, "collected": self.oks, "rejected": self.n - self.oks, "efficiency": share,
                        "mean_score": self.total / 1e6 / self.scored if self.scored else None, "precision": share if enough else None, "recall": min(1.0, share * 1.2) if enough else None}]

    def due(self, now):
        return now[0] + self.span

    def lapse(self, key, us, now):
        self._forget(us)
        return None, []


def history_stream(outcomes: DataFrame, late: str = "10 minutes", hours: int = HOURS, least: int = LEAST) -> DataFrame:
    ready(outcomes.sparkSession)
    kind = outcomes.schema["venue"].dataType.simpleString()
    rows = outcomes.filter("venue is not null").withWatermark("at", late)
    return rows.groupBy("venue").transformWithState(History(hours, least), _OUT.format(kind=kind), "append", "EventTime")
