"""Stateful streams against their batch forms, and those against plain folds."""

import collections
import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholia.operators.joins import merge_sources
from scholia.sources import paged
from scholia.streaming import history, lifecycle, merge, suppression

T0 = dt.datetime(2024, 1, 1)
LOG = "alert long, at timestamp, seq long, action string, rule string, severity string, who string"


def after(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run_all(stream, name, checkpoint, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def files(spark, rows, schema, path, per):
    """``rows`` as files of ``per`` rows, to be read one a batch, in order."""
    import os
    import time
    for i in range(0, len(rows), per):
        spark.createDataFrame(rows[i:i + per], schema).coalesce(1).write.mode("append").json(str(path))
    found = sorted((p for p in path.iterdir() if p.suffix == ".json"), key=lambda p: p.stat().st_mtime_ns)
    for i, p in enumerate(found):
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    time.sleep(0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


# ---------------------------------------------------------------- alerts


def fold(log, delay, most, quiet, until):
    """The rules, one alert after the other, second by second where it matters."""
    out = []
    by = collections.defaultdict(list)
    for alert, at, seq, action, rule, severity, who in log:
        if alert is not None and at is not None and at <= until:
            by[alert].append((at, seq, action, rule, severity, who))
    sec = lambda n: dt.timedelta(seconds=n)
    for alert, rows in by.items():
        now = None
        for at, _, action, rule, severity, who in [*sorted(rows, key=lambda r: r[:2]), (None,) * 6]:
            while now:
                climb = now["raised"] + sec(delay) * (now["level"] + 1) if now["status"] == "active" and now["level"] < most else None
                end = now["heard"] + sec(quiet)
                due = end if climb is None or end <= climb else climb
                if due > until or (at is not None and due >= at):
                    break
                if due == end:
                    out.append((alert, due, "resolved", "quiet", 0, now["rule"], now["severity"]))
                    now = None
                else:
                    now["level"] += 1
                    out.append((alert, due, "escalated", None, now["level"], now["rule"], now["severity"]))
            if at is None:
                break
            if now is None:
                if action == "raise":
                    now = {"rule": rule, "severity": severity, "raised": at, "heard": at, "status": "active", "level": 0}
                    out.append((alert, at, "raised", None, 0, rule, severity))
                continue
            now["heard"] = at
            told = lambda e, r: out.append((alert, at, e, r, 0, now["rule"], now["severity"]))
            if action == "acknowledge":
                now["status"] = "acknowledged"
                told("acknowledged", who)
            elif action == "resolve":
                told("resolved", who or "manual")
                now = None
            elif action == "clear" and now["status"] == "active":
                told("resolved", "cleared")
                now = None
    return sorted(out, key=str)


def made_log(n=600, seed=1):
    rnd = random.Random(seed)
    odds = ["raise"] * 4 + ["acknowledge"] * 3 + ["clear"] * 2 + ["resolve"] * 2 + ["noise", None]
    log = [(rnd.randrange(12), after(rnd.randrange(0, 4000) * 5), i, rnd.choice(odds), f"rule{rnd.randrange(3)}", rnd.choice(["warning", "critical"]), rnd.choice([None, "ann"])) for i in range(n)]
    return [*log, (None, after(1), 1, "raise", "r", "info", None), (3, None, 2, "raise", "r", "info", None)]


@pytest.mark.parametrize("delay,most,quiet", [(40, 3, 300), (60, 2, 60), (25, 9, 90)])
def test_lifecycle(spark, delay, most, quiet):
    log = made_log()
    got = lifecycle.lifecycle(spark.createDataFrame(log, LOG), delay, most, quiet, F.lit(after(18_000)))
    assert sorted((tuple(r) for r in got.select(*lifecycle.COLUMNS).collect()), key=str) == fold(log, delay, most, quiet, after(18_000))


def test_lifecycle_stream(spark, tmp_path):
    log = [r for r in made_log(300, 5) if r[1] is not None]
    rnd = random.Random(2)
    log.sort(key=lambda r: r[1] + dt.timedelta(seconds=rnd.randrange(0, 500)))  # out of order, within the delay
    log.append((77, after(60_000), 9999, "noise", "r", "info", None))  # drives the watermark on
    stream = files(spark, log, LOG, tmp_path / "in", 60)
    told = run_all(lifecycle.lifecycle_stream(stream, "600 seconds", 40, 3, 300), "lived", tmp_path / "ck")
    got = sorted((tuple(r) for r in told.select(*lifecycle.COLUMNS).collect()), key=str)
    assert got == fold(log, 40, 3, 300, after(59_400)) and len(got) > 100


def test_lifecycle_stream_drops_the_late(spark, tmp_path):
    rows = [(1, after(0), 1, "raise", "r", "error", None), *[(2, after(5000 + i), 2 + i, "noise", "r", "error", None) for i in range(3)], (1, after(10), 9, "acknowledge", "r", "error", "late"), (2, after(20_000), 10, "noise", "r", "error", None)]
    stream = files(spark, rows, LOG, tmp_path / "in", 1)
    told = run_all(lifecycle.lifecycle_stream(stream, "60 seconds", 3600, 1, 9000), "late", tmp_path / "ck").collect()
    assert [(r["event"], r["reason"]) for r in sorted(told, key=lambda r: r["at"])] == [("raised", None), ("escalated", None), ("resolved", "quiet")]


def test_alert_summary(spark):
    log = [(1, after(0), 1, "raise", "a", "warning", None), (1, after(60), 2, "acknowledge", "a", None, "ann"), (1, after(90), 3, "acknowledge", "a", None, "bob"), (1, after(120), 4, "resolve", "a", None, None),
           (1, after(200), 5, "raise", "b", "error", None), (2, after(0), 6, "raise", "a", "critical", None), (3, after(10), 7, "raise", "b", "info", None), (3, after(20), 8, "clear", "b", None, None)]
    stood = lifecycle.standing(lifecycle.lifecycle(spark.createDataFrame(log, LOG), 100, 3, 10_000))
    rows = {(r["alert"], r["raised_at"]): r for r in stood.collect()}
    assert rows[1, after(0)]["acknowledged_at"] == after(90) and rows[1, after(0)]["status"] == "resolved" and rows[1, after(200)]["status"] == "active"
    assert rows[2, after(0)]["level"] == 2 and rows[1, after(0)]["level"] == 0
    s = lifecycle.alert_summary(stood).first()
    assert (s["total"], s["warning"], s["error"], s["critical"], s["info"], s["active"], s["resolved"], s["escalated"]) == (4, 1, 1, 1, 1, 2, 2, 1)
    assert s["frequent_rules"] == ["a", "b"] and abs(s["minutes_to_resolution"] - (120 + 10) / 2 / 60) < 1e-9
    empty = lifecycle.alert_summary(lifecycle.standing(lifecycle.lifecycle(spark.createDataFrame([], LOG)))).first()
    assert empty["total"] == 0 and not empty["frequent_rules"] and empty["minutes_to_resolution"] == 0


# ---------------------------------------------------------------- merging


MERGE = "hash string, part int, ord string, title string, year int, cites array<long>, urls array<string>"


def source_rows(seed=3):
    rnd = random.Random(seed)
    out = []
    for h in range(20):
        for part in range(3):
            for k in range(rnd.randrange(0, 3)):
                maybe = lambda v: v if rnd.random() < 0.6 else None
                out.append((f"h{h}", part, f"o{k}", maybe(f"t{part}{k}"), maybe(2000 + part), maybe([part * 10 + k]), maybe([f"u{part}{k}", "u"])))
    return [*out, (None, 0, "x", "t", 1, None, None), ("alone", 2, "x", None, None, None, None)]


@pytest.mark.parametrize("seed,per", [(1, 7), (2, 200)])
def test_incremental_merge(spark, tmp_path, seed, per):
    rows = source_rows()
    parts = [spark.createDataFrame([r for r in rows if r[0] and r[1] == p], MERGE).drop("part") for p in range(3)]
    key = lambda r: (r["hash"], r["title"], r["year"], sorted(r["cites"]), sorted(r["urls"]))
    want = sorted((key(r) for r in merge_sources(parts, "hash", ["title", "year"], ["cites", "urls"], "ord").collect()), key=str)
    order = rows + rows[:20]  # some come twice
    random.Random(seed).shuffle(order)
    half = len(order) // 2
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (order[:half], order[half:]):  # the second run starts from the checkpoint
        stream = files(spark, part, MERGE, tmp_path / "in", per)
        merge.append_batches(merge.merge_stream(stream, "hash", ["title", "year"], ["cites", "urls"], "ord"), out, ck).awaitTermination()
    told = spark.read.parquet(out).drop("batch")
    assert sorted((key(r) for r in merge.latest(told, "hash").collect()), key=str) == want
    versions = told.groupBy("hash").agg(F.count("*").alias("n"), F.max("version").alias("v"), F.countDistinct("version").alias("d")).collect()
    assert all(r["n"] == r["v"] == r["d"] for r in versions)  # only changes, each once


# ---------------------------------------------------------------- pages


def save_pages(path, sizes, start=0):
    path.mkdir(exist_ok=True)
    n = start
    for i, k in enumerate(sizes):
        number = len(list(path.iterdir()))
        (path / f"page-{number:05}.json").write_text(json.dumps([{"id": n + j} for j in range(k)] if i % 2 else {"data": [{"id": n + j} for j in range(k)]}))
        n += k
    return n


def ids(df):
    return sorted(json.loads(r["record"])["id"] for r in df.collect())


def test_pages_are_pulled_once(spark, tmp_path):
    pages = tmp_path / "pages"
    n = save_pages(pages, [5, 5])
    out = str(tmp_path / "out")

    def pull():
        """Starts anew from the checkpoint; what has been written in all."""
        merge.append_batches(paged.pulled(spark, str(pages), 5), out, str(tmp_path / "ck"), "append").awaitTermination()
        return ids(spark.read.parquet(out))

    assert pull() == list(range(10))
    n = save_pages(pages, [5, 3, 5], n)  # the short page ends it
    assert pull() == list(range(18)) == pull()
    assert ids(paged.pulled(spark, str(pages), 5, stream=False)) == list(range(18))


@pytest.mark.parametrize("limit,want", [(0, 0), (1, 1), (5, 5), (7, 7), (100, 13)])
def test_pull_keeps_its_limit(spark, tmp_path, limit, want):
    save_pages(tmp_path / "pages", [5, 5, 3])
    assert ids(paged.pulled(spark, str(tmp_path / "pages"), 5, limit, stream=False)) == list(range(want))
    assert ids(run_all(paged.pulled(spark, str(tmp_path / "pages"), 5, limit), f"limit{limit}", tmp_path / "ck")) == list(range(want))


def test_pull_from_nothing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert ids(run_all(paged.pulled(spark, str(tmp_path / "none")), "nothing", tmp_path / "ck")) == []
    (tmp_path / "none" / "0.json").write_text("broken [")
    (tmp_path / "none" / "1.json").write_text('[{"id": 1}]')
    assert ids(paged.pulled(spark, str(tmp_path / "none"), stream=False)) == []  # the unreadable page ends it


# ---------------------------------------------------------------- history


OUTCOMES = "venue string, at timestamp, seq long, ok boolean, score double"


def made_outcomes(n=400):
    rnd = random.Random(4)
    rows = [(f"v{rnd.randrange(3)}", after(rnd.randrange(0, 200) * 900), i, rnd.choice([True, False, True, None]), rnd.choice([None, round(rnd.random(), 2)])) for i in range(n)]
    return rows + [(None, after(5), 1, True, 0.5)]


def plain_history(rows, hours):
    out = []
    for v, at, seq, *_ in rows:
        if v is None:
            continue
        mine = [r for r in rows if r[0] == v and at - dt.timedelta(hours=hours) < r[1] and (r[1], r[2]) <= (at, seq)]
        n, oks, scores = len(mine), sum(bool(r[3]) for r in mine), [r[4] for r in mine if r[4] is not None]
        rate = oks / n
        enough = n >= 10
        out.append((v, at, seq, n, oks, n - oks, round(rate, 9), round(sum(scores) / len(scores), 9) if scores else None, round(rate, 9) if enough else None, round(min(1.0, rate * 1.2), 9) if enough else None))
    return sorted(out, key=str)


def history_rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_history(spark):
    rows = made_outcomes()
    assert history_rows(history.history(spark.createDataFrame(rows, OUTCOMES), 6)) == plain_history(rows, 6)


def test_history_in_one_span(spark):
    """20,000 outcomes of one venue within a span: sums run, no frame is summed anew for each row."""
    n = 20_000
    rows = spark.range(n).selectExpr("'v' as venue", "timestamp_micros(1704067200000000 + (id div 2) * 1000) as at", "id as seq", "id % 4 = 0 as ok", "case when id % 5 > 0 then 0.5 end as score")
    told = history.history(rows)
    assert "RangeFrame" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert told.agg(F.count_if(F.col("evaluated") == F.col("seq") + 1), F.count_if(F.col("collected") == F.floor(F.col("seq") / 4) + 1), F.count_if(F.col("mean_score") == 0.5)).first() == (n, n, n - 1)


def test_history_stream(spark, tmp_path):
    rows = made_outcomes(200)
    rnd = random.Random(6)
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rnd.randrange(0, 900)))
    ends = [("end", after(900_000), 10**6, True, None)]
    stream = files(spark, rows + ends, OUTCOMES, tmp_path / "in", 40)
    got = run_all(history.history_stream(stream, "1000 seconds", 6), "told", tmp_path / "ck")
    assert history_rows(got) == plain_history(rows, 6)


def test_venue_key(spark):
    rows = spark.createDataFrame([("a", 2020), ("a", None), ("a", 0)], "v string, y int")
    assert [r[0] for r in rows.select(history.venue_key(F.col("v"), F.col("y"))).collect()] == ["a_2020", "a", "a"]


# ---------------------------------------------------------------- suppression


def plain_held(alerts, controls):
    import re
    out = {}
    for ident, rule, severity, at in alerts:
        hits = []
        for kind, pattern, lo, hi in controls:
            if at is None or not lo <= at < hi:
                continue
            if kind == "global" or kind in ("maintenance", "emergency") and (severity or "").lower() != "critical":
                hits.append((["global", "maintenance", "emergency"].index(kind), kind))
            elif kind == "rule" and pattern and rule and re.search(pattern, rule, re.I):
                hits.append((3, pattern))
        out[ident] = min(hits)[1] if hits else None
    return out


def test_held_back(spark, tmp_path):
    rnd = random.Random(8)
    rules = ["Disk full", "Memory high", "cpu", "disk slow", None]
    alerts = [(i, rnd.choice(rules), rnd.choice(["info", "critical", "CRITICAL", None]), after(rnd.randrange(0, 50_000))) for i in range(800)] + [(9000, "cpu", "info", None)]
    controls = [("rule", "^disk", after(0), after(9000)), ("rule", "disk", after(4000), after(7300)), ("rule", "MEM", after(100), after(101)), ("maintenance", None, after(10_000), after(15_000)), ("maintenance", None, after(12_000), after(22_000)),
                ("emergency", None, after(14_000), after(30_000)), ("global", None, after(28_000), after(28_900)), ("global", None, after(5), after(5)), ("rule", None, after(0), after(50_000))]
    a = spark.createDataFrame(alerts, "id long, rule string, severity string, at timestamp")
    c = spark.createDataFrame(controls, "kind string, pattern string, starts timestamp, ends timestamp")
    got = suppression.held_back(a, c, a, bucket=3600)
    want = plain_held(alerts, controls)
    assert {r["id"]: r["held_by"] for r in got.collect()} == want and got.count() == len(alerts)
    assert {r["held_by"]: r["n"] for r in suppression.tally(got).collect()} == {k: v for k, v in collections.Counter(want.values()).items() if k}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.split("held_by")[0] or "Cartesian" not in plan
    stream = files(spark, alerts, a.schema, tmp_path / "in", 300)
    seen = run_all(suppression.held_back(stream, c, spark.createDataFrame([(r,) for r in rules], "rule string")), "held", tmp_path / "ck")
    assert {r["id"]: r["held_by"] for r in seen.collect()} == want
