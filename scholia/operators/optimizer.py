"""Quality thresholds moved by gradients of precision, recall, f1 and
efficiency, with momentum and a rate that falls when they swing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# What is aimed at, how fast, and what counts as there.
TARGETS = {"precision": 0.80, "recall": 0.95, "efficiency": 0.85}
RATE, MOMENTUM, MOST_CHANGE, NEAR, NOTHING = 0.1, 0.9, 0.15, 0.01, 1e-6
STRATEGIES = {"conservative": 0.5, "balanced": 1.0, "aggressive": 2.0}
SWINGING, LOOK_BACK = 0.5, 3
# How each threshold follows the gaps (recall's turned round), and its largest value.
FOLLOWS = {"paper": {"precision": 0.4, "f1": 0.3}, "combined": {"recall": 0.3, "f1": 0.2, "efficiency": 0.1}, "citations": {"precision": 0.2}, "venue": {"efficiency": 0.1}}
CITATION_STEP, MOST = 10, {"paper": 1.0, "combined": 1.0, "citations": 1000, "venue": 1.0}
WATCHED = ("paper", "combined")


def gradients(seen: dict[str, float]) -> dict[str, float]:
    """Per threshold, from precision, recall, f1 and efficiency as seen. Gaps of
    .01 and less are none; the citation count moves in whole steps, and only if
    its gradient is above .1."""
    aims = TARGETS | {"f1": 2 * TARGETS["precision"] * TARGETS["recall"] / (TARGETS["precision"] + TARGETS["recall"])}
    gap = {k: v - seen[k] for k, v in aims.items()}
    gap = {k: 0.0 if abs(g) <= NEAR else -g if k == "recall" else g for k, g in gap.items()}
    out = {name: sum(w * gap[k] for k, w in follows.items()) for name, follows in FOLLOWS.items()}
    out["citations"] = int(out["citations"] * CITATION_STEP) if abs(out["citations"]) > 0.1 else 0
    return out


def adapted(rows: DataFrame, venue: str, order: str, start: dict[str, float], strategy: str = "balanced") -> DataFrame:
    """``rows`` (precision, recall, f1, efficiency per venue and time) with the
    thresholds after each. The moving average m of a threshold's gradients is
    m * .9 + gradient * .1; it moves by rate * m, .15 at most, within bounds.
    The rate is halved while one of the last three changes of the paper or
    combined threshold went the other way. A fold in time order: a venue is one
    task's group; venues are many and their observations few."""
    names = list(FOLLOWS)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        now, average, changes, out = dict(start), dict.fromkeys(names, 0.0), [], []
        for seen in pdf[["precision", "recall", "f1", "efficiency"]].to_dict("records"):
            last = changes[-LOOK_BACK:]
            swings = len(last) == LOOK_BACK and any(len({c[n] > 0 for c in last if c[n]}) > 1 for n in WATCHED)
            rate = RATE * STRATEGIES[strategy] * (SWINGING if swings else 1.0)
            was = dict(now)
            for n, g in gradients(seen).items():
                if abs(g) < NOTHING:
                    continue
                average[n] = MOMENTUM * average[n] + (1 - MOMENTUM) * g
                moved = min(max(now[n] + min(max(rate * average[n], -MOST_CHANGE), MOST_CHANGE), 0), MOST[n])
                now[n] = int(moved) if n == "citations" else moved
            changes.append({n: now[n] - was[n] for n in names})
            out.append([float(now[n]) for n in names])
        return pdf.assign(**{f"min_{n}": [x[i] for x in out] for i, n in enumerate(names)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"min_{n} double" for n in names)])
    return rows.groupBy(venue).applyInPandas(fold, schema)
