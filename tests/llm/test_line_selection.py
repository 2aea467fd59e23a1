"""Which lines the line join compares: all that have a similar one, few others."""

import numpy as np
from pyspark.sql import functions as F

from scholia.llm import linededup


def shingles(line):
    w = line.split(" ")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_lines_with_a_similar_one_meet(spark):
    """Also those that repeat words and shingles, and pairs just at the limit."""
    rng = np.random.default_rng(3)
    lines = set()
    for size in [2, 3, 6, 20, 400]:
        for _ in range(25):
            w = [f"w{x}" for x in rng.integers(0, size, int(rng.integers(5, 60)))]
            lines.add(" ".join(w))
            for _ in range(3):
                v = list(w)
                for _ in range(int(rng.integers(1, 3))):
                    at = int(rng.integers(0, len(v)))
                    v[at:at + int(rng.integers(0, 2))] = [f"w{x}" for x in rng.integers(0, size, int(rng.integers(0, 2)))]
                lines.add(" ".join(v))
    alone = [" ".join(f"x{i}y{j}" for j in range(30)) for i in range(50)]
    lines = sorted(lines) + alone + ["too short a line", "x0y0", ""]
    sets = [shingles(x) for x in lines]
    want = {x for x, s in zip(lines, sets) for y, t in zip(lines, sets) if x != y and s and t and 100 * len(s & t) >= 75 * len(s | t)}
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    met = linededup._meeting(frame)
    got = {r["line"] for r in frame.select("line", linededup._line_key().alias("k")).join(met, "k", "left_semi").collect()}
    assert len(want) > 100 and want <= got
    assert not got & set(alone) and "x0y0" not in got
    # copies of one line are no lines of other words
    assert linededup._meeting(spark.createDataFrame([(alone[0],)] * 9, "line string")).count() == 0


def test_lines_are_lowered_once(spark):
    """Generators evaluate an expression as often as it is written."""
    frame = spark.createDataFrame([("A  B\n\tC",)], "text string").select(F.explode(linededup._split_lines()).alias("line"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r["line"] for r in frame.collect()] == ["a b", " c"]


def test_maps_of_bits_let_all_similar_sets_through(spark):
    """And hardly any others; sets just at the limit are among them."""
    rng = np.random.default_rng(8)
    rows = []
    for n in [1, 2, 3, 4, 7, 8, 20, 68, 300]:
        for _ in range(12):
            a = rng.integers(-(1 << 62), 1 << 62, n).tolist()
            for keep in {n, -(-n * 7 // 8), -(-n * 3 // 4), n // 2, 0}:
                rows.append((a, a[:keep] + rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, n - keep + 1))).tolist()))
    rows = [(a, b) for a, b in rows if b]
    both = spark.createDataFrame(rows, "items array<bigint>, other array<bigint>").select("items", "other", *linededup._bits("x"))
    both = both.withColumnRenamed("items", "mine").withColumnRenamed("other", "items").select("*", *linededup._bits("y"))
    got = both.select(linededup._bits_allow(F.size("mine"), F.size("items")).alias("may"), linededup.similar(F.col("mine"), F.col("items"), F.size("mine"), F.size("items")).alias("is")).collect()
    assert sum(r["is"] for r in got) > 100 and all(r["may"] for r in got if r["is"])
    assert sum(r["may"] for r in got if not r["is"]) < sum(not r["is"] for r in got) / 3
