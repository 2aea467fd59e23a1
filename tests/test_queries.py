"""Every query against its SQL in DuckDB, over the smallest driver tables."""

import collections
import difflib
import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholia.functions import fuzzy
from scholia.plans import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else (float(x) if type(x).__name__ == "Decimal" else str(x)))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = canonical(got), canonical(want)
    assert len(got) == len(want) and len(got) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1.01e-6)


# ---------------------------------------------------------------- queries that SQL can't express, by brute force


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def parts(spark):
    from scholia.functions.text import title_key
    from scholia.plans.more_queries import _parts
    return sorted(rows_of(_parts(spark, SF).withColumn("key", title_key(F.col("title")))), key=lambda r: r["p_partkey"])


def linked(parts):
    """(a, b): title similarity, author similarity."""
    first, out = {}, {}
    for r in parts:
        k = (r["key"], tuple(r["authors"]))
        if k in first:
            out[first[k]["p_partkey"], r["p_partkey"]] = (1.0, 1.0)
        else:
            first[k] = r
    for x, y in itertools.combinations(first.values(), 2):
        a, b = sorted((x, y), key=lambda r: (r["key"], r["p_partkey"]))
        like = fuzzy.blend(a["key"], b["key"])
        if like >= 0.95 and (au := fuzzy.author_similarity(a["authors"], b["authors"])) >= 0.85:
            out[tuple(sorted((a["p_partkey"], b["p_partkey"])))] = (like, au)
    return out


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fuzzy_duplicates(spark, parts):
    got = {(r["a"], r["b"]): (r["title_similarity"], r["author_similarity"]) for r in rows_of(QUERIES["fuzzy_duplicates"](spark, SF))}
    want = linked(parts)
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_fuzzy_best_versions(spark, parts):
    got, = rows_of(QUERIES["fuzzy_best_versions"](spark, SF))
    kept = len(set(groups([r["p_partkey"] for r in parts], linked(parts)).values()))
    assert (got["records"], got["kept"]) == (len(parts), kept) and got["merge_rate"] == pytest.approx(1 - kept / len(parts))


def test_fuzzy_pairs_and_groups(spark):
    from scholia.plans.text_queries import _names
    count = collections.Counter(r["title"] for r in rows_of(_names(spark, SF)))
    pairs = {(a, b): fuzzy.blend(a, b) for a, b in itertools.combinations(sorted(count), 2)}
    pairs = {k: v for k, v in pairs.items() if v >= 0.95}
    got = {(r["a"], r["b"]): (r["similarity"], r["n_a"], r["n_b"]) for r in rows_of(QUERIES["fuzzy_pairs"](spark, SF))}
    assert got.keys() == pairs.keys() and all(got[a, b] == pytest.approx((v, count[a], count[b]), abs=1e-6) for (a, b), v in pairs.items())
    sizes = collections.Counter()
    for t, root in groups(sorted(count), pairs).items():
        sizes[root] += count[t]
    assert {r["title"]: r["n"] for r in rows_of(QUERIES["fuzzy_groups"](spark, SF))} == sizes


def test_blended_duplicates_query(spark, parts):
    like = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    taken = {}
    for i, x in enumerate(parts):
        if taken.setdefault(x["p_partkey"], x["p_partkey"]) != x["p_partkey"]:
            continue
        for y in parts[i + 1:]:
            a, b = ({n.lower() for n in r["authors"]} for r in (x, y))
            if y["p_partkey"] in taken or not a & b:
                continue
            score = 0.6 * like(x["title"], y["title"]) + 0.2 * len(a & b) / len(a | b) + (0.1 if x["year"] == y["year"] else 0.05) + 0.1 * like(x["p_type"], y["p_type"])
            if score >= 0.85 - 1e-12:
                taken[y["p_partkey"]] = x["p_partkey"]
    want = {}
    for leader, mine in itertools.groupby(sorted(parts, key=lambda r: (taken[r["p_partkey"]], r["p_partkey"])), key=lambda r: taken[r["p_partkey"]]):
        mine = list(mine)
        want[leader] = (len(mine), max(mine, key=lambda r: (r["p_retailprice"], -r["p_partkey"]))["p_partkey"])
    assert {r["leader"]: (r["n"], r["kept"]) for r in rows_of(QUERIES["blended_duplicates"](spark, SF))} == want


def test_first_by_any_key(spark):
    seen, want = set(), []
    for r in sorted(rows_of(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")), key=lambda r: r["doc_id"]):
        keys = set() if r["text"] is None else {r["text"], (" ".join(r["text"].lower().split()),)}
        if not keys & seen:
            seen |= keys
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows_of(QUERIES["first_by_any_key"](spark, SF))) == want


def test_best_venue_match(spark, duck):
    nations = [r[0].lower() for r in duck.sql("select n_name from nation").fetchall()]
    got = {r["name"]: r for r in rows_of(QUERIES["best_venue_match"](spark, SF))}
    for v, in duck.sql("select distinct lower(n_name) || 's' from supplier join nation on s_nationkey = n_nationkey").fetchall():
        best = max((1.0 if v == n else fuzzy.blend(v, n)) for n in nations)
        if best >= 0.9:
            alike = sorted(n for n in nations if fuzzy.blend(v, n) == best)
            assert got.pop(v)["match"] == alike[0]
    assert not got


def test_trend_p_values(spark):
    from scholia.operators import stats
    from scholia.plans.base import papers
    fit = {r["venue"]: r for r in rows_of(stats.linear_trend(papers(spark, SF).withColumn("y", F.col("year").cast("double")), "venue", "y", "citations"))}
    for r in rows_of(QUERIES["trend_p_values"](spark, SF)):
        f = fit[r["venue"]]
        if f["n"] <= 2 or not f["std_err"]:
            assert r["p"] is None
            continue
        t, dof, n = abs(f["slope"] / f["std_err"]), f["n"] - 2, 20000  # Simpson's rule over the density
        x = np.linspace(0, t, n + 1)
        y = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + x * x / dof) ** (-(dof + 1) / 2)
        inside = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * t / n / 3
        assert r["p"] == pytest.approx(1 - 2 * inside, abs=2e-6)


def test_threshold_adaptation(spark, duck):
    from scholia.operators import optimizer
    from scholia.plans.base import PAPERS_SQL
    seen = duck.sql(f"with {PAPERS_SQL} select venue, year, avg((citations >= 150)::int) as p, avg((citations >= 50)::int) as r, avg((citations >= 100)::int) as e from papers group by 1, 2 order by 1, 2").fetchall()
    got = {(r["venue"], r["year"]): r["min_venue"] for r in rows_of(QUERIES["threshold_adaptation"](spark, SF))}
    now = {}
    for venue, year, p, r, e in seen:
        t, m = now.get(venue, (0.5, 0.0))
        g = optimizer.gradients({"precision": p, "recall": r, "efficiency": e, "f1": 0})["venue"]
        assert g == pytest.approx(0.1 * (0.85 - e) if abs(0.85 - e) > 0.01 else 0)
        if abs(g) >= 1e-6:
            m = 0.9 * m + 0.1 * g
            assert 0 < abs(got[venue, year] - t) <= 0.1 * abs(m) + 1e-6  # the rate, or half of it
            t = got[venue, year]
        now[venue] = (t, m)
    assert len(got) == len(seen)


def test_clusters(spark):
    """Rows far apart fall into the groups that they were made of; the queries
    put every row into one of k."""
    from scholia.operators import stats
    rng = np.random.default_rng(1)
    made = [(i, i % 3, (np.eye(4)[i % 3] * 10 + rng.normal(0, 0.1, 4)).tolist()) for i in range(90)]
    got = rows_of(stats.clusters(spark.createDataFrame(made, "i long, kind int, v array<double>"), "v", 3))
    assert len({(r["kind"], r["cluster"]) for r in got}) == 3
    for name, table, k in (("embedding_clusters", "embeddings", 5), ("text_clusters", "benchmark", 4)):
        found = rows_of(QUERIES[name](spark, SF))
        assert sum(r["n"] for r in found) == spark.read.parquet(f"{SF}/{table}.parquet").count() and {r["cluster"] for r in found} <= set(range(k))


def test_nothing_is_untested():
    named = {"fuzzy_duplicates", "fuzzy_best_versions", "fuzzy_pairs", "fuzzy_groups", "blended_duplicates", "first_by_any_key", "best_venue_match", "trend_p_values", "threshold_adaptation", "embedding_clusters", "text_clusters"}
    assert set(QUERIES) - set(SQL) == named
