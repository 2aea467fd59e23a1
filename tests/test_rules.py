"""Rules and operators against plain versions of them, on made rows that reach
every branch."""

import collections
import datetime as dt
import itertools
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import affiliations as af
from scholia.functions import fuzzy, matching
from scholia.operators import contain, dedup, extend, greedy, optimizer, quantiles, stages, venues


# ---------------------------------------------------------------- authors and titles


@pytest.mark.parametrize("one,two,want", [
    (["Ann Lee", "Bob Ray"], ["Lee, A.", "R. Ray"], 0.5), (["John Doe Jr"], ["John Doe"], None), (["Doe Jr., John"], ["John Doe"], 1.0), (["Doe"], ["Zoe Doe"], 1.0), (["Ann Lee"], ["Bob Lee"], 0.0),
    (["A B", "C D", "E F"], ["A B"], 0.5), (["A B"], ["A B", "C D", "E F"], 1.0), ([], ["A B"], None), (["", "  "], ["A B"], None), (["Ann Lee", "Amy Lee"], ["A. Lee"], 0.5), (["Lee, "], ["Bob Lee"], 1.0), (["Doe v"], ["x v"], None)])
def test_author_overlap(one, two, want):
    assert fuzzy.author_overlap(one, two) == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("one,two,want", [
    (["Ann Lee"], ["A. Lee"], 0.9), (["John Doe"], ["James Doe"], 0.0), (["J. Doe"], ["James Doe"], 0.9), (["Ann Lee", "Bob Ray"], ["bob  ray"], 0.5), (["Ann Lee"], ["Ann  LEE"], 1.0), ([], ["A"], 0.0),
    (["Jon Smithson"], ["John Smithson"], 2 * 12 / 25), (["A B"], ["A C B"], 0.0), (["A. Lee", "Ann Lee"], ["Ann Lee", "Amy Lee"], 0.95),
    # a ratio met before the initials counts beside them
    (["jo smithson-x", "q"], ["jo smithson-y", "j smithson-x"], min(1.0, (0.9 + 24 / 26) / 2))])
def test_author_similarity(one, two, want):
    assert fuzzy.author_similarity(one, two) == pytest.approx(want)


def plain_match(t1, t2, y1, y2, a1, a2):
    if not t1 or not t2:
        return 0.0, "no_match"

    def key(t):
        t = t.lower().strip()
        for p in matching.TITLE_NOISE:
            t = re.sub(p, "", t)
        return " ".join(re.sub(r"[:,-]", " ", re.sub(r"[^\w\s\-:,]", " ", t)).split())

    a, b = key(t1), key(t2)
    gap = abs(y1 - y2) if y1 and y2 else 0
    overlap = fuzzy.author_overlap(a1, a2) if a1 and a2 else None
    people = 1 if overlap is None else 0.3 + 0.7 * overlap
    if a == b or a in b or b in a:
        s = (1.0 if a == b else 0.98) * (0.5 if gap > 1 else 1) * people
    else:
        s = (0.4 * fuzzy.token_sort_ratio(a, b) + 0.3 * fuzzy.token_set_ratio(a, b) + 0.2 * fuzzy.partial_ratio(a, b) + 0.1 * fuzzy.ratio(a, b)) / 100
        s *= (0.5 if gap > 1 else 0.95 if gap == 1 else 1) * people
    if a == b and s >= 1:
        return s, "exact"
    low = "low_confidence" if s > 0.7 or (a != b and (a in b or b in a)) else "no_match"
    return s, "high_confidence" if s >= 0.95 else "medium_confidence" if s >= 0.85 else low


def test_title_match(spark):
    titles = ["Deep learning for graphs", "Deep Learning for Graphs (Poster)", "deep learning for graph", "Learning for graphs, deep", "Graphs", "Something else entirely", "", None, "Deep learning on graphs: supplementary notes", "()", "Deep learning of large graphs [arXiv]"]
    people = [None, [], ["Ann Lee"], ["A. Lee", "Bob Ray"], ["Zed Q"]]
    rnd = random.Random(1)
    rows = [(i, t1, t2, rnd.choice([None, 0, 2000]), rnd.choice([None, 2000, 2001, 2005]), rnd.choice(people), rnd.choice(people)) for i, (t1, t2) in enumerate(itertools.product(titles, titles))] * 3
    frame = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "i long, t1 string, t2 string, y1 int, y2 int, a1 array<string>, a2 array<string>")
    got = {r["i"]: (r["similarity"], r["label"]) for r in matching.with_title_match(frame, "t1", "t2", "y1", "y2", "a1", "a2").collect()}
    for i, r in enumerate(rows):
        s, label = plain_match(*r[1:])
        assert got[i] == (pytest.approx(s, abs=1e-9), label), r
    assert {x[1] for x in got.values()} == set(matching.LABELS)
    levels = spark.createDataFrame([(x,) for x in matching.LABELS + [None, "odd"]], "l string").select(*[matching.at_least(F.col("l"), x) for x in ("exact", "medium_confidence", "unheard of")]).collect()
    assert [tuple(r) for r in levels] == [(i == 4, i >= 2, i >= 3) for i in range(5)] + [(False,) * 3] * 2


# ---------------------------------------------------------------- affiliations


def spelled(t):
    for k, v in (af.SHORT | af.MORE_SHORT).items():
        t = re.sub(rf"(?i)\b{k}\b", v, t)
    return t


def clean(t):
    w = t.split()
    t = spelled(" ".join(w[1:] if w and w[0].lower() in ("the", "at", "from") else w))
    return re.sub(r"^[,\-\s]+|[,\-\s]+$", "", " ".join(t.split()))


def plain_parse(text):
    """The fold over parts, step by step."""
    out = dict.fromkeys(["organisation", "department", "city", "state", "country", "email_domain"])
    if not text or not text.strip():
        return out | {"confidence": 0.0}
    hit = re.search(af.EMAIL, text)
    out["email_domain"] = hit and hit.group(1)
    text = re.sub(af.EMAIL, "", text)
    aside = [m[1:-1] for m in re.findall(r"\([^)]+\)", text)]
    text = re.sub(r"\([^)]+\)", "", text)

    for i, part in enumerate([p.strip() for p in re.split("[,;/]", text) if p.strip()]):
        low = part.lower()
        if not out["department"]:
            for p in (rf"(?i){af.UNITS}\s+(?:of|for)\s+(\w+(?:\s+\w+)*)", rf"(?i)(\w+(?:\s+\w+)*)\s+{af.UNITS}"):
                if m := re.search(p, part):
                    out["department"] = spelled(m.group(1)).title()
                    break
        if len(part) == 2 and part.isupper() and not out["state"]:
            out["state"] = part
            continue
        if i and len(part) <= 30 and not any(w in low for w in af.NOT_PLACES):
            if part.upper() in af.COUNTRIES:
                out["country"] = af.COUNTRIES[part.upper()]
            elif out["organisation"] and part != out["state"]:
                out["city"] = out["city"] or part
        if not out["organisation"] and len(part) > 2:
            if m := re.search(r"UC\s+(\w+)", part):
                out["organisation"] = "UC " + m.group(1)
            elif any(w in low for w in af.ORGANISATION_WORDS) or (i == 0 and not out["department"] and part.upper() not in af.UNIVERSITIES):
                out["organisation"] = clean(part)
            elif part.upper() in af.UNIVERSITIES:
                out["organisation"] = part.upper()
    if not out["organisation"]:
        out["organisation"] = next((clean(c) for c in aside if any(w in c.lower() for w in af.IN_PARENTHESES)), None)
    org = (out["organisation"] or "").lower()
    sure = 0.3 if not org or ("unknown" in org and "affiliation" in org) else 0.7 if any(w in org for w in af.VAGUE) else 1.0
    sure *= 0.8 if not out["department"] and re.search("dept|department", text.lower()) else 1
    sure *= 0.7 if out["email_domain"] and not org else 1
    sure *= 0.8 if out["city"] and "unknown" in out["city"].lower() else 1
    return out | {"confidence": sure * (0.9 if text and len(text.strip()) < 10 else 1)}


def plain_leading(text):
    if not text:
        return None
    if ";" in text:
        return plain_parse(text.split(";")[0].strip())["organisation"]
    if " and " in text.lower() or " & " in text:
        return plain_parse(re.split(r"(?i)\s+(?:and|&)\s+", text)[0].strip())["organisation"]
    org = plain_parse(text)["organisation"]
    if not org and any(ord(c) > 127 for c in text):
        return clean(text)
    return org


def test_affiliation_grammar(spark):
    pieces = ["Department of CS", "EE Dept.", "School for AI", "MIT", "ucla", "UC Berkeley", "The Example University", "at Acme Corporation", "from Univ of Oslo", "Unknown affiliation", "Some Research Lab", "Unknown City", "Zürich", "CA", "NY", "usa", "France", "USA", "x", "12345",
              "Laboratory", "(Institute of Things)", "(nothing)", "ann@cs.mit.edu", "bob@x", "Bio and Chem Faculty", "dept", "Institute", "Big Company & Sons", "A very long place name that is beyond thirty letters", "-- Foundation,"]
    rnd = random.Random(7)
    texts = [None, "", "  ", "()", "é", "ü (x)", "dept", ";", " and "] + pieces + [rnd.choice([", ", "; ", "/", " , ", " "]).join(rnd.sample(pieces, rnd.randrange(1, 6))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r for r in frame.select("i", af.parsed_affiliation(F.col("t")).alias("p"), af.leading_organisation(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(texts):
        want = plain_parse(t)
        mine = got[i]["p"].asDict()
        assert mine.pop("confidence") == pytest.approx(want.pop("confidence")), t
        assert {k: v or None for k, v in mine.items()} == {k: v or None for k, v in want.items()}, t
        assert (got[i]["l"] or None) == (plain_leading(t) or None), t


def test_affiliation_classes_tie(spark):
    rows = [("University Labs LLC",), ("lab",), ("labs",), ("Acme corp, Univ",), ("",), (None,), ("Mit Labs",)]
    got = [tuple(r["c"]) for r in spark.createDataFrame(rows, "a string").select(af.affiliation_class(F.col("a"), ["MIT"], ["Acme"]).alias("c")).collect()]
    # "labs" holds "lab" too: one hit on either side
    assert got == [("unknown", 0.0, None), ("academic", pytest.approx(1 / 3), None), ("unknown", 0.0, None), ("industry", 0.95, "Acme"), ("unknown", 0.0, None), ("unknown", 0.0, None), ("academic", 0.95, "MIT")]


# ---------------------------------------------------------------- names


def names_made(seed, n):
    rng = np.random.default_rng(seed)
    base = ["alpha institute", "beta labs", "gamma university", "delta", "epsilon works", "ab", "a", "zeta zeta zeta"]
    out = []
    for _ in range(n):
        t = list(str(rng.choice(base)))
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice(list("xyz ")))
        out.append("".join(t))
    return out


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_near_names(spark, least):
    a, b = names_made(1, 60), names_made(2, 40)
    got = {(r["a"], r["b"]) for r in dedup.near_names(spark.createDataFrame([(x,) for x in [*a, None]], "n string"), spark.createDataFrame([(x,) for x in b], "n string"), "n", least).collect()}
    assert got == {(x, y) for x in a for y in b if fuzzy.ratio(x, y) >= 100 * least - 1e-9}


def test_found_inside(spark):
    texts = names_made(3, 50) + ["", "x"]
    needles = ["lab", "a", "ta", "institute", "zeta z", "works", "nowhere", "", "delta", "univer"]
    got = {(r["t"], r["p"]) for r in contain.found_inside(spark.createDataFrame([(x,) for x in [*texts, None]], "t string"), "t", spark.createDataFrame([(x,) for x in [*needles, None]], "p string"), "p").collect()}
    assert got == {(t, p) for t in texts for p in needles if p and p in t}


def test_containing(spark):
    rng = np.random.default_rng(4)
    words = ["the", "a", "of", "graph", "deep", "model", "x1", "é"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(60)] + [None, "", "the  deep\nmodel of graph x1"]
    passages = [t[5:40] for t in texts if t and len(t) > 60][:20] + ["the", "deep model", "of graph deep", "", None, "deep\nmodel of graph", "no such words are there at all", texts[0][:25] if texts[0] else "the"]
    t, p = spark.createDataFrame(list(enumerate(texts)), "i long, text string"), spark.createDataFrame(list(enumerate(passages)), "k long, text string")
    want = sorted((i, k) for i, x in enumerate(texts) for k, y in enumerate(passages) if x is not None and y and y in x)
    found = contain.containing(t, "i", "text", p, "k", "text")
    assert sorted(map(tuple, found.collect())) == want and len(want) > 30
    contain.SMALL, kept = 0, contain.SMALL
    try:
        assert sorted(map(tuple, contain.containing(t, "i", "text", p, "k", "text").collect())) == want
    finally:
        contain.SMALL = kept


def test_containing_long_texts(spark):
    """Work grows with a text's words, not with their square."""
    texts = [" ".join(f"w{i * j % 977}" for i in range(20_000)) for j in range(1, 9)]
    t, p = spark.createDataFrame(list(enumerate(texts)), "i long, text string"), spark.createDataFrame([(0, texts[2][5000:5200]), (1, "w1 w2 w3 w4 w5 w6 w8")], "k long, text string")
    start = time.monotonic()
    assert sorted(map(tuple, contain.containing(t, "i", "text", p, "k", "text").collect())) == sorted((i, 0) for i, x in enumerate(texts) if texts[2][5000:5200] in x)
    assert time.monotonic() - start < 40


def test_patterns_hold():
    """Whatever matches a pattern holds one of its fixed parts, in any case."""
    from scholia.functions import extract
    rnd, met = random.Random(3), collections.Counter()
    parts = ["1", "2.5", "8 ", " x ", "×", "*", "V100", " a100 ", " GPU", "-HOURS", " hrs", " H ", " Days", " d ", " W ", "weeks", "For ", " Training", "TRAINED on ", " graphics CARDS", " B", " M", " Million ", " PARAMETERS", " params", "Model Size: ", "Total: ", " gpu hours", " GPU-Hours", "-week"]
    for _ in range(60_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(2, 7)))
        for p, held in extract.HOLDS.items():
            if re.search(f"(?i){p}", text, re.ASCII):
                met[p] += 1
                assert any(h in text.lower() for h in held)
    assert set(met) == set(extract.HOLDS) == {*extract.GPU_COUNT, *extract.TIME, *extract.PARAMETERS, *extract.GPU_HOURS}


# ---------------------------------------------------------------- choices in order


def graph_made(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, n, (m, 2))
    return sorted({(int(min(a, b)), int(max(a, b))) for a, b in pairs if a != b})


@pytest.mark.parametrize("pairs", [graph_made(1, 60, 120), graph_made(2, 30, 200), [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 30)], []], ids=["thin", "dense", "chain", "star", "none"])
@pytest.mark.parametrize("few", [0, 10**9], ids=["rounds", "fold"])
def test_leaders_and_matching(spark, pairs, few):
    frame = spark.createDataFrame(pairs, "a long, b long")
    rows = spark.range(60)
    leader = {}
    near = set(pairs)
    for i in range(60):
        if i not in leader:
            leader[i] = i
            for j in range(i + 1, 60):
                if (i, j) in near:
                    leader.setdefault(j, i)
    assert {r["id"]: r["leader"] for r in greedy.leaders(rows, "id", frame, few).collect()} == leader
    used, want = set(), set()
    for a, b in sorted(pairs, key=lambda p: (p[1], p[0])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    assert {tuple(r) for r in greedy.matching(frame, ["b", "a"], few=few).collect()} == want


def test_one_large_component(spark):
    """A component that no task should walk through row by row."""
    n = 60_000
    frame = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1 + F.pmod(F.xxhash64("id"), F.lit(50))).alias("b"))
    lost, leads = set(), collections.defaultdict(list)
    for r in frame.collect():
        leads[r["a"]].append(r["b"])
    for a in sorted(leads):
        if a not in lost:
            lost.update(leads[a])
    assert {r["node"] for r in greedy.beaten(frame, few=1000).collect()} == lost


@pytest.mark.parametrize("few", [0, 10**9], ids=["rounds", "fold"])
def test_first_by_any(spark, few):
    rng = np.random.default_rng(6)
    rows = [(i, *(None if rng.random() < 0.2 else f"{k}{int(rng.integers(0, 15))}" for k in "xyz")) for i in range(120)]
    seen, want = set(), []
    for i, *keys in rows:
        mine = {(n, k) for n, k in enumerate(keys) if k}
        if not mine & seen:
            seen |= mine
            want.append(i)
    frame = spark.createDataFrame(rows, "o long, x string, y string, z string")
    assert sorted(r["o"] for r in greedy.first_by_any(frame, ["x", "y", "z"], "o", few).collect()) == want


def test_spaced(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["hot"] * 6 + ["b", None]), t0 + dt.timedelta(seconds=rnd.randrange(0, 40_000), microseconds=rnd.choice([0, 1, 999_999])), i) for i in range(1500)]
    rows += [("dense", t0 + dt.timedelta(seconds=i), 10_000 + i) for i in range(900)] + [("even", t0 + dt.timedelta(seconds=60 * i), 20_000 + i) for i in range(30)] + [("one", t0, 1), ("one", t0, 0), ("gone", None, 5)]
    frame = spark.createDataFrame(rows, "key string, at timestamp, i long")
    for seconds in (60, 300):
        want, last = set(), {}
        for k, t, i in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2])):
            if k not in last or t - last[k] >= dt.timedelta(seconds=seconds):
                last[k] = t
                want.add((k, i))
        assert {(r["key"], r["i"]) for r in greedy.spaced(frame, ["key"], "at", "i", seconds).collect()} == want


# ---------------------------------------------------------------- quantiles


def test_quantiles(spark):
    rng = np.random.default_rng(8)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 3000)] + [("hot", None)] + [("ties", float(v)) for v in rng.integers(0, 4, 500)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, 9.0), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r["g"]: [r[k] for k in shares] for r in quantiles.quantiles(quantiles.counted(frame, ["g"], "v"), ["g"], "v", shares).collect()}
    for g in {r[0] for r in rows} - {"empty"}:
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], list(shares.values())))
    assert set(got) == {"hot", "ties", "one", "two", None}
    whole = quantiles.with_quantiles(frame.agg(F.count("v").alias("n")), frame, [], "v", {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert quantiles.quantiles(quantiles.counted(frame.limit(0), ["g"], "v"), ["g"], "v", shares).count() == 0


# ---------------------------------------------------------------- organisations


def test_organisations_of_nothing(spark):
    dim = spark.createDataFrame([(0, "Only One", "industry", [], [], [])], "ordinal int, name string, type string, aliases array<string>, domains array<string>, keywords array<string>")
    got = venues.organisations(spark.createDataFrame([(1, None), (2, " "), (3, "Only Ome"), (4, "other")], "i long, t string"), F.col("t"), dim).collect()
    assert {r["i"]: (r["org"], r["org_by"]) for r in got} == {1: (None, "none"), 2: (None, "none"), 3: ("Only One", "fuzzy"), 4: (None, "none")}


# ---------------------------------------------------------------- thresholds


def test_optimizer(spark):
    g = optimizer.gradients({"precision": 0.5, "recall": 0.95, "efficiency": 0.85, "f1": 0.6})
    f1 = 2 * 0.8 * 0.95 / 1.75 - 0.6
    assert g["paper"] == pytest.approx(0.3 * 0.4 + f1 * 0.3) and g["combined"] == pytest.approx(f1 * 0.2) and g["venue"] == 0 and g["citations"] == 0
    assert optimizer.gradients({"precision": 0.2, "recall": 0, "efficiency": 0, "f1": 0})["citations"] == 1
    rows = [("v", t, p, 0.95, 0.85, f) for t, p, f in ((1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, 1.0, 1.0), (5, 0.0, 0.0), (6, 0.0, 0.0))] + [("w", 1, 0.8, 0.95, 0.85, 2 * 0.8 * 0.95 / 1.75)]
    frame = spark.createDataFrame(rows, "v string, t int, precision double, recall double, efficiency double, f1 double")
    for strategy, factor in optimizer.STRATEGIES.items():
        got = {(r["v"], r["t"]): r for r in optimizer.adapted(frame, "v", "t", {"paper": 0.5, "combined": 0.5, "citations": 5, "venue": 0.5}, strategy).collect()}
        now, average, signs = 0.5, 0.0, []
        for t, (_, _, p, _, _, f) in enumerate(rows[:6], 1):
            gap = 0.4 * (0.8 - p) + 0.3 * (2 * 0.8 * 0.95 / 1.75 - f)
            average = 0.9 * average + 0.1 * gap
            recent = signs[-3:]
            rate = 0.1 * factor * (0.5 if len(recent) == 3 and len(set(recent)) > 1 else 1)
            now += rate * average
            signs.append(math.copysign(1, rate * average))
            assert got["v", t]["min_paper"] == pytest.approx(now)
        assert got["w", 1]["min_paper"] == 0.5 and got["w", 1]["min_citations"] == 5


# ---------------------------------------------------------------- stages


def test_detected_stages(spark, tmp_path):
    (tmp_path / "list.json").write_text('\n [{"title": "a"}, {"title": "b"}]')
    (tmp_path / "papers.json").write_text('{"papers": [{"title": "a"}]}')
    (tmp_path / "meta.json").write_text('{\n"collection_metadata": {"n": 1}}')
    (tmp_path / "other.json").write_text('{"x": 1}')
    (tmp_path / "broken.json").write_text('{"papers": [')
    (tmp_path / "list.txt").write_text("[]")
    (tmp_path / "run" / "collected_papers").mkdir(parents=True)
    (tmp_path / "bare").mkdir()
    want = {"list.json": 1, "papers.json": 1, "meta.json": 1, "other.json": 0, "broken.json": 0, "list.txt": 0, "run": 1, "bare": 0, "missing": 0}
    assert {k: len(stages.detected(spark, str(tmp_path / k))) for k in want} == want
    checks = stages.Checks()
    checks.register("collection", "rows", lambda df: df.agg(F.count("*").cast("double").alias("score")))
    assert stages.run_detected(spark, str(tmp_path / "run"), checks, spark.range(3)).count() == 2 and stages.run_detected(spark, str(tmp_path / "bare"), checks, spark.range(3)) is None
    assert json.loads("[]") == []


def test_extraction_path(spark):
    def walk(answers):
        path = ["start"]
        while path[-1] != stages.LAST_STEP:
            yes, no, other = stages.DECISIONS.get(path[-1], (None, None, None))
            said = (answers.get(path[-1]) or "").lower()
            path.append((yes if said in ("yes", "y") else no if said in ("no", "n") else other) or stages.LAST_STEP)
        return path

    rnd = random.Random(2)
    made = [{step: rnd.choice(["yes", "Y", "no", "N", "maybe", None]) for step in stages.DECISIONS if rnd.random() < 0.9} for _ in range(300)] + [{}]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(made)], "i long, a map<string,string>")
    got = {r["i"]: r["p"] for r in frame.select("i", stages.extraction_path(F.col("a")).alias("p")).collect()}
    assert all(got[i] == walk(a) for i, a in enumerate(made)) and len({tuple(p) for p in got.values()}) > 15
    assert max(map(len, got.values())) > 6


# ---------------------------------------------------------------- extension points


def test_registries_and_validators(spark):
    for known in (extend.Registry(), extend.Analyzers(), extend.Collectors()):
        known.register("x", None)
        with pytest.raises(ValueError):
            known.register("x", None)
    with pytest.raises(ValueError):
        extend.Analyzers().apply(F.lit("t"))
    with pytest.raises(ValueError):
        extend.Collectors().discover(spark.range(1), "id")
    check = extend.custom(lambda x: 10 / x > 1)
    got = [r[0] for r in spark.createDataFrame([(0,), (5,), (50,), (None,)], "v int").select(check(F.col("v"))).collect()]
    assert got == [False, True, False, False]


def test_hooks_see_steps(spark, tmp_path):
    seen, hooks = [], extend.Hooks()
    hooks.before.append(lambda step, df: seen.append(("before", step, df.columns)))
    hooks.after.append(lambda step, df, numbers: seen.append(("after", step, numbers)))
    out = hooks.run("double", lambda df: df.withColumn("d", F.col("id") * 2), spark.range(5), total=F.sum("d"))
    assert out.count() == 5 and [s[:2] for s in seen] == [("before", "double"), ("after", "double")]
    assert seen[1][2]() == {"rows": 5, "total": 20}
    assert extend.chained(spark.range(3), lambda d: d.filter("id > 0"), lambda d: d.limit(1)).count() == 1
    spark.range(7).write.parquet(f"{tmp_path}/in")
    got = []
    extend.per_batch(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda df, n: got.append((n, df.count())), f"{tmp_path}/ck").awaitTermination()
    assert sum(k for _, k in got) == 7


def test_collectors_keep_the_surest(spark):
    known = extend.Collectors()
    known.register("b", (F.array(F.lit("u"), F.lit("v")), 0.5))
    known.register("a", (F.array(F.lit("u"), F.lit(""), F.lit(None)), 0.5))
    known.register("c", (F.lit(None).cast("array<string>"), 0.9))
    assert sorted(map(tuple, known.discover(spark.range(1), "id").collect())) == [(0, "u", "a", 0.5), (0, "v", "b", 0.5)]


def test_by_text_works_out_each_text_once(spark):
    from scholia.operators import joins

    told = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dear(text):
        told.add(1)
        return f"<{text}>"

    rows = spark.createDataFrame([(i, ["a", "b", None, ""][i % 4]) for i in range(40)], "k long, t string").repartition(5)
    got = joins.by_text(rows, F.col("t"), out=dear, n=F.length)
    assert got.columns == ["k", "t", "out", "n"]
    assert {r["k"]: (r["t"], r["out"], r["n"]) for r in got.collect()} == {i: [("a", "<a>", 1), ("b", "<b>", 1), (None, "<None>", None), ("", "<>", 0)][i % 4] for i in range(40)}
    assert told.value == 4
