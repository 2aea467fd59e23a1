"""Functions, sources, joins and streams on small, hand-made rows."""

import collections
import datetime as dt
import difflib
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import extract, fuzzy, scores
from scholia.functions import text as tx
from scholia.operators import aggregates, dedup, filters, joins, stages, stats, windows
from scholia.operators.graph import connected
from scholia.plans import QUERIES
from scholia.schema import PAPER_DDL, best_abstract, best_pdf_url, best_urls, latest_citations, promote_identifiers
from scholia.sources import offline, papers
from scholia.streaming import alerts


def values(spark, expr, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(expr).collect()]


def test_titles(spark):
    rows = [("A  Study (Extended Abstract)",), ("Deep-Nets: supplementary notes",), (None,), ("Über Räume, Teil 2 [preprint]",), ("  X\tY ",)]
    assert values(spark, tx.title_key(F.col("t")), rows, "t string") == ["a study", "deep-nets", "", "über räume, teil 2 [preprint]", "x y"]
    assert values(spark, tx.title_words(F.col("t")), rows, "t string") == ["a study", "deep nets", "", "über räume teil 2", "x y"]


def test_identifiers(spark):
    rows = [("https://doi.org/10.1234/ab.c",), ("DOI:10.12/x",), ("10.5555/q r",), (None,)]
    assert values(spark, tx.doi_key(F.col("t")), rows, "t string") == ["10.1234/ab.c", None, "10.5555/q r", None]
    rows = [("arXiv:2101.00001v3",), ("https://arxiv.org/pdf/cs.LG/0701234.pdf",), ("nonsense",)]
    assert values(spark, tx.arxiv_key(F.col("t")), rows, "t string") == ["2101.00001", "cs.LG/0701234", None]
    got = values(spark, tx.ids_in_url(F.col("t")), [("https://x.org/10.1000/abc",), ("http://arxiv.org/abs/2203.11111",)], "t string")
    assert [tuple(x) for x in got] == [("10.1000/abc", None), (None, "2203.11111")]


def test_inverted_index_and_hashes(spark):
    assert values(spark, tx.inverted_text(F.col("m")), [({"a": [0, 2], "b": [1]},)], "m map<string,array<int>>") == ["a b a"]
    a, b = values(spark, tx.content_hash(F.lit("T"), F.col("n"), F.lit("V"), F.lit(2020)), [(["x", "y"],), (["y", "x"],)], "n array<string>")
    assert a == b and len(a) == 64


def test_paper_fields(spark):
    rows = [("p", None, [("s", True, "u1.pdf", 1), ("s", False, "u2.pdf", 2)], [("doi", "10.1/x"), ("arxiv", "1")], 7)]
    frame = spark.createDataFrame(rows, "paper_id string, doi string, u array<struct<source:string,original:boolean,url:string,t:int>>, i array<struct<k:string,v:string>>, c bigint")
    frame = frame.select("paper_id", "doi", F.lit("taken").alias("arxiv_id"), F.lit(None).cast("string").alias("openalex_id"),
                         F.transform("u", lambda x: F.struct(x["source"], F.timestamp_seconds(x["t"]).alias("timestamp"), x["original"], F.struct(x["url"]).alias("data"))).alias("urls"),
                         F.transform("i", lambda x: F.struct(F.struct(x["k"].alias("identifier_type"), x["v"].alias("identifier_value")).alias("data"))).alias("identifiers"),
                         F.array(F.struct(F.struct(F.col("c").alias("count")).alias("data"))).alias("citations"))
    r = promote_identifiers(frame).select("doi", "arxiv_id", "discovered", latest_citations(F.col("citations")).alias("n"), best_urls(F.col("urls")).alias("b"), best_pdf_url(F.col("urls")).alias("pdf")).first()
    assert (r["doi"], r["arxiv_id"], r["discovered"], r["n"], r["b"], r["pdf"]) == ("10.1/x", "taken", {"arxiv": "1"}, 7, ["u1.pdf"], "u1.pdf")
    assert values(spark, best_abstract(F.col("a")), [([(False, ("x",)), (True, ("y",))],), ([],)], "a array<struct<original:boolean,data:struct<text:string>>>") == ["y", ""]


def test_extraction(spark):
    text = "We trained on 8 x V100 for 5 days. 1.5 billion parameters; total: 1,000 GPU-hours, $50,000.00"
    r = values(spark, extract.requirements(F.col("t")), [(text,), (None,)], "t string")
    assert (r[0]["gpu_type"], r[0]["gpu_count"], r[0]["training_hours"], r[0]["parameters_millions"], r[0]["gpu_hours"]) == ("V100", 8, 120.0, 1500.0, 1000.0)
    assert r[1]["gpu_type"] is None and r[1]["confidence"] == 0.0
    assert values(spark, extract.costs(F.col("t")), [(text,)], "t string") == [[50000.0]]
    assert tuple(values(spark, extract.vague_hours(F.col("t")), [("ran overnight",)], "t string")[0]) == (8.0, 12.0)
    assert values(spark, extract.missing_gpu(F.col("t"), F.lit(2019)), [("latest NVIDIA card",), ("16GB card",), ("x",)], "t string") == ["V100 (inferred)", "V100 or T4 (inferred from memory)", "V100 (assumed based on year)"]
    assert values(spark, extract.known_parameters(F.col("t")), [("BERT-large",), ("our gpt-3 clone",), ("x",)], "t string") == [340.0, 175000.0, None]
    assert values(spark, extract.suppression(F.col("a"), F.col("b"), F.lit(None), F.lit(None)), [(1, None), (None, None), (9, 1)], "a int, b int") == pytest.approx([1.0, 0.0, 0.25 / 0.55])


def test_fuzzy_scorers():
    assert fuzzy.lcs("kitten", "sitting") == 4 and fuzzy.ratio("kitten", "sitting") == pytest.approx(800 / 13)
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("a b c", "a b") == 100
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100 and fuzzy.blend("same", "same") == 1.0 and fuzzy.blend_wide("a study", "a study of x") == 0.98
    assert fuzzy.author_overlap(["Ann Lee", "Bob Ray"], ["Lee, A.", "R. Ray"]) == 0.5
    assert fuzzy.author_similarity(["Ann Lee"], ["A. Lee"]) == 0.9


def test_thresholds_and_skewness(spark):
    rows = [("v", 2023, c, "tier1") for c in (50, 30, 10, 5, 2)]
    frame = spark.createDataFrame(rows, "venue string, year int, citations bigint, tier string")
    assert aggregates.adaptive_thresholds(frame, 2024).first()["threshold"] == 20
    base = values(spark, scores.base_threshold(F.col("t"), F.col("y"), 2024), [("tier1", 2023), ("odd", 2010), ("tier2", 2030)], "t string, y int")
    assert base == [5, 7, 2]
    x = [1.0, 2.0, 2.0, 9.0]
    n, mean = 4, 3.5
    sd = (sum((v - mean) ** 2 for v in x) / n) ** 0.5
    want = n / ((n - 1) * (n - 2)) * sum(((v - mean) / sd) ** 3 for v in x)
    assert spark.createDataFrame([(v,) for v in x], "v double").agg(aggregates.sample_skewness(F.col("v"))).first()[0] == pytest.approx(want)


def test_p_value():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4) and stats.t_two_sided(0.0, 5) == 1.0


def test_groups_and_components(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (7, 8, 0.9), (5, 6, 0.99), (6, 9, 0.98)], "a long, b long, s double")
    roots = {r["node"]: r["root"] for r in connected(pairs).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 5: 5, 6: 5, 9: 5}
    kept = {(r["a"], r["b"]) for r in joins.greedy_groups(pairs, ["a", "b"]).collect()}
    assert kept == {(1, 2), (5, 6), (7, 8)}


def test_chain_components(spark):
    n = 200
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r["root"] for r in connected(chain).collect()} == {0}


def test_download_todo_and_contracts(spark):
    p = spark.createDataFrame([(i,) for i in range(4)], "k long")
    state = spark.createDataFrame([(0, "done", False), (1, "failed", True), (2, "failed", False)], "k long, status string, permanent boolean")
    assert {r["k"] for r in filters.download_todo(p, state, "k", True).collect()} == {2, 3}
    assert {r["k"] for r in filters.download_todo(p, state, "k", False).collect()} == {3}
    assert filters.schema_contract(p, ["k", "missing"]) == ["missing"]


def test_windows_edge_cases(spark):
    rows = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1, 0, 0, i * 10)) for i in range(4)] + [("b", 9, dt.datetime(2024, 1, 1))], "k string, i int, ts timestamp")
    assert [(r["k"], r["rapid"]) for r in windows.bursts(rows, "k", "ts", "i").collect()] == [("a", 3)]


# ---------------------------------------------------------------- sources


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"papers": [{"title": "T", "venue": "V", "year": 2020}, {"paper_id": "x", "title": "U"}]}))
    got = papers.read_papers(spark, str(tmp_path / "a.json")).collect()
    assert [r["paper_id"] for r in got] == ["V_2020_0000", "x"]
    (tmp_path / "b.json").write_text(json.dumps([{"title": "L", "authors": ["Ann", {"name": "Bob", "affiliation": "MIT"}], "citations": 4}]))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text(json.dumps({"k1": {"title": "D"}}))
    rows = papers.decode_legacy(papers.read_any_json(spark, str(tmp_path / "*.json"))).collect()
    assert {r["title"] for r in rows} == {"T", "U", "L", "D"}
    legacy = next(r for r in rows if r["title"] == "L")
    assert [(a["name"], a["affiliations"]) for a in legacy["authors"]] == [("Ann", []), ("Bob", ["MIT"])] and legacy["citations"] == 4


def test_sinks_and_projection(spark, tmp_path):
    flat = spark.createDataFrame([("p", "t" * 200, "V", 2020, "abs", None, 3)], "paper_id string, title string, venue string, year int, abstract string, pdf_url string, citation_count bigint")
    p = papers.from_scraper(flat, "site").first()
    assert p["abstracts"][0]["data"]["text"] == "abs" and p["urls"] == [] and p["citations"][0]["data"]["count"] == 3
    papers.write_papers(flat, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/metadata")).first()["total"] == 1
    papers.write_flat_csv(flat, str(tmp_path / "csv"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["title"]) == 100
    assert papers.years("2020-2022,2024") == [2020, 2021, 2022, 2024]
    layers = [spark.createDataFrame([("a", "X")], "k string, v string"), spark.createDataFrame([("a", "Y"), ("b", "Z")], "k string, v string")]
    assert {(r["k"], r["v"]) for r in papers.merge_mappings(layers, "k", "v").collect()} == {("a", "X"), ("b", "Z")}
    assert len(PAPER_DDL) > 0


def test_offline_sources(spark, tmp_path):
    (tmp_path / "p.html").write_text('<div class="paper"><p class="title">A &amp; B</p><span class="authors">Ann Lee, Bob Ray</span><a href="x.pdf">pdf</a></div>')
    offline.register(spark)
    got = spark.read.format("scholia_pages").option("path", str(tmp_path)).option("venue", "ICML").option("year", "2021").load().collect()
    assert [(r["title"], r["authors"], r["year"], r["pdf_url"], r["source"]) for r in got] == [("A & B", ["Ann Lee", "Bob Ray"], 2021, "x.pdf", "pmlr")]
    assert offline.route("Somewhere") == "semantic_scholar"
    assert list(offline.PARSERS["aaai"]("<record><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:date>2019-01-01</dc:date></record>", "AAAI", 0))[0][:4] == ("T", ["A"], "AAAI", 2019)
    assert list(offline.PARSERS["openalex"](json.dumps({"results": [{"title": "T", "authors": [{"display_name": "A"}], "publication_year": 2018}]}), "V", 0))[0][:4] == ("T", ["A"], "V", 2018)


# ---------------------------------------------------------------- streams


def test_streaming_rates_match_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i % 50), ["a", "b"][i % 2], float(i)) for i in range(100)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = alerts.stream_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp, kind string, value double")
    got = alerts.run_available(alerts.rates(stream, "ts", "kind"), "rates", str(tmp_path / "ck"), "update")
    want = alerts.rates(frame, "ts", "kind")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_streaming_dedup_and_cooldown(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s), "r1") for s in (0, 10, 400, 420, 1000)]
    frame = spark.createDataFrame(rows, "ts timestamp, rule string")
    later = spark.createDataFrame([(rows[0][0] + dt.timedelta(hours=2), "later")], frame.schema)  # drives the watermark on
    frame.unionByName(later).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = alerts.stream_files(spark, str(tmp_path / "in"), "ts timestamp, rule string")
    fired = alerts.run_available(alerts.cooled_down_stream(stream, "rule", "ts", 300), "fired", str(tmp_path / "c1")).collect()
    batch = alerts.cooled_down(frame.withColumn("i", F.lit(0)), ["rule"], "ts", "i", 300).collect()
    assert sorted(r["fired_at"] for r in fired if r["key"] == "r1") == sorted(r["ts"] for r in batch) == [rows[0][0], rows[2][0], rows[4][0]]
    seen = alerts.run_available(alerts.deduplicated(stream, "ts", ["rule"]), "seen", str(tmp_path / "c2")).count()
    assert seen == 2


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        alerts.rule("__import__('os')")
    assert values(spark, alerts.eta_hours(F.col("d"), F.col("t"), F.col("r")), [(1, 3, 5.0), (1, 3, 0.0)], "d int, t int, r double") == [pytest.approx(100 / 300), None]


def test_sessions_and_cache(spark, tmp_path):
    from scholia.sources import state
    root, df = str(tmp_path / "s"), state.mock_papers(spark, 50)
    state.save(df, root, "one", "collect")
    state.save(df, root, "one", "collect", "done")
    state.save(df.limit(3), root, "two", "collect", "failed")
    assert {(r["session"], r["status"]) for r in state.sessions(spark, root).collect()} == {("one", "done"), ("two", "failed")}
    assert state.load(spark, root, "one", "collect").count() == 50
    assert len(state.clean(spark, root, ["failed"], dry_run=False)) == 1
    with pytest.raises(Exception):
        state.load(spark, root, "two", "collect").count()
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.bin").write_bytes(b"abc")
    found = state.blobs(spark, str(tmp_path / "b"))
    want = found.select("path", F.lit("0").alias("sha256")).unionByName(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    assert {r["error"] for r in state.blob_errors(found, want).collect()} == {"missing", "damaged"}
    assert state.mock_papers(spark, 40, kind="corrupted").filter("title is null").count() > 0


def test_notifications(spark, tmp_path):
    from scholia.sources import state
    spark.createDataFrame([(1, "warning"), (2, "critical")], "k int, severity string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    q = state.notify(alerts.stream_files(spark, str(tmp_path / "in"), "k int, severity string"), {"critical": got.extend}, str(tmp_path / "c"))
    q.awaitTermination()
    assert [json.loads(x)["k"] for x in got] == [2]


def test_first_by_any_key_reads_whole_texts(spark, tmp_path):
    from scholia.plans import QUERIES
    head = "a shared header of more than sixty characters, the same in all of these texts: "
    texts = [head + "one", head + "two", head.upper() + " ONE\n", head + "two", None, None, "short", "Short ", "\tshort", head + "three", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), []
    for i, t in enumerate(texts):
        keys = set() if t is None else {("hash", t), ("words", " ".join(t.lower().split()))}
        if not keys & seen:
            seen |= keys
            want.append(i)
    assert sorted(r["doc_id"] for r in QUERIES["first_by_any_key"](spark, str(tmp_path)).collect()) == want == [0, 1, 4, 5, 6, 9, 10]


def test_similar_titles_miss_nothing(spark):
    """Against all pairs: typos, swapped words, copies."""
    rng = np.random.default_rng(3)
    words = ["deep", "learning", "for", "graphs", "vision", "transformers", "scaling", "laws", "of", "robust", "models", "survey"]
    titles = []
    for _ in range(40):
        base = list(rng.choice(words, int(rng.integers(3, 9))))
        titles.append(" ".join(base))
        for _ in range(3):
            t = list(" ".join(rng.permutation(base) if rng.random() < 0.3 else base))
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(0, len(t)))] = str(rng.choice(list("xyz")))
            titles.append("".join(t))
    titles += ["a", "b", "ab", "abc", titles[0], ""]
    frame = spark.createDataFrame([(t,) for t in [*titles, None]], "t string")
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"]) for r in dedup.similar_titles(frame, "t", 0.95).collect()}
    names, n = sorted(set(titles)), collections.Counter(titles)
    want = {(a, b): (n[a], n[b]) for i, a in enumerate(names) for b in names[i + 1:] if fuzzy.blend(a, b) >= 0.95}
    assert got == want and len(want) > 20


def test_blended_duplicates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"paper about topic {i % 7} {'x' * int(rng.integers(0, 3))}", [str(a) for a in rng.choice(["Ann", "ann", "Bob", "Cy", "Di"], int(rng.integers(0, 3)))], int(2000 + rng.integers(0, 2)), str(rng.choice(["ICML", "ICLR"]))) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, t string, au array<string>, y int, v string")
    like = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = {}
    for i, one in enumerate(rows):
        for two in rows[i + 1:]:
            a, b = {x.lower() for x in one[2]}, {x.lower() for x in two[2]}
            score = 0.6 * like(one[1], two[1]) + (0.2 * len(a & b) / len(a | b) if a and b else 0) + (0.1 if one[3] == two[3] else 0.05) + 0.1 * like(one[4], two[4])
            if score >= 0.85:
                want[one[0], two[0]] = round(score, 6)
    pairs = dedup.blended_pairs(frame, "id", "t", "au", "y", "v")
    assert {(r["a"], r["b"]): round(r["score"], 6) for r in pairs.collect()} == want and len(want) > 10
    leader = {}
    for i in range(60):
        if i not in leader:
            leader[i] = i
            for j in range(i + 1, 60):
                if (i, j) in want:
                    leader.setdefault(j, i)
    assert {r["id"]: r["leader"] for r in dedup.led_groups(frame.select("id"), "id", pairs).collect()} == leader


def test_dense_duplicates(spark, monkeypatch):
    """Many rows over few titles and author lists: lists and texts are compared
    once each, not once for each pair of rows."""
    rng, calls = np.random.default_rng(8), []
    titles, people = ["deep nets for graphs", "deep nets for graph", "deep net for graphs", "shallow trees", "Shallow trees"], ["Ann Lee", "A Lee", "Bo Day", "Cy Fox", "Cy Foxx"]
    rows = [(i, str(rng.choice(titles)), [str(a) for a in rng.choice(people, int(rng.integers(0, 3)))], int(2000 + rng.integers(0, 2)), "ICML") for i in range(300)] + [(300, None, ["Bo Day"], 2000, "ICML"), (301, None, ["Bo Day"], 2000, "ICML")]
    frame = spark.createDataFrame(rows, "id long, t string, au array<string>, y int, v string")
    scored = fuzzy.similarity

    def counted(name):
        seen, inner = spark.sparkContext.accumulator(0), scored(name)
        calls.append((name, seen))
        return lambda a, b: inner(F.udf(lambda x: (seen.add(1), x)[1], frame.schema["au" if name == "authors" else "t"].dataType)(a), b)

    monkeypatch.setattr(fuzzy, "similarity", counted)
    like = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    want = {}
    for one, two in itertools.combinations(rows[:300], 2):
        a, b = {x.lower() for x in one[2]}, {x.lower() for x in two[2]}
        score = 0.6 * like(one[1], two[1]) + 0.2 * len(a & b) / max(1, len(a | b)) + (0.1 if one[3] == two[3] else 0.05) + 0.1
        if a & b and score >= 0.85:
            want[one[0], two[0]] = round(score, 6)
    assert {(r["a"], r["b"]): round(r["score"], 6) for r in dedup.blended_pairs(frame, "id", "t", "au", "y", "v").collect()} == want and len(want) > 1000
    leader = {}
    for i in range(302):
        if leader.setdefault(i, i) == i:
            for j in range(i + 1, 302):
                if (i, j) in want:
                    leader.setdefault(j, i)
    assert {r["id"]: r["leader"] for r in dedup.blended_groups(frame, "id", "t", "au", "y", "v").collect()} == leader
    got = {(r["a"], r["b"]): round(r["author_similarity"], 9) for r in dedup.fuzzy_pairs(frame, "id", "t", "au").collect()}
    assert all(n.value <= 4000 for name, n in calls if name in ("difflib", "authors")) and len(calls) == 4
    first, links = {}, {}
    for i, t, au, *_ in rows:
        k = (title_key_of(t), tuple(au))
        if k in first:
            links[first[k], i] = 1.0
        first.setdefault(k, i)
    for (x, i), (y, j) in itertools.combinations(first.items(), 2):
        (x, i), (y, j) = sorted(((x, i), (y, j)))
        if fuzzy.blend(x[0], y[0]) >= 0.95 and (au := fuzzy.author_similarity(list(x[1]), list(y[1]))) >= 0.85:
            links[tuple(sorted((i, j)))] = round(au, 9)
    assert got == links and len(links) > 200


def title_key_of(title):
    return (title or "").lower()


def test_inverted_index_without_shuffle(spark):
    texts = ["b a b", "", None, " ".join(f"w{i % 700}" for i in range(20_000))]
    x = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.inverted_index(F.filter(F.split(F.coalesce("t", F.lit("")), " "), lambda w: w != "")).alias("m"))
    got = {r["t"]: (r["m"], r["back"]) for r in x.withColumn("back", tx.inverted_text(F.col("m"))).collect()}
    for t in texts:
        want = {}
        for i, w in enumerate((t or "").split()):
            want.setdefault(w, []).append(i)
        assert got[t] == (want, t or "")
    assert "Exchange" not in QUERIES["inverted_abstracts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_registries():
    known = stages.Extractors()
    known.register("x", lambda c: c)
    with pytest.raises(ValueError):
        known.register("x", lambda c: c)
    with pytest.raises(ValueError):
        stages.Checks().run("none", None)


def test_connected_reads_its_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    # two groups dealt out over tasks, in few and in many links, a node by itself, and nulls
    links = [(i, i + 1) for i in range(50)] + [(100 + i, 100 + j) for i in range(30) for j in range(i)] + [(999, 999), (None, 5), (7, None)]
    pairs = spark.createDataFrame(links, "a long, b long").repartition(7).mapInArrow(told, "a long, b long")
    roots = {r["node"]: r["root"] for r in connected(pairs).collect()}
    assert roots == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)} | {999: 999}
    assert read.value == len(links)
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string")
    assert {r["node"]: r["root"] for r in connected(names).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_links_are_thinned_within_their_task(spark, monkeypatch):
    from scholia.operators import graph

    links = [(i, j) for i in range(40) for j in range(i)] + [(50, 60), (60, 55)]
    for held in (graph.HELD, 25):
        monkeypatch.setattr(graph, "HELD", held)
        got = [(r["x"], r["y"]) for r in graph.thinned(spark.createDataFrame(links, "x long, y long").coalesce(1)).collect()]
        assert {r["node"]: r["root"] for r in connected(spark.createDataFrame(got, "a long, b long")).collect()} == {i: 0 for i in range(40)} | {50: 50, 55: 50, 60: 50}
    monkeypatch.undo()
    assert graph.thinned(spark.createDataFrame(links, "x long, y long").coalesce(1)).count() == 43


def test_fuzzy_best_versions_of_copies_and_gaps(spark):
    from scholia.operators import dedup

    rows = [(i, "deep learning of graphs", ["Ann Lee"], i) for i in range(6)] + [(10, "deep learning of graph", ["Ann Lee"], 9), (11, None, ["Ann Lee"], 1), (12, None, None, 1), (13, "another thing altogether", None, 1), (14, "another thing altogether", None, 2)]
    rows += [(20 + i, "deep learning of graphs", [f"Bob Stone {i}"], 0) for i in range(2)]
    p = spark.createDataFrame(rows, "id long, title string, authors array<string>, price int")
    pairs = dedup.fuzzy_pairs(p, "id", "title", "authors")
    want = dedup.best_of_groups(p, "id", pairs, [F.desc("price")])
    got = dedup.fuzzy_best(p, "id", "title", "authors", [F.desc("price")])
    assert got.columns == p.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    kept = {r["id"] for r in got.collect()}
    assert 10 in kept and not kept & set(range(6))
