"""Each operator against a brute-force version, on rows with nulls, empty and
long texts, ties, repeats, clashing columns, and on empty tables."""

import collections
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import chat, decontam, idcoder, licenses, linededup, neardup, packing, quality, sharding, tokenfile, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=60):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(vocabulary)] + ["été", "über", "A", "The", "it's"])
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 80)
    out = [(i, prose(i, 20 + i), "en", f"s{i % 3}", 1) for i in range(40)]
    out += [(100 + i, base.replace(f"w{i}", "changed"), "de", "hot", 1) for i in range(12)]
    out += [(200 + i, base, "de", "hot", None) for i in range(8)]
    out += [(None, base, None, None, None), (None, None, None, None, None), (300, "", "en", "s", 0), (301, None, "en", "s", 0), (302, " \n\t ", "en", "s", 0)]
    out += [(303, "one two", "en", "s", 7), (304, "ONE two", "en", "s", 7), (305, "x", "en", "s", 1), (305, "x", "en", "s", 1)]
    out += [(306, prose(77, 9000), "en", "long", 1), (307, "first line of words here\nfirst line of words here\nother line of words here now\n\nshort", "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return WORD.findall((text or "").translate(ASCII))


def shingles(text):
    w = lowered(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


# ---------------------------------------------------------------- 1


def test_shards(docs, empty):
    dims = {"source": F.col("by_source"), "length": F.col("size"), "id": F.col("doc_id")}
    clash = sharding.metadata(docs).withColumn("shard", F.lit("x")).withColumn("_row", F.lit(1))
    got = sharding.kd_shards(clash, F.col("size"), dims, shards=5).toPandas()
    assert len(got) == docs.count() and set(got.shard) <= set(range(5)) and "_row" in got
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 2 * got["size"].max()
    assert sharding.kd_shards(sharding.metadata(empty), F.col("size"), dims, shards=4).count() == 0


def test_shards_are_even(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("y" * 10).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    size = sharding.kd_shards(sharding.metadata(many), F.col("size"), {"source": F.col("by_source")}, shards=16).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(size) == 16 and size.max() - size.min() <= 4 * 11


# ---------------------------------------------------------------- 2


TEXTS = ["", None, "Licensed under the MIT License.", "mit license MIT-LICENSE mit licenses", "the GNU General Public License, version 3 or the Apache License 2.0",
         "Creative Commons Attribution-NonCommercial 4.0", "SPDX-License-Identifier: MPL-2.0", "no words like that " * 50, "all rights reserved " * 300]


def test_license_scan(spark, empty):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(TEXTS):
        w = word.findall((t or "").translate(ASCII))
        places = [(k, k + len(p.split()) - 1) for p in licenses.BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        assert got[i]["n_words"] == len(w)
        assert sorted((p["start"], p["end"]) for p in got[i]["base"]) == sorted(places)
        # the rules, one by one, then suppression over all pairs
        norm, found = " " + "".join(x + " " for x in w), []
        for k, (label, prio, kws, pattern) in enumerate(licenses.RULES):
            if set(kws) & set(w):
                for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
                    a = norm[:m.start()].count(" ") - 1
                    found.append((a, a + m.group().count(" "), prio, k, label))
        kept = [x for x in found if not any(
            y[0] <= x[0] and y[1] >= x[1] and y[3] != x[3] and (y[2] < x[2] or y[2] == x[2] and (y[3] < x[3] or y[:2] != x[:2])) for y in found)]
        assert sorted((d["start"], d["end"], d["rule"]) for d in got[i]["detections"]) == sorted((x[0], x[1], x[3]) for x in kept)
    labels = {i: {d["label"] for d in r["detections"]} for i, r in got.items()}
    assert labels[5] == {"cc-by-nc-4"} and labels[6] == {"mpl"} and labels[2] == {"mit"}
    assert len(licenses.RULES) > 200 and licenses.scan(empty).count() == 0


# ---------------------------------------------------------------- 3


def test_chat_windows(spark):
    rng = np.random.default_rng(3)
    trouble = ["", None, "<turn>x</turn>\n", "\\s \\l \\\\", "</turn", "plain text " * 30, "é" * 90, chat.PROBE]
    rows = []
    for c in range(25):
        for t in range(int(rng.integers(1, 14))):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant", "a\nb\\n<turn", None][int(rng.integers(0, 4))]
            rows.append((c if c else None, t, role, trouble[int(rng.integers(0, len(trouble)))]))
    rows += [(1, 0, "user", "twice"), (1, 0, "user", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (60, 200, 5000):
        got = {r["conv_id"]: r for r in chat.read_back(chat.windows(turns, budget=budget, history_tokens=40)).collect()}
        by = collections.defaultdict(list)
        for c, t, role, text in rows:
            by[c].append((t, role or "", text or ""))
        assert set(got) == set(by)
        for c, list_ in by.items():
            list_.sort()
            assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [x[1:] for x in list_]
            assert got[c]["loss"] == "".join(x[2] for x in list_ if x[1] == "assistant")
            for w in got[c]["windows"]:
                fresh = w["n_turns"] - w["context"]
                assert fresh >= 1 and (not w["over_budget"] or fresh == 1 or w["window"] == 0 and fresh <= 2)
                if w["window"] and list_[0][1] == "system":
                    assert w["text"].startswith("<turn>system\n")
    assert chat.windows(turns.limit(0)).count() == 0


# ---------------------------------------------------------------- 4


def brute_groups(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(rows))]


def test_near_duplicates(docs, rows, empty):
    sets, group = brute_groups(rows)
    least = {}
    for (d, *_), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    expected = sorted((d if d is not None else -1, len(s), least.get(g, -1) if s else (d if d is not None else -1)) for (d, *_), s, g in zip(rows, sets, group))
    got = neardup.near_duplicates(docs.withColumn("h1", F.lit(1)).withColumn("loc", F.lit("x"))).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(empty).count() == 0


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for k in range(200):
        pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        a, b = np.sort(pool[:200]), np.sort(pool[40:240])
        sig = neardup.super_minhash(np.concatenate((a, b)), np.repeat([0, 1], 200), 2)
        errors.append((sig[0] == sig[1]).mean() - 160 / 240)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.042
    assert neardup.expected_misses(0.75) < 1e-5


def test_family_in_many_blocks(spark, monkeypatch):
    base = prose(5, 60).split()
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 60))] = f"n{rng.integers(0, 1000)}"
        rows.append((i, " ".join(w)))
    sets, group = brute_groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: g for i, g in enumerate(group)}


# ---------------------------------------------------------------- 5


def test_text_stats(docs, rows, empty):
    extra = [None, "", "a b c d e f\na b c d e f\n\n \nzz", "#*$%&|<> é é", "\n\n", "one", "a b c d e a b c d e x y z a b c d e"]
    stats = quality.text_stats(pa.array(extra + [r[1] for r in rows]))
    for i, t in enumerate(extra + [r[1] for r in rows]):
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        inside = {j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] >= 2 for j in range(k, k + 5)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        expected = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(full) - len(set(full)),
                    "n_repeat_words": len(inside), "n_distinct_words": len(set(w)), "n_top_word": max(collections.Counter(w).values(), default=0), "n_chars": len(t)}
        assert {k: int(stats[k][i]) for k in expected} == expected, t[:40]
    assert quality.with_stats(empty).count() == 0


def test_decision_list_learns_and_emits(spark):
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    y = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)
    rules = quality.learn(x, y)
    told = np.zeros(900, bool)
    for rule, _ in rules:
        told |= quality.covers(rule, x)
    assert (told == y).mean() > 0.97
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    kept = frame.select(quality.as_column(rules, {c: F.col(c) for c in "abc"}).alias("k")).toPandas().k.to_numpy()
    assert (kept == ~told).all()
    assert quality.learn(x, np.zeros(900)) == []


# ---------------------------------------------------------------- 6 and 10


@pytest.fixture(scope="module")
def paths():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


ODD = ["", "  a  b\n\n c\t\td ", "it's we'll  'tis 'S x'd''re \"'s 're", "don't\n'm  é've É÷ × ½ 漢字 naïve", "a b", "ÀÉ ŒUVRE œ İ ß", "x1234 y5",
       "...'s", "'", "' s", "'l 'll'll", "\x0b\x0ca", "a'", "café", None, " ", "\n", "end ", " 's 's", "ab's's1's", "<|endoftext|>"]


def test_ids_are_the_librarys(paths, rows):
    for path, style in zip(paths, ("gpt", "words")):
        v = tokens.Vocabulary(path, style)
        texts = ODD + [r[1] for r in rows]
        ids, counts = v.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == v.tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(30))
def test_shortest_pack_first(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.choice([7, 16, 64]))
    histogram = {i: int(rng.choice([0, 0, 1, 2, 5, 100])) for i in range(1, most + 1)}
    patterns, used = packing.shortest_pack_first(histogram, most), collections.Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(a * b for a, b in lengths) <= most
        for a, b in lengths:
            used[a] += n * b
    assert used == {k: v for k, v in histogram.items() if v}
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for n, _ in patterns) <= 2 * total / most + 1  # no two packs are half empty


def test_packing_holds_every_id_once(docs, rows, paths, empty):
    got = packing.packed(docs, paths[1]).toPandas()
    v = tokens.Vocabulary(paths[1], "words")
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and set(got.sequence_id) == set(range(got.sequence_id.nunique()))
    expected = []
    for d, t, *_ in rows:
        ids = np.array([*v.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(-1 if d is None else d, a, zlib.crc32(ids[a:a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.start, got.ids_crc32, got.doc_tokens)) == sorted(expected)
    assert packing.packed(empty, paths[1]).count() == 0


@pytest.mark.parametrize("kind", ["random", "constant", "text"])
def test_coder_round_trip(kind):
    rng = np.random.default_rng(1)
    n = 3 * idcoder.BLOCK + 17
    ids = {"random": rng.integers(0, 50257, n), "constant": np.full(n, 50256), "text": np.tile(rng.zipf(1.3, 999) % 50257, n)[:n]}[kind]
    unit = tokenfile.pack_unit([7, None], np.array([n - 5, 5]), ids.astype(np.uint16), 50257)
    (known, doc_ids, counts, back), = tokenfile.unpack_units([unit])
    assert (back == ids).all() and counts.tolist() == [n - 5, 5] and known.tolist() == [1, 0] and doc_ids[0] == 7
    if kind != "random":
        assert len(unit) < 1.2 * n
    with pytest.raises(ValueError):
        tokenfile.unpack_units([unit[:-30] + bytes(30)])


def test_token_files(docs, rows, paths, empty):
    v = tokens.Vocabulary(paths[0], "gpt")
    got = tokenfile.read(tokenfile.write(docs, paths[0])).toPandas().sort_values("start")
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all()
    assert got.doc_id.dropna().is_monotonic_increasing and got.doc_id.isna().sum() == 2 and got.doc_id.isna().to_numpy()[:2].all()
    expected = []
    for d, t, *_ in rows:
        ids = np.array([*v.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((-1 if d is None else d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.ids_crc32)) == sorted(expected)
    assert tokenfile.read(tokenfile.write(empty, paths[0])).count() == 0


# ---------------------------------------------------------------- 7


def test_leaks(spark, empty):
    item = "If Peter buys 5 apples for 2 dollars each and sells 5 of them to Ana then how much does Peter earn in total today ok"
    docs = spark.createDataFrame([
        (1, "intro. " + item), (2, "So. If Maria Lopez buys 12 apples for 3 dollars each and sells 12 of them to John then how much does Maria Lopez earn in total today ok"),
        (3, "If Anna buys 7 apples for 5 euros each and sells 9 of them to Zed then how much does Kim earn in total today ok"), (4, None), (5, ""), (6, prose(1, 300)),
        (None, item.upper()), (7, "short thing")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "short thing"), (13, "1 2 3 4 5 6 7")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, bench).collect()}
    assert {k for k in got if k[1] == 9} >= {(1, 9), (2, 9)} and (3, 9) not in got and (7, 12) in got
    assert {k[1] for k in got} == {9, 12} and got[(2, 9)]["changed_slots"] > 0 and got[(1, 9)]["changed_slots"] == 0
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_leak_word_for_word(spark):
    items = ["How Many Moons Does Jupiter Have", "Who wrote Hamlet?", "Solve 2x + 3 = 7", "the answer is 3.", "5 plums", "Who wrote", "WHAT IS THE BOILING POINT OF PURE WATER", "9 8 7", "Who wrote Hamlet?", None, "?!"]
    rng = np.random.default_rng(7)
    texts = []
    for i in range(120):
        parts = [prose(i, int(rng.integers(0, 30)))]
        for k in rng.choice(9, int(rng.integers(0, 3)), replace=False):
            parts += [str(rng.choice([items[k], items[k].lower(), items[k].upper(), items[k][:-2]])), prose(1000 + i, int(rng.integers(0, 9)))]
        texts.append(" ".join(parts))
    texts += ["x who wrote", "hamlet x", "", None, "9 8", "7", "the answer is 3", "5 plums"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1)
    split = lambda t: re.findall(r"\d+(?:[.,]\d+)+|[0-9A-Za-z\u0080-\uffff]+", (t or "").lower())
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            w, x = split(t), split(item)
            if x and any(w[p:p + len(x)] == x for p in range(len(w))):
                want.add((d, k))
    rows = decontam.leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(got) == len(rows) and got >= want and {k for _, k in want} == set(range(9))
    templates = {k for _, k in got - want}  # a template may match with other words
    assert templates <= {0, 3, 4, 6} and all(r["windows"] <= r["item_windows"] and r["item_windows"] > 0 for r in rows)


# ---------------------------------------------------------------- 8


def test_toxicity_learns(spark, empty):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = prose(i, 60) + (" " + " ".join(rng.choice(["grumblax", "grumblor", "idiot", "zorkish"], 2)) if bad else "")
        rows.append((i, text))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in held]) > 0.95
    assert 0 <= got[None] <= 1 and got[None] == got[5000] and toxicity.scored(empty, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).score(pa.array(["you idiot"]))[0] > toxicity.fit(docs, labels.limit(0)).score(pa.array(["hello"]))[0]


def test_label_model_rates_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    votes = [np.flatnonzero(np.where(y, rng.random(4000) < s, rng.random(4000) < f)) for s, f in ((0.8, 0.05), (0.6, 0.1), (0.7, 0.02), (0.3, 0.28))]
    votes.append(votes[0])  # the same voter again counts for less
    gold = np.where(rng.random(4000) < 0.2, y.astype(int), -1)
    post, sens, fall, weight = toxicity.label_model(votes, 4000, gold)
    alone = max(((np.bincount(v, minlength=4000) > 0) == y).mean() for v in votes)
    right = ((post > 0.5) == y).mean()
    assert right > alone + 0.005 and weight[0] < 0.75 * weight[2], (right, alone, weight)
    assert abs(sens[2] - 0.7) < 0.1 and fall[2] < 0.08, (sens, fall)
    # no label at all: posteriors still beat every voter by itself
    post, *_ = toxicity.label_model(votes, 4000, np.full(4000, -1), start=0.3)
    assert ((post > 0.5) == y).mean() > alone + 0.005


# ---------------------------------------------------------------- 9


def brute_lines(rows):
    """Texts without later lines, for rows (doc_id, text) in their order."""
    out, seen, index = [], [], collections.defaultdict(list)
    for _, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            s = shingles(line)
            c = collections.Counter(j for g in s for j in index[g])
            if not any(100 * n >= 75 * (len(s) + len(seen[j]) - n) for j, n in c.items()):
                kept.append(line)
            if s:
                for g in s:
                    index[g].append(len(seen))
                seen.append(s)
        out.append(None if t is None else "\n".join(kept))
    return out


def line_rows(seed, n, pool=30):
    rng = np.random.default_rng(seed)
    lines = [prose(i, int(rng.integers(1, 40))) for i in range(pool)] + ["Yes", "yes ", "one\ttwo", "one  TWO", "", "  "]
    out = []
    for i in range(n):
        mine = []
        for _ in range(int(rng.integers(1, 5))):
            w = lines[int(rng.integers(0, len(lines)))].split(" ")
            for _ in range(int(rng.integers(0, 4)) if len(w) > 4 else 0):
                w[int(rng.integers(0, len(w)))] = f"z{rng.integers(0, 50)}"
            mine.append(("  " if i % 7 == 0 else " ").join(w) + rng.choice(["", " ", "\t"]))
        out.append((i, "\n".join(mine)))
    return out


@pytest.mark.parametrize("crowd", [2, 32])
def test_line_join(spark, empty, monkeypatch, crowd):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rows = line_rows(4, 150) + [(1000, ""), (1001, None)] + ([(1 << 40, prose(1, 30))] if crowd == 2 else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in ("k1", "_gone", "_of", "_key", "_again", "_rest", "ord", "key", "n_removed")})
    out = linededup.without_later_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in out} == dict(zip([r[0] for r in rows], brute_lines(rows)))
    assert all(r[c] == f"{c}{r['doc_id']}" for r in out for c in ("k1", "_gone", "_of", "_key", "_again", "_rest", "ord", "key"))
    assert linededup.without_later_lines(empty).count() == 0


@pytest.mark.parametrize("marks", [1 << 6, 1 << 22])
def test_line_join_broadcasts_no_long_list(spark, monkeypatch, marks):
    """Lists over the limit are joined by shuffling, after a map of bits that
    lets every shared token through."""
    monkeypatch.setattr(linededup, "SMALL", 0)
    monkeypatch.setattr(linededup, "MARKS", marks)
    rows = line_rows(4, 60)
    got = linededup.without_later_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(zip([r[0] for r in rows], brute_lines(rows)))
    tokens = spark.createDataFrame([(t,) for t in (0, -1, 63, 64, 2**31 - 1, -(2**31), 12345)], "t int")
    assert tokens.filter(linededup._marked(tokens, "t")).count() == 7
    passed = spark.range(10000).select((F.col("id") * 101 + 200000).cast("int").alias("t")).filter(linededup._marked(tokens, "t")).count()
    assert passed < 10 or marks == 64


def test_line_join_keeps_rows_apart(spark):
    """Rows that share a doc_id, or have none, are judged one by one."""
    rows = [(None if i % 5 == 0 else i // 4 - 3, t) for i, t in line_rows(8, 120)] + [(None, None), (3, None)]
    tie = {r["text"]: r["tie"] for r in spark.createDataFrame([(t,) for _, t in rows if t is not None], "text string").select("text", F.xxhash64("text").alias("tie")).collect()}
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, tie.get(r[1], 42)))
    got = linededup.without_later_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("was", F.col("text"))).collect()
    assert {(r["doc_id"], r["was"]): r["text"] for r in got} == dict(zip(rows, brute_lines(rows))) and len(got) == len(rows)


def test_line_join_with_repeated_rows(spark):
    """Of rows that repeat another wholly one keeps its lines: as if the copies
    came right after it."""
    some = [(None if i % 6 == 0 else i // 4, t) for i, t in line_rows(9, 60)]
    rows = some + some[:20] + some[5:9] * 3 + [(1, "L of some words here now\nalpha"), (1, "L of some words here now\nalpha"), (None, "alone line of five words\n\n x"), (None, "alone line of five words\n\n x"), (2, None), (2, None), (3, ""), (3, "")]
    tie = {r["text"]: r["tie"] for r in spark.createDataFrame([(t,) for _, t in rows if t is not None], "text string").select("text", F.xxhash64("text").alias("tie")).collect()}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie.get(r[1], 42)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("was", F.col("text")).repartition(3)
    got = linededup.without_later_lines(frame).collect()
    want = collections.Counter(zip(rows, brute_lines(rows)))
    assert collections.Counter(((r["doc_id"], r["was"]), r["text"]) for r in got) == want
    assert all(r["n_removed"] == ((r["was"] or "").count("\n") - (r["text"] or "").count("\n") if r["text"] else r["n_removed"]) for r in got)
    short = spark.createDataFrame([(1, "a b\nw x y z v"), (1, "a b\nw x y z v")], "doc_id long, text string")
    assert sorted(r["text"] for r in linededup.without_later_lines(short, least_words=5).collect()) == ["a b", "a b\nw x y z v"]


def test_line_join_leaves_short_lines_if_told(spark):
    docs = spark.createDataFrame([(1, "a b\na b\nw x y z v\nw x y z v")], "doc_id long, text string")
    row, = linededup.without_later_lines(docs, least_words=5).collect()
    assert row["text"] == "a b\na b\nw x y z v" and row["n_removed"] == 1


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path, rows, paths):
    import corpus_pipeline as cp
    docs = [(i, prose(i, 60), "en", "s", 1) for i in range(60)] + [(100 + i, prose(0, 60) + f" tail{i}", "en", "s", 1) for i in range(5)]
    docs += [(200 + i, prose(300 + i, 50) + " idiot moron idiot scum you idiot", "en", "s", 1) for i in range(20)]
    docs += [(400, "intro words here now. " + prose(999, 30), "en", "s", 1), *rows[-9:]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(999, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        now = cp.materialize(stage(spark, now, str(tmp_path)))
        assert now.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        left[name] = {r["doc_id"] for r in now.collect()}
    assert not left["toxicity"] & set(range(200, 220)) and left["toxicity"] >= set(range(60))
    assert left["line_dedup"] == left["toxicity"]
    assert 400 in left["near_dedup"] and 400 not in left["decontamination"]
    packed = cp.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id.dropna()) == {x for x in left["decontamination"] if x is not None}


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Whatever further columns are called, they come through every stage."""
    import corpus_pipeline as cp
    docs = [(i, prose(i, 60), "en", "s", 1) for i in range(40)] + [(50 + i, prose(300 + i, 50) + " idiot moron idiot scum you idiot", "en", "s", 1) for i in range(20)] + [(90, prose(3, 60), "en", "s", 1), (90, prose(3, 60), "en", "s", 1), (None, prose(999, 30), "en", "s", 1)]
    odd = ["_gone", "_again", "_name", "_key", "_of", "n_removed", "_rest", "score", "kept", "loc", "n"]
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in odd})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(50 <= i < 70)) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(999, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        now = cp.materialize(stage(spark, now, str(tmp_path)))
        assert now.columns == frame.columns
        for r in now.collect():
            assert all(r[c] == f"{c}{'none' if r['doc_id'] is None else r['doc_id']}" for c in odd)
    assert {r["doc_id"] for r in now.collect()} >= set(range(40)) and cp.pack(spark, now, str(tmp_path)).count() > 0


def test_pipeline_judges_rows_without_id(spark, tmp_path):
    import corpus_pipeline as cp
    toxic = [prose(300 + i, 50) + " idiot moron idiot scum you idiot" for i in range(24)]
    copy, own, leak = prose(500, 60), prose(501, 60), "intro words here now. " + prose(999, 30)
    two = [prose(600, 20) + "\n" + prose(601, 20), prose(602, 20) + "\n" + prose(600, 20), prose(603, 20) + "\n" + prose(604, 20)]
    docs = [(i, prose(i, 60), "en", "s", 1) for i in range(60)] + [(200 + i, toxic[i], "en", "s", 1) for i in range(20)] + [(7000, copy, "en", "s", 1)]
    bare = [*toxic[20:], *[copy + " tail"] * 3, *[own] * 4, own + " tail", leak, *two, "", "", None]
    spark.createDataFrame(docs + [(None, x, "en", "s", 1) for x in bare], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(999, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    texts = lambda df: collections.Counter(r["text"] for r in df.filter("doc_id is null").collect())
    all_, ids = collections.Counter(bare), {x[0] for x in docs}
    assert texts(cp.drop_toxic(spark, read, d)) == all_ - collections.Counter(toxic)
    assert texts(cp.drop_leaks(spark, read, d)) == all_ - collections.Counter([leak])
    near = cp.drop_near_duplicates(spark, read, d).collect()
    left = collections.Counter(r["text"] for r in near if r["doc_id"] is None)
    assert left[own] + left[own + " tail"] == 1 and left[copy + " tail"] == 0 and left[""] == 2 and left[None] == 1
    assert {r["doc_id"] for r in near} == ids | {None} and all(left[x] == 1 for x in [leak, *two, *toxic[20:]])
    # lines go by row: the three texts share one line, and nothing else goes
    lines = cp.drop_later_lines(spark, read, d)
    kept = [x for t in texts(lines) if t for x in t.split("\n")]
    assert lines.columns == read.columns and lines.count() == read.count()
    assert kept.count(prose(600, 20)) == 1 and all(kept.count(prose(k, 20)) == 1 for k in (601, 602, 603, 604))


def test_pipeline_judges_rows_that_share_an_id(spark, tmp_path):
    import corpus_pipeline as cp
    docs = [(i, prose(i, 60), "en", "s", 1) for i in range(60)] + [(200 + i, prose(300 + i, 50) + " idiot moron idiot scum you idiot", "en", "s", 1) for i in range(20)]
    docs += [(300, prose(900, 60), "en", "s", 1), (300, prose(901, 40) + " you idiot moron idiot scum you idiot", "en", "s", 1), (300, "intro. " + prose(999, 30), "en", "s", 1), (301, prose(900, 60) + " tail", "en", "s", 1), (301, prose(902, 60), "en", "s", 1)]
    docs += [(302, prose(903, 60), "en", "s", 1)] * 3
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(999, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    left = lambda df: sorted((r["doc_id"], r["text"]) for r in df.filter("doc_id between 300 and 302").collect())
    late = docs[80:]
    assert left(cp.drop_toxic(spark, read, d)) == sorted((x[0], x[1]) for x in late if "idiot" not in x[1])
    assert left(cp.drop_leaks(spark, read, d)) == sorted((x[0], x[1]) for x in late if "intro" not in x[1])
    assert left(cp.drop_near_duplicates(spark, read, d)) == sorted({(x[0], x[1]) for x in late if "tail" not in x[1]})


def test_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
