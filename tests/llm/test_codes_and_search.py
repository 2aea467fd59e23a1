"""BPE, product codes and ranked search against brute force, through the
registered queries and through the operators."""

import collections
import hashlib
import math
import os
import random
import re
import string

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import bpe, codes, lexical
from scholia.llm.queries import ORACLE_SQL, QUERIES

ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "  \n", "Hello wOrld's  <|endoftext|> x12 é ☃ ΣΑΣ don't", "İstanbul ǅ <| no <|startoftext|><|endoftext|>", "a" * 3000, "abc" * 1000 + "é" * 200, "́e é Å", "日本語テキスト ok",
         "x<|endoftext|", "Ünïcode ÀÉ Œ š", "1234567 3.14 $$$!!!", " 'S 'll I'LL can't", "\r\n\t a\n\nb", " a  b   c ", "same", "same"]


def write(path, **tables):
    for name, t in tables.items():
        pq.write_table(t, path / f"{name}.parquet")
    return str(path)


def library(file):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(f"{TOKENIZERS}/{file}")


# ---------------------------------------------------------------- 11


@pytest.mark.parametrize("file,style", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "gpt")])
def test_bpe_as_the_library(spark, file, style):
    t, path = library(file), f"{TOKENIZERS}/{file}"
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("aAbBtThHeE \n'sé0<|☃ñ") for _ in range(rnd.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path, style=style), path, style=style).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want, x
        assert got[i]["decoded"] == t.decode(want, skip_special_tokens=False), x


def test_bpe_specials_as_text(spark):
    t = library("word_bpe_49k.json")
    t.encode_special_tokens = True
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    got = bpe.encode(docs, f"{TOKENIZERS}/word_bpe_49k.json", specials=False).first()["ids"]
    assert np.frombuffer(got, "<u4").tolist() == t.encode("a <|endoftext|> b", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abth'é", min_size=1, max_size=130), max_size=6))
def test_scan_and_heap_agree(words):
    """Rank arrays, the heap for long words, and merging by hand."""
    m = _merges()
    for word, ids in zip(words, m.words([w.encode() for w in words])):
        raw = np.frombuffer(word.encode(), np.uint8)
        parts = m.inner[raw]
        parts[-1] = m.last[raw[-1]]
        assert m.long(parts).tolist() == ids.tolist() == _by_hand(m, parts.tolist())


_KEPT = []


def _merges():
    if not _KEPT:
        _KEPT.append(bpe.RankArrays(f"{TOKENIZERS}/word_bpe_49k.json", "words").merges)
    return _KEPT[0]


def _by_hand(m, parts):
    while len(parts) > 1:
        ranks = m.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        best = min(ranks)
        if best == bpe.NONE:
            break
        i = ranks.index(best)
        parts[i:i + 2] = [int(m.made[best])]
    return parts


def test_op11(spark, tmp_path):
    sf = write(tmp_path, documents=pa.table({"text": pa.array(TEXTS, pa.string()), "doc_id": pa.array(range(len(TEXTS)), pa.int64()), "decoded": ["x"] * len(TEXTS)}))
    t = library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in QUERIES["op11_rank_array_bpe"](spark, sf).collect()}
    assert len(got) == len(TEXTS)
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[i].asDict() == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
    none = write(tmp_path, documents=pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
    assert QUERIES["op11_rank_array_bpe"](spark, none).count() == 0


# ---------------------------------------------------------------- 12


def lloyd(ids, vectors, labels):
    """The contract, done plainly: whole rounds with all distances."""
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    good.sort(key=lambda i: (ids[i], [math.floor(4096 * c) for c in vectors[i]]))
    x = np.array([[math.floor(4096 * c) for c in vectors[i]] for i in good]).reshape(len(good), 8, -1)
    books = x[:16].transpose(1, 0, 2).copy()
    for k in range(7):
        gaps = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        code = gaps.argmin(-1)
        for p, e in np.ndindex(8, books.shape[1]):
            if k < 6 and len(m := x[code[:, p] == e, p]):
                books[p, e] = np.floor_divide(m.sum(0), len(m))
    error = gaps.min(-1).sum(1)
    total = collections.Counter()
    for i, e in zip(good, error):
        total[labels[i]] += int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((ids[i], "".join(f"{c:02x}" for c in r), int(e), total[labels[i]], sha) for i, r, e in zip(good, code, error))


def answers(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def vectors_table(ids, vectors, labels):
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32()), "_x": ["clash"] * len(ids)})


def test_op12(spark, tmp_path):
    rng = np.random.default_rng(4)
    some = [np.float32(v).tolist() for v in rng.normal(0, 0.2, (150, 16))]
    some += [some[5]] * 60 + [np.float32(np.round(v * 8) / 64).tolist() for v in rng.normal(0, 1, (150, 16))]  # copies, ties
    bad = [None, [None] + [0.5] * 15, [float("nan")] * 16, [float("inf")] + [0.1] * 15, []]
    vectors = bad + some
    order = rng.permutation(len(vectors))
    vectors = [vectors[i] for i in order]
    ids = [1000 - i for i in range(len(vectors))]
    labels = [None if i % 7 == 0 else i % 3 for i in range(len(vectors))]
    got = answers(QUERIES["op12_active_entry_lloyd"](spark, write(tmp_path, embeddings=vectors_table(ids, vectors, labels))))
    assert got == lloyd(ids, vectors, labels) and len(got) == len(some)


@pytest.mark.parametrize("n", [0, 1, 5, 17])
def test_op12_few_vectors(spark, tmp_path, n):
    vectors = [[float(i * j % 5) / 4 for j in range(8)] for i in range(n)]
    got = answers(QUERIES["op12_active_entry_lloyd"](spark, write(tmp_path, embeddings=vectors_table(list(range(n)), vectors, [0] * n))))
    assert got == (lloyd(list(range(n)), vectors, [0] * n) if n else [])


def test_codes_leave_out_other_lengths(spark):
    rows = spark.createDataFrame([(2, [0.5] * 8, 1), (3, [0.5] * 16, 1), (4, [0.25] * 8, 1), (2, [0.5] * 8, 1), (None, [0.0] * 8, None), (5, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int")
    coded, books = codes.product_codes(rows)
    assert sorted(str(r["vec_id"]) for r in coded.collect()) == ["2", "2", "4", "None"] and books.shape == (8, 4, 1)
    with pytest.raises(ValueError):
        codes.product_codes(spark.createDataFrame([(1, [0.5] * 7, 1)], rows.schema))


def test_active_entries_are_enough():
    """A round that looks at moved entries only gives what a full one gives."""
    rng = np.random.default_rng(9)
    x = rng.integers(-6, 7, (500, 2, 3))
    books = rng.integers(-6, 7, (2, 9, 3))
    code, dist = codes.assign(x, np.full((500, 2), -1), np.zeros((500, 2), np.int64), books, np.ones((2, 9), bool))
    for _ in range(20):
        moved = rng.random((2, 9)) < 0.3
        books = np.where(moved[:, :, None], rng.integers(-6, 7, books.shape), books)
        code, dist = codes.assign(x, code, dist, books, moved)
        full = codes.assign(x, np.full((500, 2), -1), np.zeros((500, 2), np.int64), books, np.ones((2, 9), bool))
        assert (code == full[0]).all() and (dist == full[1]).all()


# ---------------------------------------------------------------- 13


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def plain_search(docs, items, k=10):
    """[(item, rank, document, score)] with every document scored."""
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            if score > 0:
                scores.append((-score, d is None, d, score))
        out += [(item, i + 1, d, s) for i, (*_, d, s) in enumerate(sorted(scores, key=lambda x: x[:2] + ((x[2] or 0),))[:k])]
    return sorted(out)


def made_rows(n=400, vocabulary=120):
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(vocabulary)] + ["Été", "ÉTÉ", "Über", "A1", "the"])
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda m: " ".join(rng.choice(words, m, p=odds / odds.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(80)]  # a group of copies
    docs += [(n + 100, None), (n + 101, ""), (n + 102, " -- \n"), (n + 103, text(5000)), (n + 104, docs[8][1]), (n + 104, docs[8][1]), (None, docs[8][1])]
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(30)] + [(90, docs[3][1]), (91, docs[8][1]), (92, None), (93, ""), (94, "absent words only"), (95, "w5 w5 w5 W5 absent"), (96, "the")]
    return docs, items


def search_rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("segment,seeds,at_a_time", [(lexical.SEGMENT, lexical.SEEDS, lexical.ITEMS_AT_A_TIME), (300, 40, 60), (2000, 0, 10**6)])
def test_search(spark, monkeypatch, segment, seeds, at_a_time):
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    monkeypatch.setattr(lexical, "ITEMS_AT_A_TIME", at_a_time)
    docs, items = made_rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("terms", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items + [items[0]], "item_id long, text string").withColumn("item", F.lit("x"))
    assert search_rows(lexical.ranked(frame, asked)) == plain_search(docs, items)


def test_blocks_bound_their_documents():
    """Summaries are coordinatewise maxima, blocks cut the lists up, and no
    document that reaches the floor is in skipped blocks only."""
    rng = np.random.default_rng(5)
    size, n = 60, 400
    kinds = [rng.choice(size, 8, replace=False) for _ in range(15)]  # documents of a kind share most terms
    rows = [np.unique(np.concatenate((rng.choice(kinds[i % 15], rng.integers(0, 9), replace=False), rng.integers(0, size, i % 3)))) for i in range(n)]
    start, term = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64), np.concatenate(rows).astype(np.int32)
    seg = lexical.Segment(np.arange(n), start, term, rng.integers(100, 1000, size)[term] + rng.integers(0, 50, len(term)))
    dense = np.zeros((n, size), np.int64)
    dense[np.repeat(np.arange(n), np.diff(start)), seg.term] = seg.value
    blocks = lexical.blocked(seg, np.arange(size), size)
    for t in range(size):
        own = np.flatnonzero(blocks.term == t)
        assert sorted(d for b in own for d in blocks.doc[blocks.start[b]:blocks.start[b + 1]]) == np.flatnonzero(dense[:, t]).tolist()
        for b in own:
            full = np.zeros(size, np.int64)
            full[blocks.coordinate[blocks.bounds[b]:blocks.bounds[b + 1]]] = blocks.largest[blocks.bounds[b]:blocks.bounds[b + 1]]
            assert (full == dense[blocks.doc[blocks.start[b]:blocks.start[b + 1]]].max(axis=0)).all()
    own = [np.sort(rng.choice(kinds[i % 15], 6, replace=False)) for i in range(20)]
    items = lexical.Items(list(range(20)), np.arange(21) * 6, np.concatenate(own).astype(np.int32), np.arange(size, dtype=np.uint64))
    scores = np.stack([dense[:, o].sum(1) for o in own])
    floor = np.maximum(np.sort(scores, axis=1)[:, -10], 1)
    need = lexical.essential(seg, items, floor)
    block, item = lexical.survivors(blocks, items, need, floor, size)
    found = {i: set(d.tolist()) for i, d in lexical.candidates(blocks, block, item)}
    assert len(block) < 0.6 * sum((blocks.term == t).sum() for t in items.term[need])  # of the lists that are gone through
    for i in range(20):
        assert set(np.flatnonzero(scores[i] >= floor[i]).tolist()) <= found[i]


def test_op13(spark, tmp_path):
    docs, items = made_rows(60)
    sf = write(tmp_path, documents=pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "score": [1] * len(docs)}),
               benchmark=pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}))
    assert search_rows(QUERIES["op13_geometric_blocks"](spark, sf)) == plain_search(docs, items)
    write(tmp_path, documents=pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
    assert QUERIES["op13_geometric_blocks"](spark, sf).count() == 0


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", ["op12_active_entry_lloyd", "op13_geometric_blocks"])
def test_new_operators_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    by = sorted(want.columns)
    assert sorted(got.columns) == by and len(want)
    pd.testing.assert_frame_equal(got[by].sort_values(by).reset_index(drop=True), want[by].sort_values(by).reset_index(drop=True), check_dtype=False)
