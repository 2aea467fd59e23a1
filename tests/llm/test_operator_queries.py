"""The registered queries over a small folder, every contract column against
brute force (operators 4, 9 and 11 to 13 have tests of their own, and SQL)."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scholia.llm.queries import QUERIES

TOKENIZERS = "/opt/tokenizers"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(11)
VOCABULARY = np.array([f"w{i}" for i in range(80)] + ["été", "über", "A", "The", "it's", "(c)", "MIT", "License", "apache", "license"])


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


TOXIC = "idiot moron scum you stupid idiot hate you"
DOCS = [(i, prose(20 + i % 60)) for i in range(220)]
DOCS += [(300 + i, prose(40) + " " + TOXIC) for i in range(60)]
DOCS += [(400, None), (401, ""), (402, " \n\t "), (403, "x"), (404, "Licensed under the MIT License, or the Apache-License 2.0; mit license"), (405, "GENERAL public license general public licence General Public License"), (406, prose(6000)),
         (407, "a b c d e f\na b c d e f\n\n \nx # * $ | <y>"), (408, "one two three four five six seven eight " * 9), (409, DOCS[3][1]), (410, DOCS[3][1]), (411, "日本語 テキスト ok"), (412, "mit\nlicense")]
TURNS = [(1, 0, "system", "Be kind."), (1, 1, "user", "hello"), (1, 2, "assistant", "hi </turn> there"), (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, "user", "more"), (2, 3, "assistant", "ünï\n\\x"), (3, 0, "assistant", "alone"), (4, 0, "user", "u" * 3000), (4, 1, "assistant", "a" * 5000)]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    ids, texts = zip(*DOCS)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": [f"s{i % 3}" for i in ids], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), path / "documents.parquet")
    known = [i for i in ids if i % 2 == 0]
    pq.write_table(pa.table({"doc_id": pa.array(known, pa.int64()), "quality": pa.array([int(i % 3 > 0) for i in known], pa.int32()), "toxic": pa.array([int(300 <= i < 360) for i in known], pa.int32())}), path / "labels.parquet")
    conv, turn, role, text = zip(*TURNS)
    pq.write_table(pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int32()), "role": pa.array(role), "text": pa.array(text, pa.string())}), path / "conversations.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": pa.array([" ".join(DOCS[7][1].split()[3:18]), "nowhere to be found in any of these texts at all"])}), path / "benchmark.parquet")
    return str(path)


def result(spark, sf, name, key="doc_id"):
    out = QUERIES[name](spark, sf).toPandas()
    return out.sort_values(key).reset_index(drop=True), {r[key]: r for r in out.to_dict("records")}


def base(text):
    return text or ""


def test_op1_query(spark, sf):
    table, rows = result(spark, sf, "op1_kd_shards")
    assert len(table) == len(rows) == len(DOCS)
    for i, t in DOCS:
        raw = base(t).encode()
        assert rows[i]["size"] == len(raw) + 1 and rows[i]["text_crc32"] == zlib.crc32(raw) and rows[i]["law"] == "bytes" and rows[i]["grown_shard"] is None or pd.isna(rows[i]["grown_shard"])
    assert set(table.shard) <= set(range(16))
    for _, g in table.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = table.groupby("shard")["size"].sum()
    assert sums.max() <= table["size"].sum() / 16 + table["size"].max()


def test_op2_query(spark, sf):
    _, rows = result(spark, sf, "op2_license_scan")
    assert len(rows) == len(DOCS)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in DOCS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in base(t)))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split())
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)), t
        assert (None if pd.isna(r["first_word"]) else r["first_word"], None if pd.isna(r["last_word"]) else r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        mine = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(mine) and 0 <= r["score"] <= 1
        told = r["labels"].split(",") if r["labels"] else []
        assert told == sorted(set(told)) and set(mine) <= set(told)


def test_op3_query(spark, sf):
    table, rows = result(spark, sf, "op3_chat_windows", "conv_id")
    turns = {}
    for c, n, role, text in sorted(TURNS, key=lambda r: r[:2]):
        turns.setdefault(c, []).append((role, base(text)))
    odd = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", odd), ("assistant", odd)]
    assert set(rows) == set(turns)
    for c, ts in turns.items():
        said = "".join(f"{role}\n{text}\n" for role, text in ts)
        loss = "".join(text for role, text in ts if role == "assistant")
        r = rows[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= len(loss)


def test_op5_query(spark, sf):
    _, rows = result(spark, sf, "op5_decision_list")
    assert len(rows) == len(DOCS)
    for i, t in DOCS:
        words = WORD.findall(base(t))
        windows = {}
        for k in range(len(words) - 4):
            windows.setdefault(tuple(words[k:k + 5]), []).append(k)
        repeated = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(5)}
        seen, again = set(), 0
        for line in base(t).split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        r = rows[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", base(t))), again, len(repeated))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op6_query(spark, sf):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    table = QUERIES["op6_shortest_pack_first"](spark, sf).toPandas()
    ids = {i: [*t.encode(base(x), add_special_tokens=False).ids, 1] for i, x in DOCS}
    for i, pieces in table.groupby("doc_id"):
        at = 0
        for r in pieces.sort_values("start").to_dict("records"):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    assert set(table.doc_id) == set(ids)
    for _, pieces in table.groupby("sequence_id"):
        pieces, at = pieces.sort_values("offset"), 0
        for r in pieces.to_dict("records"):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert table.length.sum() >= 0.9 * 2048 * (table.sequence_id.nunique() - 1)


def test_op7_query(spark, sf):
    found = QUERIES["op7_template_leaks"](spark, sf).toPandas()
    assert 7 in set(found.doc_id) and not {i for i, t in DOCS if t is None or len(t) < 20} & set(found.doc_id)


def test_op8_query(spark, sf):
    _, rows = result(spark, sf, "op8_weak_supervision")
    assert len(rows) == len(DOCS)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    toxic = {i for i in rows if 300 <= i < 360}
    said = {i for i, r in rows.items() if r["predicted"]}
    assert len(said & toxic) >= 50 and len(said - toxic) <= 15


def test_op10_query(spark, sf):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    _, rows = result(spark, sf, "op10_token_files")
    at = 0
    for i, x in sorted(DOCS):
        ids = [*t.encode(base(x), add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_queries_over_empty_labels(spark, sf, tmp_path):
    """No label at all: scores and verdicts are still given for every document."""
    for name in ("documents", "benchmark"):
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet"), tmp_path / f"{name}.parquet")
    pq.write_table(pq.read_table(f"{sf}/labels.parquet").slice(0, 0), tmp_path / "labels.parquet")
    assert len(result(spark, str(tmp_path), "op8_weak_supervision")[1]) == len(DOCS)
    _, rows = result(spark, str(tmp_path), "op5_decision_list")
    assert len(rows) == len(DOCS) and not any(r["kept"] for r in rows.values() if r["base_failed"])
