"""Packing: shortest-pack-first over the histogram of lengths.

Documents are tokenised, closed by an end id and cut into pieces of at most
``max_tokens`` (only documents longer than that). What packs look like depends
on how many pieces there are of each length alone, so the driver reads that
histogram (``max_tokens`` counts, whatever the corpus), places lengths longest
first, each into the pack with the most room left, and keeps *patterns*: a list
of lengths and how many packs look so. Equal packs move together, so the work
depends on the number of distinct lengths, not on documents. Patterns meet
documents again by rank: the r-th piece of a length takes the r-th place that
the patterns have for that length.

Ranks need no sort and no window over a length: each task numbers its pieces
per length as it makes them, and the counts of (length, task) before it are
added, so a length that a third of all pieces share is numbered everywhere at
once.

Results for special input: null and empty texts are one piece (the end id);
very long texts become many pieces; repeated rows are packed like others; an
empty table gives no sequences; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import materialize, slices_by_bytes, table, tidy
from scholia.llm.tokens import vocabulary

MAX_TOKENS = 2048
END_ID = 1


def pieces(docs: DataFrame, vocabulary_path: str, style: str = "words", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and
    (part, place): the piece is the place-th of its length in task ``part``."""

    def run(batches):
        words = vocabulary(vocabulary_path, style)
        seen = np.zeros(max_tokens + 1, np.int64)
        part = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                ids, counts = words.encode(batch.column("text"))
                n = len(counts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id) if n else ids
                counts = counts + 1
                base = np.cumsum(counts) - counts
                k = -(-counts // max_tokens)
                doc = np.repeat(np.arange(n), k)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * max_tokens
                length = np.minimum(counts[doc] - start, max_tokens)
                order = np.argsort(length, kind="stable")
                run_ = length[order]
                fresh = np.flatnonzero(np.concatenate(([True], run_[1:] != run_[:-1]))) if n else np.zeros(0, np.int64)
                local = np.arange(len(run_)) - np.repeat(fresh, np.diff(np.append(fresh, len(run_))))
                place = np.empty(len(run_), np.int64)
                place[order] = local + seen[run_]
                np.add.at(seen, run_, 1)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                at = (base[doc] + start).tolist()
                crc = [zlib.crc32(raw[4 * a:4 * (a + m)]) for a, m in zip(at, length.tolist())]
                out = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(np.full(len(doc), part)), pa.array(place)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
                if keep_ids:
                    offs = np.concatenate((base[doc] + start, [len(ids)])).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, place long" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", text).mapInArrow(tidy(run, holds=True), schema)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int = MAX_TOKENS):
    """Patterns for ``histogram`` (length -> how many): a list of (packs,
    lengths), longest length first. Each step gives one more piece of the
    length at hand to every pack of the emptiest kind, or as many as are left."""
    kinds: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = {}
    rooms: list[int] = []

    def add(lengths, packs):
        if lengths in kinds:
            kinds[lengths] += packs
            return
        room = max_tokens - sum(n * m for n, m in lengths)
        kinds[lengths] = packs
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(rooms, -room)
        by_room[room].append(lengths)

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            while rooms and not by_room.get(-rooms[0]):
                by_room.pop(-heapq.heappop(rooms), None)
            if not rooms or -rooms[0] < length:
                each = 1
                add(((length, 1),), left)
                left = 0
                break
            room = -rooms[0]
            group = by_room[room]
            lengths = group.pop()
            packs = kinds.pop(lengths)
            # the next emptiest room tells how many pieces this kind takes in a row
            others = [-r for r in rooms[1:3] if by_room.get(-r)]
            second = max(others, default=0)
            each = max(1, min(room // length, (room - second) // length + 1 if not group else 1))
            use = min(packs, left // each)
            if not use:
                each = 1
                use = min(packs, left)
            if use < packs:
                add(lengths, packs - use)
            last = lengths[-1]
            grown = lengths[:-1] + ((length, last[1] + each),) if last[0] == length else lengths + ((length, each),)
            add(grown, use)
            left -= use * each
    return sorted(((n, k) for k, n in kinds.items()), key=lambda x: x[1], reverse=True)


def places(patterns) -> dict[str, np.ndarray]:
    """Runs of ranks: the pieces of ``length`` with rank from ``rank`` on, ``n``
    of them, go to sequences from ``sequence`` on, one each, at ``offset``."""
    out, used, sequence = [], {}, 0
    for packs, lengths in patterns:
        offset = 0
        for length, each in lengths:
            for _ in range(each):
                out.append((length, used.get(length, 0), packs, sequence, offset))
                used[length] = used.get(length, 0) + packs
                offset += length
        sequence += packs
    table_ = np.array(out, np.int64).reshape(-1, 5)
    table_ = table_[np.lexsort((table_[:, 1], table_[:, 0]))]
    return dict(zip(("length", "rank", "n", "sequence", "offset"), table_.T))


def assign(ranked: DataFrame, runs: dict[str, np.ndarray]) -> DataFrame:
    """``ranked`` (length, rank, ...) with sequence_id and offset."""
    known = ranked.sparkSession.sparkContext.broadcast(runs)  # as large as the histogram's patterns, not the corpus

    def run(batches):
        r = known.value
        key = r["length"] * (1 << 48) + r["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(r["sequence"][at] + rank - r["rank"][at]), pa.array(r["offset"][at])], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(tidy(run), fields + ", sequence_id long, offset long")


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``cut``, a written table as ``pieces`` makes it, with sequence_id and offset."""
    counts = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places(shortest_pack_first(histogram, max_tokens))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = materialize(counts.select("length", "part", before.alias("_before")), "piece-ranks")
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("place") + F.col("_before")).drop("_before", "place", "part")
    return assign(ranked, runs)


def packed(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    cut = materialize(pieces(docs, vocabulary_path), "pieces")
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
