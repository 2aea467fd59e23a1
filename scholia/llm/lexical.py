"""Ranked lexical search: exact top documents of each item by blocked postings.

A document's score for an item is a sum over the item's terms of integer
contributions (``contributions``), so documents and items are sparse vectors.
The corpus is read twice.

1. ``forward`` counts, in a map, each document's words and its occurrences of
   the items' terms, and writes that down; the number of documents, of words,
   and each term's document frequency are aggregated from it.
2. ``search`` goes over that table. Each task takes it in *segments* of about
   SEGMENT postings, whose size doesn't grow with the corpus, and per segment
   * finds each item's essential terms: without them a document can't reach the
     item's threshold, by the largest contributions that each list has,
   * cuts the posting list of each essential term into blocks of similar
     documents: each goes to the nearest of some of the list's own documents,
     by the cosine of random projections of the contribution vectors,
   * stores each block's summary, the coordinatewise maximum of its documents'
     contributions,
   * skips, per item, the blocks whose summary adds up to less than the
     threshold, and scores the documents of the others on their whole vectors.

An item's threshold is the score of the last of its best documents in a sample
of about SEEDS documents that are scored whole. It is below no true result, so
whatever the sample, no result is lost: a larger one only skips more. Segments
return at most the best ``k`` per item, and the best of those are the result.
No list, term or document meets in one task or on the driver, so frequent terms
and very large groups of copies are as spread as the rows are.

Items are taken in groups of about ITEMS_AT_A_TIME term occurrences, which are
broadcast with their terms' weights; another group is another pass.

Terms are compared by 64-bit hashes of their bytes. Results for special input:
a null or empty text has no terms, and neither it nor its document counts; an
item without terms has no rows; rows that repeat are ranked each, and so are
repeated items (equal rows of items once); documents without an id rank after
others of equal score; equal ids of one score stay in any order, which shows
in nothing; texts are read whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import LOWER, materialize, slices_by_bytes, span_hashes, table, text_bytes, tidy, word_spans

BEST = 10
#: Postings that make a segment, documents that make a block on average.
SEGMENT, BLOCK = 200_000, 8
#: Documents from which thresholds are taken.
SEEDS = 32_768
#: Term occurrences of the items that are broadcast at a time (16 bytes each).
ITEMS_AT_A_TIME = 500_000
#: Numbers in a scratch array.
CELLS = 1 << 20
#: Dimensions of the projections by which a list is clustered.
PROJECTED = 16

BREAKS = np.ones(256, bool)
BREAKS[0x30:0x3A] = BREAKS[0x41:0x5B] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False
NO_ID = np.iinfo(np.int64).max


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term of the texts, A-Z lower-cased."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    s, e, rows = word_spans(raw, offsets, BREAKS)
    return span_hashes(raw, s, e), rows


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


class Items(NamedTuple):
    """Items and their terms: item ``i`` has ``term[start[i]:start[i + 1]]``."""
    ids: list
    start: np.ndarray
    term: np.ndarray
    hashes: np.ndarray  # of the terms, ascending

    @property
    def item(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.start))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(id, terms): the distinct term hashes of each distinct row of items."""
    items = items.select(F.col(key).alias("id"), F.col(text).alias("text")).distinct()

    def run(batches):
        for batch in batches:
            h, rows = term_hashes(batch.column("text"))
            pairs = np.unique(np.stack((rows.astype(np.uint64), h), 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            counts = np.bincount(pairs[:, 0].astype(np.int64), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(pairs[:, 1].copy().view(np.int64), counts)], names=["id", "terms"])

    kind = items.schema["id"].dataType.simpleString()
    return items.mapInArrow(tidy(run), f"id {kind}, terms array<long>").filter(F.size("terms") > 0)


def gathered(rows: list) -> Items:
    counts = [len(r["terms"]) for r in rows]
    flat = np.fromiter((h for r in rows for h in r["terms"]), np.int64, sum(counts)).view(np.uint64)
    hashes, term = np.unique(flat, return_inverse=True)
    return Items([r["id"] for r in rows], np.concatenate(([0], np.cumsum(counts))).astype(np.int64), term.astype(np.int32), hashes)


# ---------------------------------------------------------------- documents


def forward(docs: DataFrame, hashes: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): a row a document with a term at all; ``terms``
    are places in ``hashes``, ascending."""
    known = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches):
        vocabulary = known.value
        for batch in batches:
            for piece in slices_by_bytes(batch, "text"):
                h, rows = term_hashes(piece.column("text"))
                n = np.bincount(rows, minlength=piece.num_rows)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[at] == h
                pair, tf = np.unique(rows[hit] * len(vocabulary) + at[hit], return_counts=True)
                counts = np.bincount(pair // len(vocabulary), minlength=piece.num_rows)
                out = pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), lists((pair % len(vocabulary)).astype(np.int32), counts), lists(tf.astype(np.int64), counts)], names=["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, n long, terms array<int>, tf array<long>")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents of each term, added up within batches before the shuffle."""
    def run(batches):
        for batch in batches:
            n = np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(tidy(run), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def contributions(weight, tf, n, n_docs: int, n_words: int):
    """What a term adds to a document's score (64-bit integers, div downwards)."""
    m = 100 - 90 + 90 * n * n_docs // n_words
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


# ---------------------------------------------------------------- segments


class Segment(NamedTuple):
    """Documents with their contributions: document ``d`` (its place) has
    ``term[start[d]:start[d + 1]]`` and ``value`` beside them."""
    ids: np.ndarray
    start: np.ndarray
    term: np.ndarray
    value: np.ndarray


class Blocks(NamedTuple):
    """Blocks of posting lists: block ``b`` of list ``term[b]`` has documents
    ``doc[start[b]:start[b + 1]]`` and the summary ``coordinate`` and
    ``largest`` from ``bounds[b]`` to ``bounds[b + 1]``."""
    term: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    coordinate: np.ndarray
    largest: np.ndarray


def runs(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the runs ``which``, and the ends of each."""
    size = start[which + 1] - start[which]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[which] - ends + size, size), ends


def segments(batches, weight: np.ndarray, n_docs: int, n_words: int):
    """Segments of a partition of ``forward``'s rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= SEGMENT:
            yield _segment(held, weight, n_docs, n_words)
            held, size = [], 0
    if held:
        yield _segment(held, weight, n_docs, n_words)


def _segment(batches, weight, n_docs, n_words) -> Segment:
    t = pa.Table.from_batches(batches).combine_chunks()
    flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t.column(c).chunks] or [np.zeros(0, np.int64)])
    counts = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in t.column("terms").chunks] or [np.zeros(0, np.int64)])
    start = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    term, n = flat("terms"), np.repeat(t.column("n").to_numpy(), counts)
    ids = t.column("doc_id").fill_null(NO_ID).to_numpy()
    return Segment(ids, start, term, contributions(weight[term], flat("tf"), n, n_docs, n_words))


def projected(seg: Segment, size: int) -> np.ndarray:
    """Unit vectors of PROJECTED dimensions whose cosines are near the documents'."""
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (size, PROJECTED))
    out = np.zeros((len(seg.ids), PROJECTED), np.float32)
    some = np.flatnonzero(np.diff(seg.start))
    if len(some):
        lo = 0
        while lo < len(some):  # of whole documents, some CELLS numbers at a time
            hi = max(lo + 1, int(np.searchsorted(seg.start[some + 1], seg.start[some[lo]] + CELLS // PROJECTED, side="right")))
            a, b = seg.start[some[lo]], seg.start[some[hi - 1] + 1]
            out[some[lo:hi]] = np.add.reduceat(seg.value[a:b, None].astype(np.float32) * signs[seg.term[a:b]], seg.start[some[lo:hi]] - a, axis=0)
            lo = hi
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def blocked(seg: Segment, which: np.ndarray, size: int) -> Blocks:
    """The posting lists of the terms ``which``, cut into blocks of similar
    documents, with their summaries. ``size``: number of terms."""
    wanted = np.zeros(size, bool)
    wanted[which] = True
    at = np.flatnonzero(wanted[seg.term])
    at = at[np.argsort(seg.term[at], kind="stable")]
    doc = np.repeat(np.arange(len(seg.ids)), np.diff(seg.start))[at]
    term = seg.term[at]
    edge = np.flatnonzero(np.concatenate((term[1:] != term[:-1], [True]))) + 1 if len(term) else np.zeros(0, np.int64)
    near = projected(seg, size)
    terms, sizes, order = [], [], []
    lo = 0
    for hi in edge.tolist():
        docs = doc[lo:hi]
        k = -(-len(docs) // BLOCK)
        if k > 1:
            centre = near[docs[np.arange(k) * len(docs) // k]]
            mine = (near[docs] @ centre.T).argmax(axis=1)
            n = np.bincount(mine, minlength=k)
            docs, n = docs[np.argsort(mine, kind="stable")], n[n > 0]
        else:
            n = np.array([len(docs)])
        terms.append(np.full(len(n), term[lo]))
        sizes.append(n)
        order.append(docs)
        lo = hi
    none = np.zeros(0, np.int64)
    term, doc = np.concatenate([none, *terms]), np.concatenate([none, *order])
    start = np.concatenate(([0], np.cumsum(np.concatenate([none, *sizes])))).astype(np.int64)
    bounds, coordinate, largest = summaries(seg, start, doc, size)
    return Blocks(term, start, doc, bounds, coordinate, largest)


def summaries(seg: Segment, start: np.ndarray, doc: np.ndarray, size: int):
    """Coordinatewise maxima of each block's documents, as sparse vectors."""
    n_blocks = len(start) - 1
    scratch = np.zeros(max(CELLS, size), np.int64)
    per = max(1, CELLS // max(size, 1))
    length = np.diff(seg.start)[doc]
    upto = np.concatenate(([0], np.cumsum(length)))[start]
    counts, cells, values = [], [], []
    lo = 0
    while lo < n_blocks:
        hi = min(lo + per, n_blocks, max(lo + 1, int(np.searchsorted(upto, upto[lo] + CELLS, side="right")) - 1))
        members = doc[start[lo]:start[hi]]
        at, _ = runs(seg.start, members)
        block = np.repeat(np.arange(hi - lo), np.diff(start[lo:hi + 1]))
        cell = np.repeat(block, np.diff(seg.start)[members]) * size + seg.term[at]
        np.maximum.at(scratch, cell, seg.value[at])
        used = np.flatnonzero(scratch[:(hi - lo) * size])
        counts.append(np.bincount(used // size, minlength=hi - lo))
        cells.append((used % size).astype(np.int32))
        values.append(scratch[used])
        scratch[used] = 0
        lo = hi
    bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts])))).astype(np.int64)
    return bounds, np.concatenate([np.zeros(0, np.int32), *cells]), np.concatenate([np.zeros(0, np.int64), *values])


def essential(seg: Segment, items: Items, floor: np.ndarray) -> np.ndarray:
    """Which of ``items.term``: all but those of smallest maxima that add up to
    less than the item's floor."""
    most = np.zeros(len(items.hashes), np.int64)
    np.maximum.at(most, seg.term, seg.value)
    item, value = items.item, most[items.term]
    order = np.lexsort((value, item))
    total = np.cumsum(value[order])
    before = np.concatenate(([0], total))[items.start[:-1]]
    need = np.zeros(len(item), bool)
    need[order] = total - before[item[order]] >= floor[item[order]]
    return need & (value > 0)


def survivors(blocks: Blocks, items: Items, need: np.ndarray, floor: np.ndarray, size: int):
    """(block, item) whose summaries add up to the item's floor at least."""
    by_term = np.flatnonzero(need)
    by_term = by_term[np.argsort(items.term[by_term], kind="stable")]
    starts = np.searchsorted(items.term[by_term], np.arange(size + 1))
    owner = items.item
    scratch = np.zeros(max(CELLS, size), np.int64)
    per = max(1, CELLS // max(size, 1))
    out_b, out_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(blocks.term), per):
        hi = min(lo + per, len(blocks.term))
        a, b = blocks.bounds[lo], blocks.bounds[hi]
        cell = np.repeat(np.arange(hi - lo), np.diff(blocks.bounds[lo:hi + 1])) * size + blocks.coordinate[a:b]
        scratch[cell] = blocks.largest[a:b]
        at, ends = runs(starts, blocks.term[lo:hi])
        pair_item = owner[by_term[at]]
        pair_block = np.repeat(np.arange(hi - lo), np.diff(np.concatenate(([0], ends))))
        width = np.diff(items.start)[pair_item]
        edge = np.concatenate(([0], np.cumsum(width)))
        x = 0
        while x < len(pair_item):  # whole pairs, some CELLS terms at a time
            y = max(x + 1, int(np.searchsorted(edge, edge[x] + CELLS, side="right")) - 1)
            at, _ = runs(items.start, pair_item[x:y])
            bound = np.add.reduceat(scratch[np.repeat(pair_block[x:y], width[x:y]) * size + items.term[at]], edge[x:y] - edge[x])
            good = np.flatnonzero(bound >= floor[pair_item[x:y]]) + x
            out_b.append(pair_block[good] + lo)
            out_i.append(pair_item[good])
            x = y
        scratch[cell] = 0
    return np.concatenate(out_b), np.concatenate(out_i)


def scored(seg: Segment, docs: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whole scores of ``docs`` (places of documents with terms)."""
    at, ends = runs(seg.start, docs)
    return np.add.reduceat(seg.value[at] * mark[seg.term[at]], np.concatenate(([0], ends[:-1])))


def leaders(seg: Segment, items: Items, pairs, floor: np.ndarray, k: int):
    """(item, document, score): the ``k`` best of each item's candidates."""
    mark = np.zeros(len(items.hashes), np.int64)
    for i, docs in pairs:
        if not len(docs):
            continue
        own = items.term[items.start[i]:items.start[i + 1]]
        mark[own] = 1
        score = scored(seg, docs, mark)
        mark[own] = 0
        docs, score = docs[score >= floor[i]], score[score >= floor[i]]
        best = np.lexsort((seg.ids[docs], -score))[:k]
        yield from ((i, int(seg.ids[d]), int(s)) for d, s in zip(docs[best].tolist(), score[best].tolist()))


def candidates(blocks: Blocks, block: np.ndarray, item: np.ndarray):
    """(item, its distinct documents in the blocks that it keeps)."""
    order = np.argsort(item, kind="stable")
    block, item = block[order], item[order]
    edge = np.concatenate(([0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)])) if len(item) else [0]
    for lo, hi in zip(edge[:-1], edge[1:]):
        at, _ = runs(blocks.start, block[lo:hi])
        yield int(item[lo]), np.unique(blocks.doc[at])


def _answers(found) -> pa.RecordBatch:
    found = list(found)
    item, doc, score = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([None if d == NO_ID else d for d in doc], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])


_ANSWERS = "item int, doc_id long, score long"


def thresholds(rows: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_words: int, k: int) -> np.ndarray:
    """Per item the score of the k-th best of some documents, 1 at least."""
    one = np.ones(len(items.ids), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches):
        items, weight = shared.value
        for seg in segments(batches, weight, n_docs, n_words):
            docs = np.flatnonzero(np.diff(seg.start))
            yield _answers(leaders(seg, items, ((i, docs) for i in range(len(items.ids))), one, k))

    share = F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_docs)) < SEEDS
    found = rows.filter(share).mapInArrow(tidy(run), _ANSWERS)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    out = one.copy()
    for r in found.withColumn("_place", place).filter(F.col("_place") == k).select("item", "score").collect():
        out[r["item"]] = r["score"]
    return out


def search(rows: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_words: int, k: int = BEST) -> DataFrame:
    """(item, doc_id, score): every item's ``k`` best of ``forward``'s rows and
    perhaps others; ``item`` is a place in ``items``."""
    floor = thresholds(rows, items, weight, n_docs, n_words, k)
    shared = rows.sparkSession.sparkContext.broadcast((items, weight, floor))

    def run(batches):
        items, weight, floor = shared.value
        size = len(items.hashes)
        for seg in segments(batches, weight, n_docs, n_words):
            need = essential(seg, items, floor)
            blocks = blocked(seg, np.unique(items.term[need]), size)
            left = survivors(blocks, items, need, floor, size)
            yield _answers(leaders(seg, items, candidates(blocks, *left), floor, k))

    return rows.mapInArrow(tidy(run), _ANSWERS)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item key, rank, doc key, score): the ``k`` documents of highest score
    above 0 of each item, equal scores by ascending id."""
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_key, text), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-total // ITEMS_AT_A_TIME)
    kind = asked.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for g in range(groups):
        mine = gathered(asked.filter(F.pmod(F.hash("terms"), F.lit(groups)) == g).collect())
        if not mine.ids:
            continue
        rows = materialize(forward(docs, mine.hashes, doc_key, text), "forward")
        n_docs, n_words = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weight = weights(frequencies(rows, len(mine.hashes)), n_docs)
        found = search(rows, mine, weight, n_docs, n_words, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(mine.ids)), f"item int, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(materialize(best, "answers") if groups > 1 else best)
    return out.select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").alias(doc_key), "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
