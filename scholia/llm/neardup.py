"""Near duplicates by SuperMinHash, banding, exact verification and union-find.

1. One pass over the texts makes, per row, the set of 5-word shingles (64-bit
   hashes), a 128-bit key of that set, and a SuperMinHash signature (Ertl 2017):
   each element walks its own random permutation of the 128 registers, offering
   rank + fraction to one register a step, and stops as soon as no register can
   still be lowered. 32 bands of 4 registers follow. At Jaccard 0.75 a pair
   misses all bands with probability (1 - 0.75^4)^32, about 5 in a million.
2. Rows with equal sets become one representative (partial aggregate), so a
   group of copies of any size costs one row.
3. The smallest key of each bucket is its hub; links to hubs join buckets into
   candidate families (large-star/small-star). No pair is emitted.
4. Families are verified exactly on full sets. A family is cut into blocks;
   each pair of blocks is one task, which counts all intersections with a
   product of incidence matrices and returns a spanning forest of the true
   links, never the pairs.
5. The forests' components are the groups; the smallest doc_id names each.

Results for special input: null, empty and wordless texts have no shingles and
are linked with nothing (their own component, kept); fewer than five words are
one shingle; repeated rows and rows that share a doc_id are one document (same
verdict); a row without doc_id joins its group and is kept only if no member
has an id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import (U64, components, long_lists, materialize, mix, shuffle_partitions, slices_by_bytes, table, text_shingles, tidy)

REGISTERS, BANDS = 128, 32
GOLD = U64(0x9E3779B97F4A7C15)
#: Rows up to which the list of candidate documents is broadcast (64 bytes each).
BROADCAST_ROWS = 300_000


def super_minhash(hashes: np.ndarray, rows: np.ndarray, n_rows: int, m: int = REGISTERS, chunk: int = 1 << 16) -> np.ndarray:
    """(n_rows, m) signatures of the sets given as sorted (row, hash) pairs.
    A register holds step << 32 | fraction; empty sets keep the largest value."""
    sig = np.full(n_rows * m, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), chunk):
        h, r = hashes[lo:lo + chunk], rows[lo:lo + chunk]
        at = np.arange(len(h))
        walk = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
        for j in range(m):
            rnd = mix(h[at] + U64((2 * j + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
            to = j + ((rnd >> U64(32)) * U64(m - j) >> U64(32)).astype(np.int64)
            place = walk[at, to]
            walk[at, to] = walk[at, j]
            np.minimum.at(sig, r[at] * m + place, U64(j << 32) | (rnd & U64(0xFFFFFFFF)))
            live = np.unique(r[at])
            worst = sig.reshape(n_rows, m)[live].max(axis=1) >> U64(32)
            stop = live[worst <= U64(j)]
            if len(stop):
                done = np.zeros(n_rows, bool)
                done[stop] = True
                at = at[~done[r[at]]]
            if not len(at):
                break
    return sig.reshape(n_rows, m)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, m = sig.shape
    parts = sig.reshape(n, bands, m // bands)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (n, bands)).copy()
    for i in range(m // bands):
        acc = mix(acc + parts[:, :, i])
    return acc


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def set_keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(_sums(mix(h ^ U64(0x5851F42D4C957F2D)), counts)), mix(_sums(mix(h + U64(0x14057B7EF767814F)), counts))


def _signed(batches):
    for whole in batches:
        for batch in slices_by_bytes(whole, "text"):
            n = batch.num_rows
            h, r = text_shingles(batch.column("text"))
            counts = np.bincount(r, minlength=n)
            h1, h2 = set_keys(h, counts)
            full = counts > 0
            bands = band_keys(super_minhash(h, r, n))
            bands = bands[full].ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("loc"), pa.array(counts.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), long_lists(bands, np.where(full, BANDS, 0))],
                names=["doc_id", "loc", "n", "h1", "h2", "bands"])


def _sets(batches):
    """The sets of candidates; a representative's repeated rows count once."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices_by_bytes(whole, "text"):
            h, r = text_shingles(batch.column("text"))
            counts = np.bincount(r, minlength=batch.num_rows)
            h1, h2 = set_keys(h, counts)
            mine = (h1.view(np.int64) == batch.column("h1").to_numpy()) & (h2.view(np.int64) == batch.column("h2").to_numpy())
            v = batch.column("v").to_numpy()
            for i in np.flatnonzero(mine):
                if v[i] in seen:
                    mine[i] = False
                seen.add(int(v[i]))
            take = pa.array(np.flatnonzero(mine))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("root", "block", "blocks", "v")), long_lists(h[mine[r]], counts[mine])], names=["root", "block", "blocks", "v", "items"])


def linked(counts: np.ndarray, items: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """The boolean matrix of linked sets: 100 * intersection >= percent * union."""
    k = len(counts)
    row = np.repeat(np.arange(k), counts)
    _, col, freq = np.unique(items, return_inverse=True, return_counts=True)
    common = freq >= 2
    new = np.cumsum(common) - 1
    keep = common[col]
    row, col = row[keep], new[col[keep]]
    width = int(common.sum())
    inter = np.zeros((k, k), np.float32)
    step = max(64, (1 << 22) // max(k, 1))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(col, (lo, lo + step))
        x = np.zeros((k, min(step, width - lo)), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        inter += x @ x.T
    inter = inter.astype(np.int64)
    link = 100 * inter >= percent * (counts[:, None] + counts[None, :] - inter)
    if side is not None:
        link &= side[:, None] != side[None, :]
    return link


def forest(link: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches, by sweeps of minima."""
    k = len(link)
    label = np.arange(k)
    while True:
        best = np.where(link, label[None, :], k).min(axis=1)
        best = np.minimum(label, best)
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _verify(percent: int):
    def run(batches):
        key, vs, parts, sides = None, [], [], []

        def close():
            if len(vs) < 2:
                return None
            counts = np.array([len(p) for p in parts], np.int64)
            side = np.array(sides) if key[1] != key[2] else None
            label = forest(linked(counts, np.concatenate(parts), side, percent))
            a, b = np.array(vs)[label != np.arange(len(vs))], np.array(vs)[label[label != np.arange(len(vs))]]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if len(a) else None

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("root", "bi", "bj", "v", "block")]
            items = batch.column("items")
            values, offs = items.values.to_numpy(), items.offsets.to_numpy()
            for i, (root, bi, bj, v, block) in enumerate(zip(*(c.tolist() for c in cols))):
                if (root, bi, bj) != key:
                    if (out := close()) is not None:
                        yield out
                    key, vs, parts, sides = (root, bi, bj), [], [], []
                if not vs or vs[-1] != v:  # sorted by v: repeats stand together
                    vs.append(v)
                    parts.append(values[offs[i]:offs[i + 1]].copy())
                    sides.append(block)
        if (out := close()) is not None:
            yield out
    return run


def locator(doc_id: Column, text: Column) -> Column:
    """What tells rows that share a doc_id apart."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, percent: int = 75, located: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``
    (doc_id, text); documents with 100 * intersection >= percent * union of
    their shingle sets are linked, and links are followed. ``located``: with
    ``loc``, each row's locator."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), locator(F.col("doc_id"), F.col("text")).alias("loc"), text.alias("text"))
    sig = materialize(base.mapInArrow(tidy(_signed), "doc_id long, loc long, n long, h1 long, h2 long, bands array<long>"), "signatures")
    worded = sig.filter("n > 0")
    reps = worded.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.min("loc").alias("loc"))
    reps = materialize(reps.withColumn("v", F.monotonically_increasing_id()), "sets")
    # candidate families
    keys = materialize(worded.groupBy("h1").agg(F.first("bands").alias("bands")).select("h1", F.explode("bands").alias("bucket")), "buckets")
    hubs = materialize(keys.groupBy("bucket").agg(F.min("h1").alias("hub"), F.max("h1").alias("last")).filter("hub <> last").select("bucket", "hub"), "hubs")
    near = keys.join(hubs, "bucket").filter("h1 <> hub").select(F.col("h1").alias("a"), F.col("hub").alias("b")).distinct()
    families = materialize(components(near), "families")
    member = reps.join(families.withColumnRenamed("node", "h1"), "h1")
    member = materialize(member.select("v", "loc", "h1", "h2", "n", "root"), "members")
    sizes = member.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    per_block = F.least(F.lit(2048), F.greatest(F.lit(128), F.ceil(F.col("k") / 16)))
    blocks = F.greatest(F.ceil(F.col("k") / per_block), F.ceil(F.col("w") / 400_000)).cast("int")
    sizes = materialize(sizes.withColumn("blocks", blocks).filter("blocks > 1").select("root", "blocks"), "family-blocks")
    member = member.join(sizes, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    member = materialize(member.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("n"), "members-in-blocks")
    # exact verification, block against block
    few = member.count() <= BROADCAST_ROWS
    texts = base.select("loc", "text").join(F.broadcast(member) if few else member, "loc")
    sets = texts.select("root", "block", "blocks", "v", "h1", "h2", "text").mapInArrow(tidy(_sets), "root long, block int, blocks int, v long, items array<long>")
    other = sets.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.select("root", F.least("block", "_j").alias("bi"), F.greatest("block", "_j").alias("bj"), "block", "v", "items")
    dealt = other.repartition(shuffle_partitions(spark), "root", "bi", "bj").sortWithinPartitions("root", "bi", "bj", "v")
    links = materialize(dealt.mapInArrow(tidy(_verify(percent)), "a long, b long"), "links")
    found = materialize(components(links), "groups")
    named = found.join(reps.select(F.col("v").alias("node"), "id"), "node")
    names = materialize(named.groupBy("root").agg(F.min("id").alias("cid")), "group-names")
    by_v = found.join(names, "root").select(F.col("node").alias("v"), "cid")
    final = materialize(reps.join(by_v, "v", "left").select("h1", "h2", "n", F.coalesce("cid", "id").alias("component_id")), "set-groups")
    out = sig.select("doc_id", *(["loc"] if located else []), "n", "h1", "h2").join(final, ["h1", "h2", "n"], "left")
    out = out.select("doc_id", *(["loc"] if located else []), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def expected_misses(jaccard: float, bands: int = BANDS, rows: int = REGISTERS // BANDS) -> float:
    """The chance that a pair shares no band."""
    return math.pow(1 - jaccard ** rows, bands)
