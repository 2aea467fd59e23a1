"""Product codes of vectors, learned by Lloyd rounds that follow moved entries.

A vector becomes integers floor(scale * x), cut into equal consecutive parts;
each position has a codebook, and a part's code is the index of its nearest
entry (squared Euclidean distance, ties to the lower index). A round assigns
all parts, then moves each entry to the floor of the mean of its parts.

Beside each part's code lies the exact distance to its entry. A part whose
entry has not moved since compares that distance with the entries that have
moved only, for it has met all others as they are; a part whose entry moved
compares all. Distances are 64-bit integers, so nothing is approximate, and
equal distances keep the lower index either way.

The rows with their codes and distances are a table that each round writes
anew (the round before is deleted), so a round replays nothing. To the driver
come the codebooks and their parts' sums: ``parts * entries`` rows, whatever
the number of vectors. Sums are aggregated within batches, then in the shuffle.

Results for special input: a vector that is null or empty, that holds null or
non-finite components, or components so large that distances leave 64 bits
(from 2^15 on, for parts of 8 components), is left out; so is one of
another length than the vector of the smallest id (null ids come last). That
length must be divisible by ``parts``, else it is a ValueError. Fewer vectors
than entries make smaller codebooks. Rows that share an id are coded each (for
the start they are ordered by their components). An empty table stays empty.
Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import forget, materialize, table, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels up to which their sums are broadcast (some 30 bytes each).
SMALL = 1_000_000


def integers(rows: DataFrame, vector: Column, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``_x``, the integer components; those without are left out."""
    x = vector.cast("array<double>")
    out = rows.withColumn("_v", x).filter(F.size("_v") > 0).filter(~F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    out = out.withColumn("_x", F.transform("_v", lambda c: F.floor(c * scale)))
    bound = F.sqrt(F.try_divide(F.lit(2.0**57 * parts), F.size("_x")))  # a part's distance stays below 2^59
    return out.drop("_v").filter((F.array_max("_x") < bound) & (F.array_min("_x") > -bound))


def _grid(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries): squared distances of one position's parts."""
    gap = x[:, None, :] - entries[None, :, :]
    return np.einsum("rew,rew->re", gap, gap)


def assign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, books: np.ndarray, moved: np.ndarray):
    """New (code, dist) of all parts of ``x``; code -1: never assigned."""
    code, dist = code.copy(), dist.copy()
    for p in range(x.shape[1]):
        changed = np.flatnonzero(moved[p])
        fresh = np.flatnonzero((code[:, p] < 0) | moved[p][code[:, p]])
        fixed = np.flatnonzero((code[:, p] >= 0) & ~moved[p][code[:, p]])
        if len(fresh):
            d = _distances(x[fresh, p], books[p])
            best = d.argmin(axis=1)  # the first of equals
            code[fresh, p], dist[fresh, p] = best, d[np.arange(len(fresh)), best]
        if len(fixed) and len(changed):
            d = _distances(x[fixed, p], books[p][changed])
            at = d.argmin(axis=1)
            near, best = d[np.arange(len(fixed)), at], changed[at]
            takes = (near < dist[fixed, p]) | (near == dist[fixed, p]) & (best < code[fixed, p])
            rows = fixed[takes]
            code[rows, p], dist[rows, p] = best[takes], near[takes]
    return code, dist


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray, parts: int) -> DataFrame:
    """``rows`` (_x, _code, _dist, ...) assigned to ``books``."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            code, dist = (_grid(batch.column(c), parts)[:, :, 0] for c in ("_code", "_dist"))
            code, dist = assign(_grid(batch.column("_x"), parts), code, dist, books, moved)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            new = {"_code": pa.ListArray.from_arrays(ends, pa.array(code.astype(np.int32).ravel())), "_dist": pa.ListArray.from_arrays(ends, pa.array(dist.ravel()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return rows.mapInArrow(tidy(run), rows.schema)


def _sums(rows: DataFrame, parts: int, entries: int) -> DataFrame:
    """(part, entry, n, total): sums of the parts that each entry has."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _grid(batch.column("_x"), parts), _grid(batch.column("_code"), parts)[:, :, 0]
            at = (code + np.arange(parts) * entries).ravel()
            total = np.zeros((parts * entries, x.shape[2]), np.int64)
            np.add.at(total, at, x.reshape(-1, x.shape[2]))
            count = np.bincount(at, minlength=parts * entries)
            used = np.flatnonzero(count)
            width = x.shape[2]
            where, c = np.repeat(used, width), np.tile(np.arange(width), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(np.repeat(count[used], width)), pa.array(total[used].ravel())], names=["at", "c", "n", "total"])

    each = rows.select("_x", "_code").mapInArrow(tidy(run), "at int, c int, n long, total long")
    return each.groupBy("at", "c").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(``rows`` with _code and _dist as a written table, codebooks as integers
    by part, entry and component). ``rows`` has _id and _x (see ``integers``)."""
    def start(df):
        return [r["_x"] for r in df.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(entries).select("_x").collect()]

    first = start(rows)
    width = len(first[0]) if first else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("_x") == width).withColumn("_code", F.array_repeat(F.lit(-1), parts)).withColumn("_dist", F.array_repeat(F.lit(0).cast("long"), parts))
    if any(len(x) != width for x in first):  # others of this length follow them
        first = start(rows)
    books = np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    moved, now = np.ones(books.shape[:2], bool), None
    for k in range(rounds + 1):
        was, now = now, materialize(_assigned(rows if now is None else now, books, moved, parts), "codes")
        if was is not None:
            forget(was)
        if k < rounds:
            new = books.copy()
            for r in _sums(now, parts, books.shape[1]).collect():
                p, e = divmod(r["at"], books.shape[1])
                new[p, e, r["c"]] = r["total"] // r["n"]
            moved, books = (new != books).any(axis=2), new
    return now, books


def product_codes(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", carry: tuple[str, ...] = ("label",), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """(key, ``carry``, codes array<int>, distances array<long>) and the
    codebooks: one row a vector that is kept."""
    given = rows.select(F.col(key).alias("_id"), F.col(vector).alias("_vector"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    whole, books = learn(integers(given, F.col("_vector"), scale, parts).drop("_vector"), parts, entries, rounds)
    return whole.select(F.col("_id").alias(key), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), F.col("_code").alias("codes"), F.col("_dist").alias("distances")), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_totals(rows: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of equal ``by``, nulls together."""
    total = materialize(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(into)), "label-errors")
    total = F.broadcast(total) if total.count() <= SMALL else total
    return rows.join(total, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def op12(spark, sf_dir: str) -> DataFrame:
    coded, books = product_codes(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, b: a + b)
    out = with_totals(coded.select("vec_id", "label", code.alias("code"), error.alias("error")), "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
