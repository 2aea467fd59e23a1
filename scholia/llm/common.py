"""Shared pieces of the training-data operators.

``materialize`` cuts lineage by writing a table into the shared folder that the
cluster names in ``spark.checkpoint.dir``; the text kernels turn an Arrow batch
of strings into word and shingle hashes with NumPy, without a Python loop over
words.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

# ---------------------------------------------------------------- tables


#: Bytes of rows that go to a Python worker at a time.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; one of our own only where the
    session names none (tests, a laptop)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(session_ref, path: str) -> None:
    spark = session_ref()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is going down; the folder is scratch
        pass


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Parquet rather than ``checkpoint()``: it is compressed, later readers prune
    columns, and its size is known to the planner. The files go when the
    process ends."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    path = f"{scratch_dir(spark)}/scholia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, weakref.ref(spark), path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._files = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files that ``materialize`` wrote for ``df``."""
    _remove(weakref.ref(df.sparkSession), df._files)


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block go at its end; only
    tables given to ``keep`` may be read afterwards."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _remove(weakref.ref(spark), path)


def keep(df: DataFrame) -> DataFrame:
    """``df``, which ``materialize`` made last, stays after the block."""
    path = _SCRATCH[-1].pop()
    if len(_SCRATCH) > 1:
        _SCRATCH[-2].append(path)
    return df


#: Tables that functions keep in a Python worker from one task to the next.
_HELD: list[dict] = []


def held() -> dict:
    """A dictionary whose contents go when the worker turns to another function."""
    _HELD.append({})
    return _HELD[-1]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _begin(holds: bool) -> None:
    if not holds and any(_HELD):
        for kept in _HELD:
            kept.clear()
        _give_back()


def tidy(function, holds: bool = False):
    """``function`` for mapInArrow, giving freed memory back at a task's end:
    workers are kept for later tasks, and what they hold counts. Only a function
    that ``holds`` finds there what tasks before it put into ``held`` tables."""
    def run(batches):
        _begin(holds)
        yield from function(batches)
        _give_back()
    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


# ---------------------------------------------------------------- text kernels

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_ODD = U64(0x9E3779B97F4A7C15) | U64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
    return raw, offs - offs[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WORD_BREAKS):
    """Start, end (bytes) and row of every word; a word never crosses a row."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1]
    firsts = firsts[firsts < len(raw)]
    starts[firsts] = inside[firsts]
    edge[1:] = inside
    ends = edge.copy()
    ends[:-1] &= ~inside
    lasts = offsets[1:]
    ends[lasts] = edge[lasts]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends)
    e = e[e > 0]
    rows = np.searchsorted(offsets, s, side="right") - 1
    return s, e, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums: O(bytes)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 20  # bytes at a time, so that the tables of powers stay small
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(int(np.searchsorted(ends, base + step, side="right")), lo + 1)
        piece = raw[base:ends[hi - 1]]
        power = np.full(len(piece), _ODD, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * power, out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        inverse = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(len(piece) - 1, _inverse(_ODD), np.uint64))))
        out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def _inverse(a: np.uint64) -> np.uint64:
    x = U64(1)
    with np.errstate(over="ignore"):
        for _ in range(7):
            x = x * (U64(2) - a * x)
    return x


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5):
    """Hashes of all ``width``-word windows, and their rows, in text order. A
    row with fewer words (one at least) has one: its whole sequence."""
    count = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    k = max(n - width + 1, 0)
    odd = U64(0xA0761D6478BD642F)
    first = np.zeros(n_rows, np.int64)
    first[1:] = np.cumsum(count)[:-1]
    for i in range(width):
        acc[:k] = acc[:k] * odd + words[i:i + k]
    whole = (np.arange(n) - first[rows]) + width <= count[rows]
    short = np.flatnonzero((count > 0) & (count < width))
    out_h, out_r = mix(acc[whole]), rows[whole]
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            live = i < count[short]
            h[live] = h[live] * odd + words[first[short[live]] + i]
        h = mix(h + count[short].astype(np.uint64) * U64(0xE7037ED1A0B428DB))
        out_h, out_r = np.concatenate((out_h, h)), np.concatenate((out_r, short))
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r


def text_shingles(column: pa.Array, width: int = 5):
    """(hashes, rows) of the distinct shingles of each text, A-Z lower-cased,
    sorted by row and hash."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    s, e, rows = word_spans(raw, offsets)
    h, r = shingle_hashes(span_hashes(raw, s, e), rows, len(column), width)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[fresh], r[fresh]


def slices_by_bytes(batch: pa.RecordBatch, text: str, limit: int = 1 << 19):
    """The batch in runs of whole rows of about ``limit`` bytes of text."""
    col = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_bytes(col)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield batch.slice(lo, hi - lo)
        lo = hi


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches.

    Large-star and small-star passes (Kiveris et al., SoCC 2014): every pass
    groups by node with a partial aggregate and joins the minima back, so a
    node with very many links is spread by the skew join, and nothing is
    collected. Passes stop when the table of links no longer changes."""
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
                      .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = mark(now)
    if not was[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.filter("u <> v"), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select("u", "v", "m")
        now = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                          .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        is_ = mark(now)
        if is_ == was:
            break
        was = is_
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over ``n`` local nodes; the root is the smallest index."""
    parent = np.arange(n)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up
