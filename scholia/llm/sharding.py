"""K-d tree sharding: split at weighted medians until leaves hold a target size.

The tree is built over row *metadata* only (a few numbers a row, never the
text). A node that has to become ``k`` shards is cut at the ``floor(k/2)/k``
byte quantile of its widest dimension: the one whose values in the node span
most standard deviations of the whole table, so that dimensions of any scale
can be compared. The quantile is exact: every row has a coordinate of 48 bits
per dimension (scaled value, then a hash of the row that parts ties), and some
rounds of byte histograms per node, each a partial aggregate of at most
``BINS`` bins a node, narrow the bin that holds it until it is one coordinate.
All nodes of a level share their rounds, so the number of jobs depends on the
tree's depth alone. Cuts and bins are looked up by broadcast joins of one row a
node (the number of shards bounds it), and a round sends one row a node to the
driver. A hot source or language is cut like any other run of rows, since ties
are parted. The levels work on coordinates and weights, which are written anew
every ``LEVELS`` levels, so no job replays more splits than that; the finished
tree is then applied to the rows themselves in one pass.

Results for special input: null text has size 1 and checksum 0; a null in a
dimension sorts first; repeated rows are told apart by row number, so they
spread like other rows; an empty table gives an empty result; other columns,
whatever their names, pass through (one named shard or slot is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import forget, materialize, table

BINS = 4096
TIE_BITS = 22
VALUE_BITS = 26
#: Levels after which the tree's rows are written anew.
LEVELS = 2


class _Dimension:
    """A dimension's range and spread over the whole table."""

    def __init__(self, low, high, deviation):
        self.low, self.span = low, (high - low) if low is not None and high > low else 0
        self.deviation = deviation or 0

    def coordinate(self, i: int, name: str) -> Column:
        """A long: the value scaled to 26 bits, then 22 hash bits of the row."""
        scaled = F.floor((F.col(name) - F.lit(self.low)) / F.lit(self.span) * F.lit(float((1 << VALUE_BITS) - 2))) + 1 if self.span else F.lit(1)
        tie = F.shiftrightunsigned(F.xxhash64("_row", F.lit(i)), 64 - TIE_BITS)
        return F.shiftleft(F.coalesce(scaled, F.lit(0)).cast("long"), TIE_BITS) + tie

    def width(self, low: int, high: int) -> float:
        """How many standard deviations of the table lie between two coordinates."""
        return ((high >> TIE_BITS) - (low >> TIE_BITS)) / (1 << VALUE_BITS) * self.span / self.deviation if self.deviation else 0.0


def _known(now: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``rows``, at most one a node, ready to be joined by broadcast."""
    return F.broadcast(now.sparkSession.createDataFrame(rows, schema).coalesce(1))


def _cuts(now: DataFrame, wants: dict[int, tuple[int, int]]) -> dict[int, int]:
    """wants: node -> (dimension, weight). For each node the coordinate up to
    which (it included) its rows hold about that weight: the nearer side of the
    row that crosses. A round tells one bin a node to the driver."""
    lo, width, before, cut = dict.fromkeys(wants, 0), dict.fromkeys(wants, 1 << (VALUE_BITS + TIE_BITS)), dict.fromkeys(wants, 0), {}
    while open_ := [n for n in wants if n not in cut]:
        step = {n: max(1, -(-width[n] // BINS)) for n in open_}
        state = [(n, wants[n][0] + 1, lo[n], lo[n] + width[n], step[n], wants[n][1] - before[n]) for n in open_]
        inside = now.join(_known(now, state, "_at long, _dim int, _lo long, _hi long, _s long, _need long"), F.col("_node") == F.col("_at"))
        inside = inside.withColumn("_c", F.element_at("_x", F.col("_dim"))).filter("_c >= _lo and _c < _hi")
        bins = inside.groupBy("_node", F.expr("(_c - _lo) div _s").alias("_b")).agg(F.sum("_size").alias("_m"), F.first("_need").alias("_need"))
        run = F.sum("_m").over(Window.partitionBy("_node").orderBy("_b"))  # at most BINS rows a node
        hit = bins.withColumn("_run", run).filter("_run >= _need and _run - _m < _need").select("_node", "_b", "_m", "_run")
        found = {n: (b, m, r) for n, b, m, r in hit.collect()}
        for n in open_:
            if n not in found:  # nothing weighs that much: all to the left, or nothing wanted
                cut[n] = lo[n] + width[n] - 1 if wants[n][1] > before[n] else lo[n] - 1
                continue
            b, m, r = found[n]
            need = wants[n][1] - before[n]
            before[n] += r - m
            lo[n], width[n] = lo[n] + b * step[n], min(step[n], width[n] - b * step[n])
            if width[n] == 1:
                cut[n] = lo[n] if r - need <= need - (r - m) else lo[n] - 1
    return cut


def _split(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``rows`` one level down: cuts are (node, dimension from 1, coordinate, right node)."""
    found = _known(rows, cuts, "_at long, _dim int, _cut long, _right long")
    right = F.element_at("_x", F.coalesce("_dim", F.lit(1))) > F.col("_cut")
    return rows.join(found, F.col("_node") == F.col("_at"), "left").withColumn("_node", F.when(right, F.col("_right")).otherwise(F.col("_node"))).drop("_at", "_dim", "_cut", "_right")


def kd_shards(docs: DataFrame, size, dims: dict[str, object], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each).

    size: a Column, the weight of a row. dims: name -> numeric Column. Give
    ``shards``, or ``target_bytes`` for as many as leaves of that size need."""
    dims_ = {f"_d{i}": c.cast("double") for i, c in enumerate(dims.values())}
    cols = list(dims_)
    base = docs.select(F.struct(*[docs[c] for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("_doc"), *[c.alias(n) for n, c in dims_.items()], size.cast("long").alias("_size"))
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    facts = base.agg(F.sum("_size"), *[f(c) for c in cols for f in (F.min, F.max, F.stddev_pop)]).first()
    want = shards or max(1, round((facts[0] or 0) / target_bytes))
    known = [_Dimension(*facts[1 + 3 * i:4 + 3 * i]) for i in range(len(cols))]
    x = F.array(*[d.coordinate(i, c) for i, (d, c) in enumerate(zip(known, cols))])
    whole = base.select("_doc", "_row", x.alias("_x"), F.lit(0).cast("long").alias("_node"))
    # the levels work on coordinates and weights alone, written anew every few levels
    now = materialize(base.select("_size", x.alias("_x"), F.lit(0).cast("long").alias("_node")), "tree-rows")
    written, steps = now, []
    # a node is named by its first shard; what it becomes follows from how many it holds
    nodes = {0: want}
    while open_ := [n for n, k in nodes.items() if k > 1]:
        asked = now.join(_known(now, [(n,) for n in open_], "_at long"), F.col("_node") == F.col("_at"))
        ends = [f(F.col("_x")[i]) for i in range(len(cols)) for f in (F.min, F.max)]
        wants, rows = {}, []
        for s in asked.groupBy("_node").agg(F.sum("_size"), *ends).collect():
            n, weight = s[0], s[1]
            wide = max(range(len(cols)), key=lambda i: (known[i].width(s[2 + 2 * i], s[3 + 2 * i]), -i))
            wants[n] = (wide, math.floor(weight * (nodes[n] // 2) / nodes[n] + 0.5))
        for n, c in _cuts(now, wants).items():
            rows.append((n, wants[n][0] + 1, c, n + nodes[n] // 2))
        if rows:
            steps.append(rows)
            now = _split(now, rows)
            if len(steps) % LEVELS == 0:
                now = materialize(now, "tree-rows")
                forget(written)
                written = now
        nodes = {m: j for n, k in nodes.items() for m, j in ([(n, k // 2), (n + k // 2, k - k // 2)] if k > 1 else [(n, k)])}
    for rows in steps:  # the whole tree, once, over the rows themselves
        whole = _split(whole, rows)
    out = whole.withColumn("shard", F.col("_node").cast("int"))
    # slots: number rows inside small blocks, then add what the blocks before hold
    rows = base.count()
    blocks = max(1, rows // 200_000) * 16
    out = materialize(out.select("_doc", "_row", "shard", F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("_block")), "shard-of")
    sums = out.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    sums = materialize(sums.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_before")), "shard-blocks")
    inner = Window.partitionBy("shard", "_block").orderBy("_row")
    out = out.join(sums, ["shard", "_block"]).withColumn("slot", (F.row_number().over(inner) - 1 + F.col("_before")).cast("long"))
    return out.select("_doc.*", "shard", "slot")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size and checksum of each text, and the columns that the tree
    is built over. The text itself goes no further than this projection."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("source").alias("by_source"), F.xxhash64("lang").alias("by_lang"))


def op1(spark, sf_dir: str) -> DataFrame:
    meta = metadata(table(spark, sf_dir, "documents"))
    dims = {"source": F.col("by_source"), "lang": F.col("by_lang"), "length": F.log1p("size"), "id": F.col("doc_id")}
    out = kd_shards(meta, F.col("size"), dims, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
