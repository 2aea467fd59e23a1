"""Connected components by alternating minima, and greedy choices by rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go where the session says; to a folder of our own only in
    local mode."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        import tempfile
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scholia-"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


#: Links that a task holds before it thins them.
HELD = 1_000_000


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ``n`` nodes, the smallest that each reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        if not live.any():
            return root
        np.minimum.at(root, high[live], low[live])
        while (root[root] != root).any():
            root = root[root]
        a, b = a[live], b[live]


def thinned(links: DataFrame) -> DataFrame:
    """(x, y) that connect what ``links`` (x, y) connect, with as many links as
    nodes in each task: every node with one of its group, itself included."""

    def fold(batches):
        held = pa.Table.from_batches(batches)
        ends = pc.dictionary_encode(pa.chunked_array([*held["x"].chunks, *held["y"].chunks])).combine_chunks()
        codes = ends.indices.to_numpy()
        root = _roots(len(ends.dictionary), codes[:held.num_rows], codes[held.num_rows:])
        return pa.RecordBatch.from_arrays([ends.dictionary, ends.dictionary.take(pa.array(root))], names=["x", "y"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                held = [fold(held)]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield held[0]
                    held, rows = [], 0
        if rows:
            yield fold(held)

    return links.mapInArrow(run, links.schema)


def connected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node's smallest reachable node. ``pairs`` are read
    once, and each task passes on no more links than it has nodes. Labels are
    then passed along links and through labels, so long chains close fast; each
    round is cut with a checkpoint in the cluster's shared folder."""
    shared_folder(pairs.sparkSession)
    links = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    if not isinstance(links.schema["x"].dataType, (T.StructType, T.ArrayType)):
        links = thinned(links)
    # both ways, and every node with itself
    ways = F.array(*[F.struct(F.col(p).alias("x"), F.col(q).alias("y")) for p, q in ("xy", "yx", "xx", "yy")])
    links = links.select(F.inline(ways)).distinct().checkpoint()
    labels = links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root")).checkpoint()
    while True:
        known = labels.select(F.col("node").alias("y"), "root")
        new = links.join(known, "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("heard"), F.max(F.when(F.col("x") == F.col("y"), F.col("root"))).alias("was"))
        new = new.join(known.select(F.col("y").alias("heard"), "root"), "heard").select("node", "root", "was").checkpoint()
        labels = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return labels
