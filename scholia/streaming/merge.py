"""Papers merged as their sources arrive.

Rows of a stream are what one source says of one paper: ``key`` (a content
hash), ``part`` (0 is the most trusted source), an order within it, scalar and
array fields. Per paper the state keeps each source row by (part, order), so a
row delivered twice counts once. Scalars come from the first source, in that
order, that has them; arrays are joined in that order. A paper is put out again,
with the next version, when its merged row has changed and only then.

The result doesn't depend on the order of the rows or on their cut into
batches: ``latest`` of all that was put out is what ``joins.merge_sources``
gives over the whole tables at once (there arrays come in any order). A source
row without any data still opens its paper. Rows without a key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from scholia.streaming.ordered import ready


class Merge(StatefulProcessor):
    def __init__(self, key: str, scalars: list[str], arrays: list[str], order: str, kinds: dict[str, str]):
        self.key, self.scalars, self.arrays, self.order, self.kinds = key, scalars, arrays, order, kinds

    def init(self, handle) -> None:
        fields = ", ".join(f"`{c}` {self.kinds[c]}" for c in [*self.scalars, *self.arrays])
        self.rows = handle.getMapState("rows", f"part int, ord {self.kinds[self.order]}", fields)
        self.told = handle.getValueState("told", f"version long, {fields}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.rows.updateValue((r["part"], r[self.order]), tuple(r[c] for c in [*self.scalars, *self.arrays]))
        known = [v for _, v in sorted((tuple(k), tuple(v)) for k, v in self.rows.iterator())]
        merged = [next((v[i] for v in known if v[i] is not None), None) for i in range(len(self.scalars))]
        merged += [[x for v in known for x in v[len(self.scalars) + i] or ()] for i in range(len(self.arrays))]
        was = tuple(self.told.get()) if self.told.exists() else (0,)
        if [list(x) if isinstance(x, (list, tuple)) else x for x in was[1:]] != merged or not was[0]:
            self.told.update((was[0] + 1, *merged))
            yield Row(**{self.key: key[0], "version": was[0] + 1, **dict(zip([*self.scalars, *self.arrays], merged))})

    def close(self) -> None:
        pass


def merge_stream(rows: DataFrame, key: str, scalars: list[str], arrays: list[str], order: str) -> DataFrame:
    """(key, version, scalars, arrays) of each paper that a batch changes; use
    output mode update. ``rows`` has the column ``part``."""
    ready(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join([f"`{key}` {kinds[key]}", "version long", *(f"`{c}` {kinds[c]}" for c in [*scalars, *arrays])])
    x = rows.filter(F.col(key).isNotNull()).withColumn("part", F.col("part").cast("int")).select(key, "part", order, *scalars, *arrays)
    return x.groupBy(key).transformWithState(Merge(key, scalars, arrays, order, kinds), out, "update", "none")


def latest(told: DataFrame, key: str) -> DataFrame:
    """The last version of each paper."""
    rest = [c for c in told.columns if c != key]
    return told.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(key, "_r.*")


def append_batches(changes: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """A started query that writes each batch to a folder of its own, by batch
    id, so that a batch that is run again replaces itself. Read the whole with
    ``spark.read.parquet(path)`` and take ``latest``."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
