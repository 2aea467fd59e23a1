"""The corpus pipeline: toxicity, line de-duplication, near duplicates,
benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before it kept, and returns the columns of ``documents``; the last returns the
packed pieces. Between stages the rows are written as Parquet and read again.

Nulls, empty and very long texts, repeated rows, empty tables and further
columns are handled as each operator's docstring says. Verdicts are about rows
(id and text), so rows that share an id are judged one by one; rows that repeat
another in both share its fate, and only one of them passes the near-duplicate
stage. A row without an id is named by its text: in the line stage it comes
before all rows with an id, and of near duplicates it stays only if no other has
an id (below 2^62), then as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import decontam, linededup, neardup, packing, toxicity
from scholia.llm.common import free_name, materialize, table

#: Ids up to which a list of documents to drop is broadcast (16 bytes each).
SMALL = 2_000_000
#: What near duplicates count as a word; texts without any are linked with nothing.
WORD = "[^ \\t\\n\\x0B\\f\\r]"


def _key(least: int = 1 << 62) -> Column:
    """doc_id, or for a row without one a hash of its text from ``least`` on."""
    named = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(least)
    return F.coalesce(F.col("doc_id").cast("long"), named)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("doc_id"), "text")


def _row() -> Column:
    """What a verdict is about: the id, whether there is one, and the text."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("bare"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie"))


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(_row().alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without those whose key is among the one column of ``gone``."""
    name = free_name(docs, "_gone")
    gone = materialize(gone.toDF(name).distinct(), "documents-to-drop")
    gone = F.broadcast(gone) if gone.count() <= SMALL else gone
    return docs.join(gone, key == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the linear model scores at the threshold or above go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    bad = toxicity.scored(_by_row(docs), model).filter(F.col("score") >= toxicity.THRESHOLD)
    return _without(docs, bad.select("doc_id"), _row())


def drop_later_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line go, short ones too;
    documents stay."""
    own = free_name(docs, "_own")  # a column n_removed of the documents is theirs
    out = linededup.without_later_lines(docs.withColumnRenamed("n_removed", own)).drop("n_removed").withColumnRenamed(own, "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays, as
    one row."""
    key = F.struct(_key().alias("id"), neardup.locator(_key(), F.col("text")).alias("loc"))
    found = neardup.near_duplicates(_keyed(docs), located=True).filter(~F.col("kept"))
    left = _without(docs, found.select(F.struct(F.col("doc_id").alias("id"), "loc")), key)
    # rows that repeat another in id and text, or in text if they have no id
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    held, name = free_name(docs, "_again"), free_name(docs, "_name")
    again = left.filter(worded).groupBy(key.alias(held)).agg(F.count("*").alias("n")).filter("n > 1").select(held)
    again = materialize(again, "repeated-documents")
    if again.isEmpty():
        return left
    again = F.broadcast(again) if again.count() <= SMALL else again
    once = left.filter(worded).join(again, key == F.col(held), "left_semi").withColumn(name, key).dropDuplicates([name]).select(*docs.columns)
    return left.join(again, worded & (key == F.col(held)), "left_anti").unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item has leaked go."""
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _without(docs, decontam.leaks(_by_row(docs), benchmark).select("doc_id"), _row())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    import public_tokenizers
    return packing.packed(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_later_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs


#: Learned scores, line sets and token ids are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL: str | None = None
