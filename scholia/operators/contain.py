"""Which texts contain which passages, word for word.

A passage's inner words (not its first or last, which the text may continue)
stand in a text that contains it as they are. So a passage and a text meet
under a hash of WIDTH consecutive inner words: the one of the passage's that
the fewest texts have, counted over all texts. What meets is verified on the
texts. Passages with fewer inner words have no such gram; they are compared
with each text, which is meant for a few of them.

Null or empty passages and null texts match nothing. Rows that repeat are
separate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.graph import shared_folder
from scholia.operators.joins import SMALL, small

WIDTH = 3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _grams(words: Column, width: int = WIDTH) -> Column:
    """The distinct hashes of ``width`` consecutive words. The words are bound
    by a lambda: read from the expression, a text would be split again for each."""
    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    return F.array_distinct(F.get(F.transform(F.array(words), of), F.lit(0)))


def containing(texts: DataFrame, ident: str, text: str, passages: DataFrame, key: str, passage: str) -> DataFrame:
    """(ident, key) of each text row and passage row that it contains. ``ident``
    names rows of texts, ``key`` rows of passages."""
    t = texts.select(F.col(ident).alias("_i"), F.col(text).alias("_t")).filter("_t is not null")
    p = passages.select(F.col(key).alias("_k"), F.col(passage).alias("_p")).filter("_p is not null and _p <> ''")
    p = p.withColumn("_w", _words(F.col("_p"))).withColumn("_w", F.slice("_w", F.lit(2), F.greatest(F.lit(0), F.size("_w") - 2)))
    long = F.size("_w") >= WIDTH
    own = p.filter(long).select("_k", "_p", F.explode(_grams(F.col("_w"))).alias("_g"))
    said = t.select(F.explode(_grams(_words(F.col("_t")))).alias("_g"))
    often = said.join(small(own.select("_g").distinct()), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_n"))
    # a gram that no text has is the rarest, and its passage is nowhere
    rare = own.join(often, "_g", "left").groupBy("_k", "_p").agg(F.min_by(F.struct("_g", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_r"))
    shared_folder(texts.sparkSession)
    rare = rare.filter("_r._n is not null").select("_k", "_p", F.col("_r._g").alias("_g")).checkpoint()  # the count over the texts is done once
    if rare.limit(SMALL + 1).count() <= SMALL:
        met = t.select("_i", "_t", F.explode(_grams(_words(F.col("_t")))).alias("_g")).join(F.broadcast(rare), "_g")
    else:  # texts travel once, behind the pairs
        pairs = t.select("_i", F.explode(_grams(_words(F.col("_t")))).alias("_g")).join(rare.select("_k", "_g"), "_g").select("_i", "_k").distinct()
        met = pairs.join(t, "_i").join(p.select("_k", "_p"), "_k")
    found = met.filter(F.contains("_t", "_p")).select("_i", "_k")
    few = p.filter(~long)
    if not few.isEmpty():
        found = found.unionByName(t.join(small(few), F.contains("_t", "_p")).select("_i", "_k"))
    return found.select(F.col("_i").alias(ident), F.col("_k").alias(key))


LETTERS = 3


def _letters(c: Column, width: int = LETTERS) -> Column:
    starts = F.when(F.length(c) >= width, F.sequence(F.lit(1), F.length(c) - (width - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(width))))


def found_inside(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(text, needle): which of the distinct short texts (names, affiliations)
    hold which needles anywhere. A needle meets the texts that have its rarest
    three letters, counted over the texts; needles of one or two letters are
    compared with every text, so there should be few of them."""
    t = texts.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    p = needles.select(F.col(needle).alias("_p")).filter("_p is not null and _p <> ''").distinct()
    said = t.select("_t", F.explode(_letters(F.col("_t"))).alias("_g"))
    own = p.filter(F.length("_p") >= LETTERS).select("_p", F.explode(_letters(F.col("_p"))).alias("_g"))
    often = said.join(small(own.select("_g").distinct()), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_n"))
    shared_folder(texts.sparkSession)
    rare = own.join(often, "_g", "left").groupBy("_p").agg(F.min_by(F.struct("_g", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_r")).filter("_r._n is not null").select("_p", F.col("_r._g").alias("_g")).checkpoint()
    found = said.join(small(rare), "_g").filter(F.contains("_t", "_p")).select("_t", "_p")
    short = p.filter(F.length("_p") < LETTERS)
    if not short.isEmpty():
        found = found.unionByName(t.join(small(short), F.contains("_t", "_p")).select("_t", "_p"))
    return found.select(F.col("_t").alias(text), F.col("_p").alias(needle))
