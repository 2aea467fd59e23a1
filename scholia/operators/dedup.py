"""Duplicate papers: by any of several keys, and by fuzzy titles and authors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import fuzzy
from scholia.functions.scores import match_confidence
from scholia.functions.text import title_key
from scholia.operators.graph import connected, shared_folder
from scholia.operators.greedy import first_by_any, leaders as led_groups  # noqa: F401
from scholia.operators.joins import small
from scholia.operators.windows import first_of


def _bigrams(names: DataFrame, name: str, least: float) -> DataFrame:
    """(name, n, token) of the prefix of each name: its bigrams (the k-th of a
    kind is a token of its own), rarest first, as many as any other name of an
    indel ratio of ``least`` must share one of. An edit breaks two bigrams at
    most, and the other name's length is bounded by the ratio."""
    n = F.length(name)
    rows = names.select(name, n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(F.col(name), i, F.lit(2)))).alias("g"))
    rows = rows.groupBy(name, "n", "g").agg(F.count("*").alias("c")).select(name, "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("c").cast("int")), lambda k: F.concat("g", F.lit("#"), k))).alias("token"))
    rows = rows.join(rows.groupBy("token").agg(F.count("*").alias("f")), "token")
    keep = (F.col("n") - 1) - F.greatest(F.lit(1), F.floor(F.col("n") - 1 - 4 * (1 - least) / least * F.col("n"))) + 1
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(name).orderBy("f", "token"))).filter((F.col("r") <= keep) & (F.col("f") > 1)).select(name, "n", "token")


def near_names(left: DataFrame, right: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, ratio): names of ``left`` and of ``right`` whose indel ratio is
    ``least`` or more, equal ones included. Names meet under a rare bigram."""
    x, y = (t.select(F.col(name).alias("_s")).filter("_s is not null").distinct() for t in (left, right))
    grams = _bigrams(x.unionByName(y).distinct(), "_s", least)
    a = grams.join(x, "_s", "left_semi").select(F.col("_s").alias("a"), F.col("n").alias("na"), "token")
    b = grams.join(y, "_s", "left_semi").select(F.col("_s").alias("b"), F.col("n").alias("nb"), "token")
    met = a.join(b, "token").filter((F.col("a") != F.col("b")) & (2 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb")))).select("a", "b").distinct()
    far = met.withColumn("ratio", fuzzy.similarity("ratio")("a", "b")).filter(F.col("ratio") >= least)
    return far.unionByName(x.join(y, "_s").select(F.col("_s").alias("a"), F.col("_s").alias("b"), F.lit(1.0).alias("ratio")))


def similar_titles(rows: DataFrame, title: str, least: float = 0.95) -> DataFrame:
    """(a, b, similarity, n_a, n_b): all pairs a < b of distinct titles whose
    blended similarity is ``least`` or more, and how many rows have each.

    The blend is half token-sort ratio, so that ratio must be 2 least - 1 or
    more (``least`` from .93 on): candidates share a rare bigram of their sorted
    words, which misses nothing. Equal titles are one title."""
    spread = rows.filter(F.col(title).isNotNull()).groupBy(F.col(title).alias("_t")).agg(F.count("*").alias("_n"))
    names = spread.withColumn("_s", F.array_join(F.array_sort(F.filter(F.split("_t", r"\s+"), lambda w: w != "")), " "))
    ratio = 2 * least - 1
    grams = _bigrams(names.select("_s").distinct(), "_s", ratio)
    x, y = grams.select(F.col("_s").alias("x"), F.col("n").alias("nx"), "token"), grams.select(F.col("_s").alias("y"), F.col("n").alias("ny"), "token")
    met = x.join(y, "token").filter((F.col("x") < F.col("y")) & (2 * F.least("nx", "ny") >= ratio * (F.col("nx") + F.col("ny")))).select("x", "y").distinct()
    met = met.unionByName(names.select(F.col("_s").alias("x"), F.col("_s").alias("y")).distinct())
    a, b = (names.select(F.col("_t").alias(k), F.col("_n").alias(f"n_{k}"), F.col("_s").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    one = met.unionByName(met.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y")))
    pairs = one.join(a, "x").join(b, "y").filter("a < b")
    return pairs.withColumn("similarity", fuzzy.similarity("title")("a", "b")).filter(F.col("similarity") >= least).select("a", "b", "similarity", "n_a", "n_b")


def _all_pairs(classes: DataFrame) -> DataFrame:
    """Every ordered pair of rows, itself included; for classes counted to be few."""
    x, y = (classes.select([F.col(c).alias(f"{c}_{s}") for c in classes.columns]) for s in "ab")
    return x.repartition(64).crossJoin(small(y))


def fuzzy_pairs(papers: DataFrame, ident: str, title: str, authors: str, title_least: float = 0.95, author_least: float = 0.85, venue_year=None) -> DataFrame:
    """Pairs of rows whose titles, and then authors, are alike, with the
    confidence of the match. Rows of one title and one author list are linked
    to the first of them, not to each other. Where many rows share few author
    lists, the lists are compared once, and rows meet under a pair of lists
    and a pair of titles that are alike."""
    p = _with_first(papers, ident, title, authors, venue_year)
    copies = p.filter(F.col(ident) > F.col("_first")).select(F.col("_first").alias("a"), F.col(ident).alias("b"), F.lit(1.0).alias("title_similarity"), F.lit(1.0).alias("author_similarity"), match_confidence(F.lit(1.0), F.lit(1.0), F.lit(venue_year is not None)).alias("confidence"))
    return _first_pairs(p, ident, authors, title_least, author_least, venue_year).unionByName(copies)


def _with_first(papers: DataFrame, ident: str, title: str, authors: str, venue_year=None) -> DataFrame:
    """``papers`` with ``_t``, the title's key, and ``_first``, the first row of
    the same title and author list; written, since it is read many times."""
    shared_folder(papers.sparkSession)
    p = papers.withColumn("_t", title_key(F.col(title))).withColumn("_k", F.xxhash64("_t", authors, *(venue_year or [])))
    return p.withColumn("_first", F.min(ident).over(Window.partitionBy("_k"))).drop("_k").checkpoint()


def _first_pairs(p: DataFrame, ident: str, authors: str, title_least: float, author_least: float, venue_year=None) -> DataFrame:
    """``fuzzy_pairs`` without copies, of rows from ``_with_first``."""
    firsts = p.filter(F.col(ident) == F.col("_first")).drop("_first")
    titles = similar_titles(firsts, "_t", title_least).select("a", "b", "similarity")
    same = firsts.select(F.col("_t").alias("a"), F.col("_t").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    titles = titles.unionByName(same).checkpoint()
    x, y = (firsts.select([F.col(c).alias(f"{c}_{s}") for c in firsts.columns]) for s in "ab")
    lists = firsts.select(F.col(authors).alias("_l")).distinct()
    each = firsts.groupBy("_t").agg(F.count("*").alias("n"))
    meetings = titles.join(each.select(F.col("_t").alias("a"), F.col("n").alias("na")), "a").join(each.select(F.col("_t").alias("b"), F.col("n").alias("nb")), "b").agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
    if lists.count() ** 2 <= (meetings or 0):
        near = _all_pairs(lists).withColumn("author_similarity", fuzzy.similarity("authors")("_l_a", "_l_b")).filter(F.col("author_similarity") >= author_least).checkpoint()
        # lists and texts as numbers: each row meets all lists near its own
        near = near.select(F.xxhash64("_l_a").alias("_la"), F.xxhash64("_l_b").alias("_lb"), "author_similarity")
        met = titles.select("a", "b", "similarity", F.xxhash64("a").alias("_ta"), F.xxhash64("b").alias("_tb"))
        kept, whole = [ident, *(venue_year or [])], firsts.filter(F.col("_t").isNotNull() & F.col(authors).isNotNull())
        x, y = (whole.select(*[F.col(c).alias(f"{c}_{e}") for c in kept], F.xxhash64("_t").alias(f"_t{e}"), F.xxhash64(authors).alias(f"_l{e}")) for e in "ab")
        met = x.join(small(near), "_la").join(small(met), "_ta").join(small(y), ["_tb", "_lb"])
    else:
        met = titles.join(x, F.col("a") == F.col("_t_a")).join(y, F.col("b") == F.col("_t_b"))
    met = met.filter((F.col("a") != F.col("b")) | (F.col(f"{ident}_a") < F.col(f"{ident}_b")))
    if "author_similarity" not in met.columns:
        met = met.withColumn("author_similarity", fuzzy.similarity("authors")(f"{authors}_a", f"{authors}_b")).filter(F.col("author_similarity") >= author_least)
    equal = F.lit(False) if venue_year is None else reduce(lambda a, b: a & b, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in venue_year])
    ends = [f(f"{ident}_a", f"{ident}_b") for f in (F.least, F.greatest)]
    return met.select(ends[0].alias("a"), ends[1].alias("b"), F.col("similarity").alias("title_similarity"), "author_similarity", match_confidence(F.col("similarity"), F.col("author_similarity"), equal).alias("confidence"))


#: Weights of titles, authors, years and venues, and what years that differ are worth.
BLEND, OTHER_YEAR = (0.6, 0.2, 0.1, 0.1), 0.5


def blended_pairs(papers: DataFrame, ident: str, title: str, authors: str, year: str, venue: str, least: float = 0.85) -> DataFrame:
    """(a, b, score): pairs a < b whose blend of title ratio, author Jaccard,
    year and venue ratio is ``least`` or more. Above .8 that takes a common
    author and titles of a ratio of (least - .4) / .6 at least. So distinct
    (title, venue) texts that an author has both of are compared once each (all
    texts with each other, where those pairs are fewer), and rows meet under an
    author and a pair of texts that is alike enough; none is missed."""
    p = papers.select(F.col(ident).alias("id"), F.lower(title).alias("t"), F.array_distinct(F.transform(authors, lambda x: F.lower(x))).alias("au"), F.col(year).alias("y"), F.lower(venue).alias("v")).filter("t is not null and v is not null")
    shared_folder(papers.sparkSession)
    by = p.select("t", "v", F.explode("au").alias("n")).distinct()
    texts = by.select("t", "v").distinct()
    meetings = by.groupBy("n").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    if texts.count() ** 2 <= (meetings or 0):
        met = _all_pairs(texts)
    else:
        x, y = (by.select(F.col("t").alias(f"t_{s}"), F.col("v").alias(f"v_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
        met = x.join(y, F.col("n_a").eqNullSafe(F.col("n_b"))).select("t_a", "v_a", "t_b", "v_b")
    ratio = (least - BLEND[1] - BLEND[2] - BLEND[3]) / BLEND[0] - 1e-9
    na, nb = F.length("t_a"), F.length("t_b")
    like = fuzzy.similarity("difflib")
    met = met.filter(2 * F.least(na, nb) >= ratio * (na + nb)).distinct()
    alike = met.withColumn("lt", like("t_a", "t_b")).filter(F.col("lt") >= ratio).withColumn("lv", like("v_a", "v_b")).filter(BLEND[0] * F.col("lt") + BLEND[3] * F.col("lv") >= least - BLEND[1] - BLEND[2] - 1e-9).checkpoint()
    x, y = (p.select(F.col("id").alias(s), F.col("t").alias(f"t_{s}"), F.col("v").alias(f"v_{s}"), F.col("au").alias(f"au_{s}"), F.col("y").alias(f"y_{s}"), F.explode("au").alias(f"n_{s}")) for s in "ab")
    alike = small(alike.withColumnsRenamed({"t_b": "_t", "v_b": "_v"}))
    met = x.join(alike, ["t_a", "v_a"]).join(y, F.col("n_a").eqNullSafe(F.col("n_b")) & (F.col("_t") == F.col("t_b")) & (F.col("_v") == F.col("v_b")) & (F.col("a") < F.col("b")))
    both = F.array_intersect("au_a", "au_b")
    rest = BLEND[1] * (F.size(both) / F.size(F.array_union("au_a", "au_b"))) + BLEND[2] * F.when(F.col("y_a").eqNullSafe(F.col("y_b")), 1.0).otherwise(OTHER_YEAR)
    # under the first of the authors they share alone, so that a pair comes once
    met = met.filter(F.col("n_a").eqNullSafe(F.get(both, F.lit(0)))).withColumn("score", BLEND[0] * F.col("lt") + rest + BLEND[3] * F.col("lv"))
    return met.select("a", "b", "score").filter(F.col("score") >= least)


def blended_groups(papers: DataFrame, ident: str, title: str, authors: str, year: str, venue: str, least: float = 0.85) -> DataFrame:
    """``papers`` with ``leader``, by ``blended_pairs`` in order of ``ident``.
    Rows that say the same are taken with the first of them, so only first rows
    are paired. Without title, venue or authors a row is like none, not even
    its copies, and leads itself."""
    keys = {"_t": F.lower(title), "_au": F.array_sort(F.array_distinct(F.transform(authors, lambda x: F.lower(x)))), "_y": F.col(year), "_v": F.lower(venue)}
    p = papers.withColumns(keys).withColumn("_own", F.when(F.col("_t").isNull() | F.col("_v").isNull() | (F.coalesce(F.size("_au"), F.lit(0)) < 1), F.col(ident)))
    same = [*keys, "_own"]
    firsts = p.groupBy(*same).agg(F.min(ident).alias("_first"))
    shared_folder(papers.sparkSession)
    pairs = blended_pairs(firsts.filter("_own is null"), "_first", "_t", "_au", "_y", "_v", least).select("a", "b").checkpoint()
    led = led_groups(firsts, "_first", pairs)
    of = led.select("leader", *[F.col(c).alias(f"{c}_led") for c in same])
    on = [F.col(c).eqNullSafe(F.col(f"{c}_led")) for c in same]
    return p.join(of, on).select(*papers.columns, "leader")


def best_of_groups(rows: DataFrame, ident: str, pairs: DataFrame, order: list) -> DataFrame:
    """One row of each group of linked rows, by ``order``; unlinked rows stay."""
    comp = connected(pairs)
    x = rows.join(comp.withColumnRenamed("node", ident), ident, "left").withColumn("root", F.coalesce("root", ident))
    return first_of(x, ["root"], [*order, ident]).drop("root")


def fuzzy_best(papers: DataFrame, ident: str, title: str, authors: str, order: list, title_least: float = 0.95, author_least: float = 0.85) -> DataFrame:
    """``best_of_groups`` by ``fuzzy_pairs``. Only first rows are grouped; their
    copies go where they go."""
    p = _with_first(papers, ident, title, authors)
    comp = connected(_first_pairs(p, ident, authors, title_least, author_least))
    x = p.join(comp.withColumnRenamed("node", "_first"), "_first", "left").withColumn("root", F.coalesce("root", "_first"))
    return first_of(x, ["root"], [*order, ident]).select(*papers.columns)


def statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("records")), after.agg(F.count("*").alias("kept"))
    return a.crossJoin(F.broadcast(b)).withColumn("merge_rate", F.coalesce(1 - F.try_divide("kept", "records"), F.lit(0.0)))
