"""Line de-duplication [native]: an exact set-similarity join over lines.

A line's set is its distinct 5-word shingles (lower-cased, all of Unicode). A
line with fewer words is one token, its whole sequence, so it goes where it
equals an earlier line. A line is removed when an earlier line, in order of
(doc_id, hash of the text, line number), has an equal set, or one with
100 * intersection >= percent * union. The first of similar lines always stays.

1. Lines with equal words are counted by key with a partial aggregate; only one
   of them, the first, takes part in the join. Short lines end here.
2. Of each line some 5-word shingles are selected by the order of their first
   words (``_meeting``), hashed, and dealt out once. Only lines that share ``ELL``
   of them or more with lines of other words go on, with their whole sets of
   64-bit shingle hashes; all compiled, without a lambda over every word.
3. Tokens are ordered by rarity: how many tokens share the token's bucket of
   ``BUCKETS`` (a count of bounded size, on a scale of 127 steps), then hash.
   Prefix filter: two lines that match share ``ELL`` tokens or more among their
   first ``n - ceil(0.75 n) + ELL`` (``ELL`` less for tiny sets).
4. Tokens of one line drop out; of the others the earliest line is the hub. Pairs (line, hub) that share enough
   prefix tokens and pass the length and positional filters are verified on
   full sets; a line that matches its hub is done.
5. Lines that no hub explains are compared with *all* earlier lines under their
   tokens. Where at most ``CROWD`` lines have a token, pairs that share enough
   such tokens are verified; a pair that misses that count shares a token that
   more lines have, and those are compared by a left semi join whose condition
   is the filters (also by maps of 256 bits of the sets) and the Jaccard test
   itself: it returns lines, never pairs.

Only DataFrame expressions; a family of thousands of variants costs rows in
proportion to its lines. Small lists (checked by count) are broadcast, larger
ones are joined by shuffling.

Results for special input: null text stays null; empty lines stay; rows that
share a doc_id, or have none, are documents of their own, in order of their
texts' hashes; of rows that repeat another wholly, all but one lose all their
lines; a null doc_id is the smallest; very long lines are ordinary; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import keep, materialize, scratch, table

WIDTH, PERCENT, ELL = 5, 75, 4
BUCKETS = 1 << 16
#: Lines of one token up to which they are paired.
CROWD = 256
#: Rows up to which a list is broadcast (at most 40 bytes each); the driver
#: holds such a list three times while it is made.
SMALL = 400_000
#: Line numbers up to which the lists of a text's lines to remove are broadcast.
LINES = 1_500_000
#: Bits of the map that tells most tokens of one line alone from shared ones.
MARKS = 1 << 22
BREAKS = "[ \\t\\x0B\\f\\r]+"


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its count allows it."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _marked(tokens: DataFrame, t: str) -> Column:
    """Holds for every ``t`` of ``tokens`` and for few others, as long as they
    are few beside ``MARKS``: a map of bits, of bounded size."""
    slot = F.col(t).bitwiseAND(MARKS - 1)
    bit = F.expr(f"shiftleft(1L, `{t}` & 63)")
    words = [0] * (MARKS >> 6)
    for w, bits in tokens.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(bit)).collect():  # MARKS / 64 rows at most
        words[w] = bits
    of = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return F.get(of, F.shiftright(slot, 6)).bitwiseAND(bit) != 0


class _Rows:
    """How a line is named. ``ord`` orders lines by (doc_id, hash of the text,
    line number), nulls first, and is unique but for repeated rows: one long
    where ids are unique and below 2^32, else a struct of the three."""

    def __init__(self, docs: DataFrame):
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
        self.packed = (low is None or low >= 0 and high < (1 << 32) - 1) and ids.groupBy("doc_id").count().filter("count > 1").isEmpty()

    def key(self) -> Column:
        """What names a row of documents; line 0 of it, so to speak."""
        doc = F.col("doc_id").cast("long")
        if self.packed:
            return F.coalesce(doc + 1, F.lit(0))
        return F.struct(doc.alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("tie"))

    def place(self, key: str, line_no: str) -> Column:
        if self.packed:
            return F.shiftleft(key, 31) + F.col(line_no)
        return F.struct(F.col(key)["doc"].alias("doc"), F.col(key)["tie"].alias("tie"), F.col(line_no).alias("line_no"))

    def parts(self, ord: str = "ord") -> list[Column]:
        """key and line_no of a place."""
        if self.packed:
            return [F.shiftrightunsigned(ord, 31).alias("key"), F.col(ord).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line_no")]
        return [F.struct(F.col(ord)["doc"].alias("doc"), F.col(ord)["tie"].alias("tie")).alias("key"), F.col(ord)["line_no"].alias("line_no")]


def _split_lines() -> Column:
    """The lower-cased lines of a text, with single spaces for runs of white
    space; rewritten only in texts that have any other than spaces and line ends."""
    text = F.col("text").cast("string")
    odd = text.contains("  ")
    for c in "\t\x0b\f\r":
        odd = odd | text.contains(c)
    # lower last: generators evaluate an expression as often as it is written
    return F.split(F.lower(F.when(odd, F.regexp_replace(text, BREAKS, " ")).otherwise(text)), "\n", -1)


def _spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def _bound(value: Column, function) -> Column:
    """``function`` of a value that is evaluated once, however often it is used
    and however the plan is rewritten."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _with_words(lines: DataFrame, line: str, *columns) -> DataFrame:
    """``columns`` and ``h``, the hashes of each line's words. The generator is a
    barrier: nothing above it evaluates the words again."""
    return lines.select(*columns, F.explode(F.array(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))).alias("h"))


def _shingles(hash_) -> Column:
    """The distinct shingles, as ``hash_`` of the hashes ``h`` of their words;
    none for fewer than ``WIDTH`` words."""
    made = F.transform("h", lambda x, i: hash_(x, *[F.get("h", i + j) for j in range(1, WIDTH)]))
    return F.array_distinct(F.slice(made, 1, F.greatest(F.size("h") - (WIDTH - 1), F.lit(0))))


def _line_key() -> Column:
    """62 bits of a hash of the line; the two lowest are free."""
    return F.xxhash64("line").bitwiseAND(F.lit(-4))


def _meeting(lines: DataFrame) -> DataFrame:
    """(k): keys of the lines that share ``_ell`` selected shingles or more with
    lines of other words; among them is every line that has a similar one.

    Selected are the shingles whose first word is at most the line's bound, the
    ``n - _need(l) + _ell(l)``-th of its n first words in their order, where l, the
    distinct words (n at most), is no more than its distinct shingles. So at most
    ``_need(l) - _ell(l)`` distinct shingles are not selected, and of ``_need`` that
    two similar lines share, ``_ell`` have first words up to the lower of their
    bounds: those are selected in both."""
    words = lines.select(_line_key().alias("k"), F.split("line", " ").alias("w"))
    n = F.greatest(F.size("w") - (WIDTH - 1), F.lit(1))
    least = words.select("k", "w", n.alias("n"), F.least(n, F.size(F.array_distinct("w"))).alias("l"))
    bound = F.element_at(F.sort_array(F.slice("w", 1, F.col("n"))), F.col("n") - _need(F.col("l")) + _ell(F.col("l")))
    least = least.select((F.col("k") + _ell(F.col("l")) - 1).alias("k"), "w", (F.size("w") - (WIDTH - 1)).alias("n"), bound.alias("most"))
    # outer: else the plan splits each line again to ask whether it has any words
    each = least.select("k", "w", "n", "most", F.posexplode_outer("w").alias("i", "first"))
    tokens = each.filter((F.col("i") < F.col("n")) & (F.col("first") <= F.col("most"))).select("k", F.xxhash64(F.slice("w", F.col("i") + 1, WIDTH)).alias("t"))
    same = Window.partitionBy("t")
    shared = tokens.select("k", "t", F.min("k").over(same).alias("a"), F.max("k").over(same).alias("b")).filter("a <> b").select("k", "t").distinct()
    return shared.groupBy("k").count().filter(F.col("count") > F.col("k").bitwiseAND(3)).select(F.col("k").bitwiseAND(F.lit(-4)).alias("k"))


def _whole_sets(docs: DataFrame, rows: _Rows, some: DataFrame) -> DataFrame:
    """(ord, items): the sets of the lines ``some``, from their documents."""
    wanted = materialize(some.select(*rows.parts()).groupBy("key").agg(F.collect_list("line_no").alias("_wanted")).withColumnRenamed("key", "_of"), "documents-that-meet")
    texts = docs.select(rows.key().alias("_key"), "text").join(_small(wanted), F.col("_key") == F.col("_of"))
    texts = texts.select("_key", F.inline(_bound(_split_lines(), lambda x: F.transform("_wanted", lambda i: F.struct(i.alias("_no"), F.trim(F.get(x, i)).alias("_line"))))))
    full = materialize(_with_words(texts, "_line", rows.place("_key", "_no").alias("ord")).select("ord", _shingles(F.xxhash64).alias("items")), "line-sets")
    if full.count() != some.count():  # repeated rows
        full = materialize(full.dropDuplicates(["ord"]), "line-sets")
    return full


def _checked(pairs: DataFrame, full: DataFrame, other: str) -> DataFrame:
    """The lines of written ``pairs`` (ord, other) whose sets are similar. Sets
    are wide and pairs are not: where their count allows, the pairs go to the
    sets, and only the sets that occur are dealt out."""
    keys = _small(materialize(pairs.select(other).distinct(), "pair-keys"))
    theirs = full.select(F.col("ord").alias(other), F.col("items").alias("theirs")).join(keys, other, "left_semi")
    both = full.join(_small(pairs), "ord").join(theirs, other)
    return both.filter(similar(F.col("items"), F.col("theirs"), F.size("items"), F.size("theirs"))).select("ord").distinct()


def _need(n: Column) -> Column:
    """The least intersection with any set that a set of n can match."""
    return F.ceil(n * PERCENT / F.lit(100)).cast("int")


def _ell(n: Column) -> Column:
    return F.least(F.lit(ELL), _need(n))


def similar(a: Column, b: Column, na: Column, nb: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= PERCENT * (na + nb - common)


def _could(nx, ny, i, j) -> Column:
    """Length and positional filter for a token at i of x and j of y."""
    least = F.ceil((nx + ny) * PERCENT / F.lit(100 + PERCENT))
    return (100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)) & (F.least(i, j) + 1 + F.least(nx - i - 1, ny - j - 1) >= least)


def _bits(name: str) -> list[Column]:
    """A map of 256 bits of the set ``items``: ``name``0 to ``name``3."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def bits(j: int) -> Column:
        def add(a, t):
            bit = F.call_function("shiftleft", one, F.shiftright(t, 2).bitwiseAND(63).cast("int"))
            return a.bitwiseOR(F.when(t.bitwiseAND(3) == j, bit).otherwise(none))

        return F.aggregate("items", none, add).alias(f"{name}{j}")

    return [bits(j) for j in range(4)]


def _bits_allow(nx: Column, ny: Column) -> Column:
    """Holds for all similar sets: a bit of one map alone is an element of that
    set alone, and similar sets have few of those."""
    least = F.ceil((nx + ny) * PERCENT / F.lit(100 + PERCENT))
    alone = lambda a, b: sum((F.bit_count(F.col(f"{a}{j}").bitwiseAND(F.bitwise_not(f"{b}{j}"))) for j in range(4)), F.lit(0))
    return (alone("x", "y") <= nx - least) & (alone("y", "x") <= ny - least)


def later_lines(docs: DataFrame, rows: _Rows, least_words: int = 1) -> DataFrame:
    """(key, line_no) of the lines to remove, as ``rows`` names them."""
    found = docs.select(rows.key().alias("_key"), F.posexplode(_split_lines()).alias("_no", "_line"))
    lines = found.select(rows.place("_key", "_no").alias("ord"), F.trim("_line").alias("line")).filter("line <> ''")
    if least_words > 1:
        lines = lines.filter(_spaces(F.col("line")) >= least_words - 1)
    keys = materialize(lines.select("ord", _line_key().alias("k"), F.xxhash64("line", F.lit(1)).alias("k2")), "lines")
    # equal lines
    again = materialize(keys.groupBy("k", "k2").agg(F.count("*").alias("c"), F.min("ord").alias("first")).filter("c > 1").select("k", "k2", "first"), "equal-lines")
    copies = keys.join(_small(again), ["k", "k2"]).filter("ord > first").select("ord")
    # of lines that share selected shingles with others, the first of equal ones, with their whole sets
    met = materialize(_meeting(lines), "meeting-lines")
    enough = materialize(keys.join(_small(met), "k", "left_semi").groupBy("k", "k2").agg(F.min("ord").alias("ord")).select("ord"), "lines-that-meet")
    full = _whole_sets(docs, rows, enough)
    # rarity: a step for every eighth part of a doubling of its bucket's count, above 32 bits of the token
    counted = full.select(F.explode("items").alias("t")).groupBy(F.col("t").bitwiseAND(BUCKETS - 1).alias("b")).count()
    counts = {b: c for b, c in counted.collect()}  # BUCKETS rows at most
    least = min(counts.values(), default=0)
    digits = [min(127, int(8 * math.log2(1 + counts.get(b, least) - least))) for b in range(BUCKETS)]
    rank = F.split(F.lit(",".join(map(str, digits))), ",").cast("array<tinyint>")
    # prefixes
    n = F.size("items")
    ranked = F.sort_array(F.transform("items", lambda t: F.coalesce(F.shiftleft(F.get("_rank", t.bitwiseAND(BUCKETS - 1)).cast("long"), 33) + t.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0))))
    prefix = full.withColumn("_rank", rank).select("ord", n.alias("n"), F.posexplode(F.slice(ranked, 1, F.least(n, n - _need(n) + _ell(n)))).alias("i", "_t"))
    prefix = materialize(prefix.select("ord", "n", "i", F.shiftright(F.shiftleft("_t", 32), 32).cast("int").alias("t")), "line-prefixes")
    # hubs: the first line of each token that has others
    hubs = materialize(prefix.groupBy("t").agg(F.min("ord").alias("hub"), F.count("*").alias("m")).filter("m > 1"), "hubs")
    places = materialize(prefix.join(_small(hubs), "t"), "places")
    hub_of = places.filter("ord = hub").select("t", F.col("n").alias("hn"), F.col("i").alias("hi"))
    met = places.filter("hub < ord").join(hub_of, "t").filter(_could(F.col("n"), F.col("hn"), F.col("i"), F.col("hi")))
    pairs = met.groupBy("ord", "hub", "n", "hn").agg(F.count("*").alias("m")).filter(F.col("m") >= F.least(_ell(F.col("n")), _ell(F.col("hn")))).select("ord", "hub")
    pairs = materialize(pairs, "hub-pairs")
    explained = materialize(_checked(pairs, full, "hub"), "explained")
    # the rest, under tokens that few lines have: pairs that share enough of them
    left = materialize(places.join(_small(explained), "ord", "left_anti").select("t", "ord", "n", "i", "m"), "unexplained")
    theirs = places.select(F.col("ord").alias("oy"), F.col("n").alias("ny"), F.col("i").alias("j"), F.col("t").alias("ty"), "m")
    rare, common = theirs.filter(F.col("m") <= CROWD).drop("m"), theirs.filter(F.col("m") > CROWD).drop("m")
    could = (F.col("t") == F.col("ty")) & (F.col("oy") < F.col("ord")) & _could(F.col("n"), F.col("ny"), F.col("i"), F.col("j"))
    met = left.filter(F.col("m") <= CROWD).drop("m").join(rare, could)
    pairs = met.groupBy("ord", "oy", "n", "ny").agg(F.count("*").alias("m")).filter(F.col("m") >= F.least(_ell(F.col("n")), _ell(F.col("ny")))).select("ord", "oy")
    pairs = materialize(pairs, "line-pairs")
    some = materialize(_checked(pairs, full, "oy"), "explained-by-pairs")
    # under tokens that many lines have: a semi join that tests as it joins
    ours = materialize(left.filter(F.col("m") > CROWD).drop("m").join(_small(some), "ord", "left_anti"), "open-places")
    asked = _small(materialize(ours.select(F.col("t").alias("ty")).distinct(), "open-tokens"))
    theirs = materialize(common.join(asked, "ty"), "earlier-places")
    ours = materialize(full.join(_small(ours), "ord").select("*", *_bits("x")), "open-lines")
    theirs = full.select(F.col("ord").alias("oy"), "items", *_bits("y")).withColumnRenamed("items", "theirs").join(_small(theirs), "oy")
    theirs = materialize(theirs, "earlier-lines")
    more = ours.join(theirs, could & _bits_allow(F.col("n"), F.col("ny")) & similar(F.col("items"), F.col("theirs"), F.col("n"), F.col("ny")), "left_semi").select("ord")
    near = materialize(explained.unionByName(some).unionByName(more).distinct(), "near-lines")
    # a near line's later copies have gone as copies already
    gone = copies.unionByName(near).distinct()
    return materialize(gone.select(*rows.parts()), "later-lines")


def _removed(docs: DataFrame, goes) -> DataFrame:
    """(doc_id, text, n_removed, _rest) without the lines for which
    ``goes(line, number)`` holds; texts that lose none are left as they are."""
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    lost = F.coalesce(F.size(F.filter(lines, goes)), F.lit(0))
    kept = F.array_join(F.filter(lines, lambda x, i: ~goes(x, i)), "\n")
    text = F.when(lost > 0, kept).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"), F.greatest(lost, F.lit(0)).cast("long").alias("n_removed"), "_rest")


def without_later_lines(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """``docs`` with its texts' later lines taken out, and ``n_removed``, their
    number; lines under ``least_words`` words are left alone. Of rows that repeat
    another wholly (id and text), one keeps what the first such row keeps, and
    the others lose all their lines."""
    pair = docs.select("doc_id", "text")
    rows = _Rows(pair)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_removed")]
    # whatever the other columns are called, they travel under one name
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0)]).alias("_rest"))
    later = None
    with scratch(docs.sparkSession):
        gone = later_lines(pair, rows, least_words)
        lists = gone.groupBy("key").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("key", "_of")
        lists = keep(materialize(lists, "lines-to-remove"))
    if not rows.packed:
        again = materialize(pair.groupBy(rows.key().alias("_of")).count().filter("count > 1").select("_of"), "repeated-documents")
        if not again.isEmpty():
            again = _small(again)
            same = rows.key() == F.col("_of")
            many = materialize(whole.join(again, same).withColumn("_n", F.monotonically_increasing_id()), "rows-that-repeat")
            first = materialize(many.groupBy("_of").agg(F.min("_n").alias("_n")).select("_n"), "first-of-repeats")
            first = _small(first)
            later = many.join(first, "_n", "left_anti").select(*whole.columns)
            whole = whole.join(again, same, "left_anti").unionByName(many.join(first, "_n", "left_semi").select(*whole.columns))
    size = lists.agg(F.count("*"), F.sum(F.size("_gone"))).first()
    lists = F.broadcast(lists) if size[0] <= SMALL // 2 and (size[1] or 0) <= LINES else lists
    out = whole.join(lists, rows.key() == F.col("_of"), "left")
    out = _removed(out, lambda x, i: F.coalesce(F.array_contains(F.col("_gone"), i), F.lit(False)))
    if later is not None:
        def worded(x, _):
            plain = F.trim(F.regexp_replace(x, BREAKS, " "))
            return (plain != "") & (_spaces(plain) >= least_words - 1)

        out = out.unionByName(_removed(later, worded))
    told = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[told[c] if c in told else F.col("_rest")[c].alias(c) for c in docs.columns if c != "n_removed"], "n_removed")


def op9(spark, sf_dir: str) -> DataFrame:
    out = without_later_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
