"""Venue and organisation lookups, and venue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.scores import ladder, weighted
from scholia.operators.contain import found_inside
from scholia.operators.dedup import near_names
from scholia.operators.graph import shared_folder
from scholia.operators.joins import best_match, small
from scholia.operators.windows import first_of


def normalize(rows: DataFrame, venue: str, mapping: DataFrame, canonicals: DataFrame, score, least: float = 0.9) -> DataFrame:
    """``normalized`` and ``confidence`` per row: the mapping first (1.0), then
    the best fuzzy match among the canonical names, else null. Names are matched
    once each, then joined back."""
    names = rows.select(F.col(venue).alias("_n")).distinct()
    exact = names.join(small(mapping.select(F.lower("raw").alias("_r"), "canonical")), F.lower("_n") == F.col("_r"), "left")
    rest = exact.filter("canonical is null").select("_n")
    fuzzy = best_match(rest, F.col("_n"), canonicals, "canonical", score, least, [("equal", F.lower("_n") == F.lower("_c"))])
    both = exact.filter("canonical is not null").select(F.col("_n").alias("name"), F.col("canonical").alias("match"), F.lit(1.0).alias("confidence")).unionByName(fuzzy.select("name", "match", "confidence"))
    return rows.join(both.select(F.col("name").alias("_k"), F.col("match").alias("normalized"), "confidence"), F.col(venue) == F.col("_k"), "left").drop("_k")


def mapping_update(mapping: DataFrame, learned: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Learned pairs of confidence .8 or more that name a canonical and aren't
    themselves, where the mapping has none yet."""
    ok = learned.filter("confidence >= 0.8 and raw <> canonical").join(small(canonicals.select("canonical").distinct()), "canonical", "left_semi")
    return mapping.select("raw", "canonical").unionByName(ok.join(mapping.select("raw"), "raw", "left_anti").select("raw", "canonical"))


def mapping_errors(mapping: DataFrame, canonicals: DataFrame) -> DataFrame:
    same = mapping.filter("raw = canonical").select("raw", F.lit("maps to itself").alias("error"))
    lost = mapping.join(canonicals.select("canonical").distinct(), "canonical", "left_anti").select("raw", F.lit("unknown target").alias("error"))
    return same.unionByName(lost)


def mapping_statistics(normalized: DataFrame, confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    return normalized.agg(F.count("*").alias("n"), F.count_if(c == 1).alias("exact"), F.count_if((c >= 0.95) & (c < 1)).alias("high"), F.count_if((c >= 0.9) & (c < 0.95)).alias("medium"), F.count_if(c.isNull()).alias("unmapped"))


# How sure each way to recognise an organisation is, and the types in order.
SURE = {"exact": 0.95, "email": 0.85, "alias": 0.9, "domain": 0.85}
FUZZY_FROM, FUZZY_SURE, FUZZY_GAIN, KEYWORD_EACH, KEYWORD_MOST = 0.8, 0.7, 0.15, 0.2, 0.7
TYPES = ["academic", "industry", "government", "non_profit"]


def organisations(rows: DataFrame, text: Column, dimension: DataFrame) -> DataFrame:
    """``org``, ``org_type``, ``org_by`` and ``org_confidence`` of affiliations.
    dimension: ordinal, name, type, aliases, domains, keywords.

    In order: a name inside the text; an e-mail's domain, then a domain inside
    the text, where there is an "@"; an alias inside; a domain inside, where
    there is none; a name or an alias whose ratio to the whole text is .8 or
    more, the best one (confidence .7 to .85); the type of whose organisations
    most keywords are inside (no organisation, .2 a keyword, .7 at most). Within
    one way the first organisation counts; an alias or domain that several have
    keeps its first place and belongs to the last. Null and blank texts and
    those that nothing recognises have none, and confidence 0."""
    low = F.lower(F.trim(text))
    shared_folder(rows.sparkSession)
    known = rows.select(low.alias("low")).filter("low <> ''").distinct().checkpoint()
    at = F.col("low").contains("@")

    def needles(arm: str, values: Column, by_org: bool = False) -> DataFrame:
        x = dimension.select("ordinal", "name", "type", F.posexplode(values).alias("i", "needle")).withColumn("needle", F.lower("needle"))
        if by_org:
            return x.select(F.lit(arm).alias("arm"), "ordinal", "i", "name", "type", "needle")
        one = x.groupBy("needle").agg(F.min(F.struct("ordinal", "i")).alias("_f"), F.max_by(F.struct("name", "type"), F.struct("ordinal", "i")).alias("_o"))
        return one.select(F.lit(arm).alias("arm"), "_f.ordinal", "_f.i", "_o.name", "_o.type", "needle")

    names, aliases, domains = needles("exact", F.array("name")), needles("alias", F.col("aliases")), needles("domain", F.col("domains"))
    words = needles("keyword", F.col("keywords"), by_org=True)
    every = names.unionByName(aliases).unionByName(domains)
    inside = found_inside(known, "low", every.unionByName(words), "needle").checkpoint()
    hit = inside.join(small(every), "needle")
    mail = known.filter(at).select("low", F.posexplode(F.regexp_extract_all("low", F.lit(r"@([\w.-]+\.\w+)"), 1)).alias("_k", "needle")).join(small(domains), "needle")
    mail = mail.select("low", F.lit("email").alias("arm"), F.col("_k").alias("ordinal"), F.lit(0).alias("i"), "name", "type")
    found = hit.select("low", "arm", "ordinal", "i", "name", "type").unionByName(mail)
    order = F.when(F.col("arm") == "exact", 0).when(F.col("arm") == "email", 1).when(F.col("arm") == "alias", F.when(at, 3).otherwise(2)).otherwise(F.when(at, 2).otherwise(3))
    best = first_of(found.withColumn("_o", order), ["low"], ["_o", "ordinal", "i"])
    sure = F.coalesce(*[F.when(F.col("arm") == k, v) for k, v in SURE.items()])
    best = best.select("low", F.col("name").alias("org"), F.col("type").alias("org_type"), F.when(F.col("arm") == "email", "domain").otherwise(F.col("arm")).alias("org_by"), sure.alias("org_confidence"))
    rest = known.join(best.select("low"), "low", "left_anti")
    whole = names.unionByName(aliases).withColumnRenamed("needle", "low")
    near = near_names(rest, whole, "low", FUZZY_FROM).join(small(whole.withColumnRenamed("low", "b")), "b")
    near = first_of(near.withColumn("_l", (F.col("arm") == "alias").cast("int")), ["a"], [F.desc("ratio"), "_l", "ordinal", "i"])
    fuzzy = near.select(F.col("a").alias("low"), F.col("name").alias("org"), F.col("type").alias("org_type"), F.lit("fuzzy").alias("org_by"), (FUZZY_SURE + FUZZY_GAIN * (F.col("ratio") - FUZZY_FROM) / (1 - FUZZY_FROM)).alias("org_confidence"))
    rest = rest.join(fuzzy.select("low"), "low", "left_anti")
    counts = inside.join(small(words), "needle").join(rest, "low", "left_semi").groupBy("low", "type").agg(F.count("*").alias("n"))
    top = first_of(counts, ["low"], [F.desc("n"), F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))])
    keyword = top.select("low", F.lit(None).cast("string").alias("org"), F.col("type").alias("org_type"), F.lit("keyword").alias("org_by"), F.least(F.lit(KEYWORD_MOST), F.col("n") * KEYWORD_EACH).alias("org_confidence"))
    told = best.unionByName(fuzzy).unionByName(keyword).withColumnRenamed("low", "_low")
    out = rows.join(told, low == F.col("_low"), "left").drop("_low")
    return out.withColumns({"org_type": F.coalesce("org_type", F.lit("unknown")), "org_by": F.coalesce("org_by", F.lit("none")), "org_confidence": F.coalesce("org_confidence", F.lit(0.0))})


def coverage(rows: DataFrame, names: Column, expected: DataFrame, org: str) -> DataFrame:
    """Rows that name each expected institution in any affiliation; 0 if none."""
    hits = rows.select(names.alias("_a")).join(small(expected.select(org)), F.exists("_a", lambda x: F.lower(x).contains(F.lower(F.col(org)))))
    return expected.select(org).join(hits.groupBy(org).agg(F.count("*").alias("n")), org, "left").na.fill(0, ["n"])


def venue_score(citations: Column, papers: Column, tier: Column, focus: Column, domains: Column) -> Column:
    """Five factors: impact .3, size .25, tier .2, focus .15, breadth .1; three digits."""
    size = ladder(papers, [(100, 1.0), (50, 0.8), (20, 0.6), (10, 0.4)], 0.2)
    tiers = F.when(tier == "tier1", 1.0).when(tier == "tier2", 0.8).when(tier == "tier3", 0.6).otherwise(0.4)
    return F.bround(weighted([(0.3, F.least(F.lit(1.0), citations / 100)), (0.25, size), (0.2, tiers), (0.15, focus), (0.1, F.least(F.lit(1.0), domains / 5))]), 3)


def domain_venues(rows: DataFrame, domain: str, venue: str, top: int = 3) -> DataFrame:
    """Per domain: rows, venues, and its ``top`` venues."""
    n = rows.groupBy(domain, venue).agg(F.count("*").alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy(domain).orderBy(F.desc("n"), venue)))
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", venue)))), lambda x: x[venue]), ", ")
    return ranked.groupBy(domain).agg(F.sum("n").alias("papers"), F.count("*").alias("venues"), best.alias("top"))


def venue_domains(rows: DataFrame, venue: str, domain: str) -> DataFrame:
    return rows.groupBy(venue).agg(F.array_join(F.array_sort(F.collect_set(domain)), ", ").alias("domains"), F.count("*").alias("n"))


def renamed_groups(rows: DataFrame, venue: str, key: Column, count: str) -> DataFrame:
    """Spellings that share a key: how many, the commonest, and their sum."""
    n = rows.groupBy(venue).agg(F.sum(count).alias("_n"))
    return n.groupBy(key.alias("key")).agg(F.count("*").alias("spellings"), F.max_by(F.col(venue), F.struct("_n", venue)).alias("canonical"), F.sum("_n").alias("n")).filter("spellings > 1")
