"""Queries over venues, domains, duplicates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import fuzzy
from scholia.operators import dedup, domains, quality, reports, venues
from scholia.plans.base import AS_OF, papers, query, rounded, table

TAXONOMY = {"prose": ["license", "licensed"], "contact": ["@"], "numbers": ["[0-9]{3}"], "symbols": ["\\\\|", "%%%"]}
TAX_SQL = {k: "|".join(w.replace("\\\\|", "\\|") for w in v) for k, v in TAXONOMY.items()}
TAXONOMY = {k: [w.replace("\\\\|", "\\|") for w in v] for k, v in TAXONOMY.items()}
MULTI = "m as (" + " union all ".join(f"select doc_id, '{k}' as category from documents where regexp_matches(lower(text), '{p}')" for k, p in TAX_SQL.items()) + "), multi as (select * from m union all select doc_id, 'other' from documents where doc_id not in (select doc_id from m))"
SINGLE = "single as (select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{k}'" for k, p in TAX_SQL.items()) + " else 'other' end as category from documents)"


def _multi(spark, d):
    return domains.multi_label(table(spark, d, "documents"), "doc_id", F.col("text"), TAXONOMY)


def _single(spark, d):
    return domains.single_label(table(spark, d, "documents"), "doc_id", F.col("text"), TAXONOMY)


@query("multi_label", f"with {MULTI} select category, count(*) as n from multi group by 1")
def multi_label(spark, d):
    return _multi(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query("label_inflation", f"with {MULTI}, {SINGLE}, a as (select category, count(*) as multi from multi group by 1), b as (select category, count(*) as single from single group by 1) select category, coalesce(multi, 0) as multi, coalesce(single, 0) as single, round(coalesce(multi / nullif(single, 0), 0), 6) as inflation from a full join b using (category)")
def label_inflation(spark, d):
    return rounded(domains.inflation(_multi(spark, d), _single(spark, d)))


@query("label_agreement", f"with {MULTI}, {SINGLE} select category, case when s.doc_id is null then 'left_only' when m.doc_id is null then 'right_only' else 'both' end as side, count(*) as n from (select distinct doc_id, category from multi) m full join (select distinct doc_id, category from single) s using (doc_id, category) group by 1, 2")
def label_agreement(spark, d):
    return domains.agreement(_multi(spark, d), _single(spark, d), "doc_id", "category")


@query("other_drill_down", f"with {MULTI} select source, count(*) as n from documents where doc_id in (select doc_id from multi where category = 'other') group by 1 order by n desc, source limit 20")
def other_drill_down(spark, d):
    return domains.drill_down(_multi(spark, d), "doc_id", "category", "other", table(spark, d, "documents").select("doc_id", "source"), "source")


@query("detection_rates", "with r as (select source, count(*) as n, count(*) filter (contains(text, '@')) as found from documents group by 1), t as (select sum(found) / sum(n) as a from r) select source, n, found, round(found / n, 6) as rate, round(found / n / a, 6) as factor from r, t")
def detection_rates(spark, d):
    return rounded(domains.correction_factors(domains.detection_rates(table(spark, d, "documents"), "source", F.col("text").contains("@"))))


@query("blended_corrections", "with {papers}, r as (select domain, count(*) as n, count(*) filter (citations >= 100) as found from papers group by 1), c as (select *, .7 * coalesce(n / nullif(found / n, 0), n) + .3 * n as c from r) select domain, round(c * 1444 / sum(c) over (), 6) as corrected from c")
def blended_corrections(spark, d):
    r = domains.detection_rates(papers(spark, d), "domain", F.col("citations") >= 100)
    return rounded(domains.blended_counts(r, 1444.0).select("domain", "corrected"))


@query("paper_funnel", "with {papers} select 0 as step, 'cited' as name, count(*) filter (citations >= 50) as n, count(*) filter (not citations >= 50) as lost from papers union all select 1, 'recent', count(*) filter (citations >= 50 and year >= 1994), count(*) filter (citations >= 50 and not year >= 1994) from papers union all select 2, 'final', count(*) filter (citations >= 50 and year >= 1994 and status = 'F'), count(*) filter (citations >= 50 and year >= 1994 and not status = 'F') from papers")
def paper_funnel(spark, d):
    return domains.funnel(papers(spark, d), {"cited": F.col("citations") >= 50, "recent": F.col("year") >= 1994, "final": F.col("status") == "F"})


@query("theory_or_experiment", "select doc_id, case when s >= 5 then 'empirical' when s >= 2 then 'unclear' else 'theoretical' end as kind from (select doc_id, 3 * contains(lower(text), 'license')::int + contains(lower(text), 'the')::int + contains(lower(text), 'and')::int + 5 * contains(text, '@')::int as s from documents)")
def theory_or_experiment(spark, d):
    kind = domains.empirical(F.col("text"), ["license"], ["the", "and"], F.col("text").contains("@"))
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"))


# ---------------------------------------------------------------- venues


@query("venue_normalization", "with {papers} select case venue when 'NATION_1' then 'PRC' when 'NATION_2' then 'BHARAT' else venue end as normalized, count(*) as n from papers group by 1")
def venue_normalization(spark, d):
    p = papers(spark, d)
    mapping = spark.createDataFrame([("nation_1", "PRC"), ("nation_2", "BHARAT")], "raw string, canonical string")
    known = table(spark, d, "nation").select(F.col("n_name").alias("canonical"))
    return venues.normalize(p, "venue", mapping, known, fuzzy.similarity("title")).groupBy("normalized").agg(F.count("*").alias("n"))


@query("mapping_checks", "select 'a' as raw, 'maps to itself' as error union all select 'b', 'unknown target' union all select 'a', 'unknown target'")
def mapping_checks(spark, d):
    mapping = spark.createDataFrame([("a", "a"), ("b", "nowhere"), ("nation 1", "NATION_1")], "raw string, canonical string")
    return venues.mapping_errors(mapping, table(spark, d, "nation").select(F.col("n_name").alias("canonical")))


@query("institution_coverage", "select * from (values ('furn', (select count(*) from customer where contains(lower(c_mktsegment), 'furn'))), ('nothing', 0)) t(org, n)")
def institution_coverage(spark, d):
    expected = spark.createDataFrame([("furn",), ("nothing",)], "org string")
    return venues.coverage(table(spark, d, "customer"), F.array("c_mktsegment"), expected, "org")


@query("domain_venues", "with {papers}, n as (select domain, venue, count(*) as n, row_number() over (partition by domain order by count(*) desc, venue) as r from papers group by 1, 2) select domain, sum(n)::bigint as papers, count(*) as venues, string_agg(venue, ', ' order by r) filter (r <= 3) as top from n group by 1")
def domain_venues(spark, d):
    return venues.domain_venues(papers(spark, d), "domain", "venue")


@query("venue_domains", "with {papers} select venue, string_agg(distinct domain, ', ' order by domain) as domains, count(*) as n from papers group by 1")
def venue_domains(spark, d):
    return venues.venue_domains(papers(spark, d), "venue", "domain")


@query("venue_spellings", "with {papers}, n as (select source as v, sum(citations) as n from papers group by 1) select length(v) as key, count(*) as spellings, arg_max(v, {'n': n, 'v': v}) as canonical, sum(n)::bigint as n from n group by 1 having count(*) > 1")
def venue_spellings(spark, d):
    return venues.renamed_groups(papers(spark, d), "source", F.length("source"), "citations")


@query("venue_scores", """with {papers}, v as (select venue, any_value(tier) as tier, avg(citations) as c, count(*) as n, count(distinct domain) as k from papers group by 1)
 select venue, round_even(.3 * least(1.0, c / 100) + .25 * case when n >= 100 then 1.0 when n >= 50 then .8 when n >= 20 then .6 when n >= 10 then .4 else .2 end + .2 * case tier when 'tier1' then 1.0 when 'tier2' then .8 when 'tier3' then .6 else .4 end + .15 * .5 + .1 * least(1.0, k / 5), 3) as score from v""")
def venue_scores(spark, d):
    v = papers(spark, d).groupBy("venue").agg(F.max("tier").alias("tier"), F.avg("citations").alias("c"), F.count("*").alias("n"), F.countDistinct("domain").alias("k"))
    return v.select("venue", venues.venue_score(F.col("c"), F.col("n"), F.col("tier"), F.lit(0.5), F.col("k")).alias("score"))


# ---------------------------------------------------------------- duplicates


@query("first_by_any_key")
def first_by_any_key(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).cast("binary")).alias("words"))
    return dedup.first_by_any(x, ["hash", "words"], "doc_id").select("doc_id")


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"), "p_retailprice", F.array(F.concat_ws(" ", "p_brand", "p_size")).alias("authors"), (F.col("p_partkey") % 3).alias("year"), "p_type")


@query("fuzzy_duplicates")
def fuzzy_duplicates(spark, d):
    return rounded(dedup.fuzzy_pairs(_parts(spark, d), "p_partkey", "title", "authors"))


@query("fuzzy_best_versions")
def fuzzy_best_versions(spark, d):
    p = _parts(spark, d)
    return dedup.statistics(p, dedup.fuzzy_best(p, "p_partkey", "title", "authors", [F.desc("p_retailprice")]))


@query("blended_duplicates")
def blended_duplicates(spark, d):
    p = _parts(spark, d)
    led = dedup.blended_groups(p, "p_partkey", "title", "authors", "year", "p_type")
    return led.groupBy("leader").agg(F.count("*").alias("n"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("kept"))


# ---------------------------------------------------------------- reports


@query("stage_report", """with {papers}, s as (select 'sources' as c, least(1.0, count(distinct source) / 3) as score, .6 as l from papers union all select 'years', least(1.0, (max(year) - min(year) + 1) / 5), .6 from papers union all select 'valid_years', 1 - count(*) filter (not year between 1950 and 2001) / count(*), .8 from papers),
 u as (select * from s union all select 'overall', avg(score), avg(l) from s) select c as "check", round(score, 6) as score, case when score >= .97 then 'A+' when score >= .93 then 'A' else 'B' end as grade, score >= l as passed from u""")
def stage_report(spark, d):
    p = papers(spark, d)
    checks = {"sources": quality.source_coverage(p, "source"), "years": quality.year_coverage(p, "year", AS_OF), "valid_years": quality.year_validity(p, F.col("year"), AS_OF)}
    return rounded(reports.stage_report(checks, {"sources": 0.6, "years": 0.6, "valid_years": 0.8}))


RICH = "(citations % 100) / 100"


@query("paper_filter", f"""with {{papers}}, x as (select paper_id, {RICH} as r, substr(source, 1, 1)::int as k, case domain when 'BUILDING' then 'academic' when 'MACHINERY' then 'collaborative' else 'industry' end as c from papers),
 s as (select *, .4 * least(1.0, r / .6) + .3 * (c in ('academic', 'collaborative'))::int + .3 * (1 - least(k, 5) / 5) as score from x) select paper_id, round(score, 6) as score, score >= .6 and r >= .1 and k <= 5 as passed from s""")
def paper_filter(spark, d):
    c = F.when(F.col("domain") == "BUILDING", "academic").when(F.col("domain") == "MACHINERY", "collaborative").otherwise("industry")
    x = reports.paper_filter(papers(spark, d), F.expr(RICH), F.lit(0.9), c, F.substring("source", 1, 1).cast("int"), False)
    return rounded(x.select("paper_id", "score", "passed"))


@query("richness_buckets", f"""with {{papers}}, b as (select case when {RICH} >= .7 and status = 'F' then 'high' when {RICH} >= .4 then 'medium' when {RICH} >= .2 then 'low' else 'minimal' end as bucket from papers), n as (select bucket, count(*) as n from b group by 1)
 select bucket, n, round(n * 100.0 / sum(n) over (), 6) as percent, round((select sum(n * case bucket when 'high' then 1 when 'medium' then .7 when 'low' then .3 else 0 end) / sum(n) from n), 6) as dataset_score from n""")
def richness_buckets(spark, d):
    b = reports.richness_bucket(F.expr(RICH), F.col("status") == "F", F.lit(0.8))
    return rounded(reports.bucket_report(papers(spark, d).withColumn("bucket", b), "bucket"))


@query("venue_recommendations", """with {papers}, v as (select venue || ' ' || year || ' ' || status as venue, count(*) as n, count(*) filter (citations >= 470) as b, stddev_pop(citations) as s, avg(citations) as m from papers group by 1)
 select venue, 'few papers' as note from v where n < 20 union all select venue, 'few breakthroughs' from v where b < 2 union all select venue, 'wide spread' from v where s > 2 * m""")
def venue_recommendations(spark, d):
    v = papers(spark, d).groupBy(F.concat_ws(" ", "venue", "year", "status").alias("venue")).agg(F.count("*").alias("n"), F.count_if(F.col("citations") >= 470).alias("breakthroughs"), F.stddev_pop("citations").alias("std"), F.avg("citations").alias("mean"))
    return reports.recommendations(v, "venue")


@query("filtering_quality", "with {papers} select count(*) as n, count(*) filter (year >= 1994) as kept, count(distinct venue) as venues, count(distinct venue) filter (year >= 1994) as venues_kept, count(*) filter (citations >= 300) as high, count(*) filter (citations >= 300 and year >= 1994) as high_kept, case when count(*) filter (citations >= 300 and year >= 1994) < .95 * count(*) filter (citations >= 300) then 'high-impact rows lost' when count(distinct venue) filter (year >= 1994) < count(distinct venue) then 'venues lost' else 'none' end as warning from papers")
def filtering_quality(spark, d):
    p = papers(spark, d)
    return reports.filtering_quality(p, p.filter("year >= 1994"), "paper_id", "venue", F.col("citations") >= 300)


@query("source_metrics", "select event_type, count(*) as n, round(avg((value >= 20)::int), 6) as hit_rate, round(avg(value), 6) as latency, round(avg((props is not null)::int), 6) as has_props from events group by 1")
def source_metrics(spark, d):
    return rounded(reports.source_metrics(table(spark, d, "events"), "event_type", F.col("value") >= 20, F.col("value"), ["props"]))
