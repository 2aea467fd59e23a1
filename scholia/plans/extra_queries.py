"""More look-ups, checks and unions over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scholia.functions import extract, scores
from scholia.functions import text as tx
from scholia.operators import aggregates as agg
from scholia.operators import filters, joins, quality, venues, windows
from scholia.plans.base import AS_OF, papers, query, rounded, table


@query("name_accuracy", r"select count(*) as n, count(*) filter (length(p_name) >= 2 and regexp_matches(p_name, '^[\w\s\-\.'',]+$')) as valid, round(count(*) filter (length(p_name) >= 2 and regexp_matches(p_name, '^[\w\s\-\.'',]+$')) / count(*), 6) as score from part")
def name_accuracy(spark, d):
    return rounded(quality.name_accuracy(table(spark, d, "part").select(F.array("p_name").alias("names")), "names"))


DOI = "case page_id % 3 when 0 then 'https://doi.org/10.1234/ab' when 1 then '10.99/x' else '10.5555/a b' end"


@query("doi_accuracy", f"with x as (select regexp_replace({DOI}, '^(https?://)?(dx\\.)?doi\\.org/', '') as d from pages) select count(d) as n, count(*) filter (regexp_matches(d, '^10\\.\\d{{4,}}/[-._;()/:a-zA-Z0-9]+$')) as valid, round(count(*) filter (regexp_matches(d, '^10\\.\\d{{4,}}/[-._;()/:a-zA-Z0-9]+$')) / count(d), 6) as score from x".replace("{{", "{").replace("}}", "}"))
def doi_accuracy(spark, d):
    return rounded(quality.doi_accuracy(table(spark, d, "pages"), F.expr(DOI)))


@query("gpu_configuration", "with x as (select p_partkey, case p_size % 3 when 0 then 'V100' when 1 then 'T4' else 'K80' end as k, p_size * 30 as n from part) select p_partkey, case when n > case k when 'V100' then 1024 when 'T4' then 256 else 512 end then 'error' when n > case k when 'V100' then 64 when 'T4' then 16 else 32 end then 'warning' else 'ok' end as verdict from x")
def gpu_configuration(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "V100").when(F.col("p_size") % 3 == 1, "T4").otherwise("K80")
    return table(spark, d, "part").select("p_partkey", scores.gpu_count_verdict(kind, F.col("p_size") * 30).alias("verdict"))


#: What has been learned of each supplier's name: a canonical nation, or one that is none, or itself.
_LEARNED = "l as (select s_name as raw, case s_suppkey % 5 when 0 then 'nowhere' when 1 then s_name else 'NATION_' || s_nationkey end as canonical, (s_suppkey % 10) / 10 as confidence from supplier)"


@query("mapping_update", f"""with {_LEARNED}, old as (select s_name as raw, 'NATION_1' as canonical from supplier where s_suppkey % 9 = 0)
 select * from old union all select raw, canonical from l where confidence >= .8 and raw <> canonical and canonical in (select n_name from nation) and raw not in (select raw from old)""")
def mapping_update(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    old = s.filter(k % 9 == 0).select(F.col("s_name").alias("raw"), F.lit("NATION_1").alias("canonical"))
    canonical = F.when(k % 5 == 0, "nowhere").when(k % 5 == 1, F.col("s_name")).otherwise(F.concat(F.lit("NATION_"), "s_nationkey"))
    learned = s.select(F.col("s_name").alias("raw"), canonical.alias("canonical"), ((k % 10) / 10).alias("confidence"))
    return venues.mapping_update(old, learned, table(spark, d, "nation").select(F.col("n_name").alias("canonical")))


@query("mapping_statistics", "with {papers}, c as (select case when venue = 'NATION_1' then 1.0 when venue = 'NATION_2' then .96 when venue = 'NATION_3' then .92 end as c from papers) select count(*) as n, count(*) filter (c = 1) as exact, count(*) filter (c >= .95 and c < 1) as high, count(*) filter (c >= .9 and c < .95) as medium, count(*) filter (c is null) as unmapped from c")
def mapping_statistics(spark, d):
    c = F.when(F.col("venue") == "NATION_1", 1.0).when(F.col("venue") == "NATION_2", 0.96).when(F.col("venue") == "NATION_3", 0.92)
    return venues.mapping_statistics(papers(spark, d).select(c.alias("confidence")))


@query("venue_search", "select n_name from nation join region on n_regionkey = r_regionkey where contains(lower(n_name), 'n_1') or contains(lower(r_name), '2')")
def venue_search(spark, d):
    dim = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return dim.filter(F.exists(F.array("n_name", "r_name"), lambda x: F.lower(x).contains("n_1")) | F.lower("r_name").contains("2")).select("n_name")


@query("best_domain_per_venue", "with {papers}, s as (select venue, domain, avg(citations) as m from papers group by 1, 2) select venue, arg_max(domain, {'m': m, 'd': domain}) as domain, round(max(m), 6) as score from s group by 1")
def best_domain_per_venue(spark, d):
    s = papers(spark, d).groupBy("venue", "domain").agg(F.avg("citations").alias("m"))
    return rounded(s.groupBy("venue").agg(F.max_by("domain", F.struct("m", "domain")).alias("domain"), F.max("m").alias("score")))


@query("union_of_sources", "select 'orders' as source, count(*) as n from orders union all select 'customers', count(*) from customer union all select 'parts', count(*) from part")
def union_of_sources(spark, d):
    parts = {"orders": "o_orderkey", "customers": "c_custkey", "parts": "p_partkey"}
    tables = {"orders": "orders", "customers": "customer", "parts": "part"}
    rows = [table(spark, d, tables[s]).select(F.lit(s).alias("source"), F.col(k).alias("id")) for s, k in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).groupBy("source").agg(F.count("*").alias("n"))


@query("projection_top_papers", "with {papers}, b as (select paper_id, case when citations >= 300 then 0 when citations >= 200 then 1 else 2 end as b, citations from papers) select paper_id, b as bucket, citations from b where b < 2 order by b, citations desc, paper_id limit 50")
def projection_top_papers(spark, d):
    bucket = F.when(F.col("citations") >= 300, 0).when(F.col("citations") >= 200, 1).otherwise(2)
    return papers(spark, d).select("paper_id", bucket.alias("bucket"), "citations").filter("bucket < 2").orderBy("bucket", F.desc("citations"), "paper_id").limit(50)


@query("truncated_venue_years", "with {papers}, r as (select venue, year, paper_id, row_number() over (partition by venue, year order by paper_id) as rank from papers) select * from r where rank <= 2")
def truncated_venue_years(spark, d):
    return windows.top_n(papers(spark, d).select("venue", "year", "paper_id"), ["venue", "year"], ["paper_id"], 2)


@query("priority_routes", "with {papers}, v as (select distinct venue from papers) select venue, s as source, 10 - p as score, row_number() over (partition by venue order by p, s) as turn from v join (values ('NATION_1', 'x', 2), ('NATION_1', 'y', 0), ('NATION_2', 'x', 1)) t(venue, s, p) using (venue)")
def priority_routes(spark, d):
    routes = spark.createDataFrame([("NATION_1", "x", 2), ("NATION_1", "y", 0), ("NATION_2", "x", 1)], "venue string, source string, position int")
    return joins.priority_routing(papers(spark, d).select("venue").distinct(), routes, "venue", "source", "position").select("venue", "source", "score", "turn")


@query("venue_year_matches", "with {papers} select a.paper_id as a, b.paper_id as b from papers a join papers b on a.author_id = b.author_id and a.year = b.year and a.domain = b.domain and a.paper_id < b.paper_id")
def venue_year_matches(spark, d):
    pairs = joins.blocked_pairs(papers(spark, d).select("paper_id", "author_id", "year", "domain"), "paper_id", F.concat_ws("|", "author_id", "year", "domain"))
    return pairs.select(F.col("paper_id_a").alias("a"), F.col("paper_id_b").alias("b"))


@query("venues_compared", "with {papers} select domain, count(*) as n, round(avg(citations), 6) as mean, round(stddev_pop(citations), 6) as std, count(distinct author_id) as authors from papers where domain in ('BUILDING', 'MACHINERY') group by 1")
def venues_compared(spark, d):
    p = papers(spark, d).filter(F.col("domain").isin("BUILDING", "MACHINERY"))
    return rounded(p.groupBy("domain").agg(F.count("*").alias("n"), F.avg("citations").alias("mean"), F.stddev_pop("citations").alias("std"), F.countDistinct("author_id").alias("authors")))


@query("cited_by_threshold", "with {papers}, t as (select paper_id, citations, citations / case when year >= 1997 then 100 when year >= 1994 then 200 else 300 end as score from papers) select paper_id, round(score, 6) as score from t where score >= 1")
def cited_by_threshold(spark, d):
    least = F.when(F.col("year") >= 1997, 100).when(F.col("year") >= 1994, 200).otherwise(300)
    return rounded(papers(spark, d).select("paper_id", (F.col("citations") / least).alias("score")).filter("score >= 1"))


@query("quality_thresholds", "with {papers} select count(*) filter (citations >= 100 and balance >= 0) as passed, count(*) filter (not (citations >= 100)) as low_citations, count(*) filter (not (balance >= 0)) as low_balance from papers")
def quality_thresholds(spark, d):
    x = filters.with_reasons(papers(spark, d), {"citations": F.col("citations") >= 100, "balance": F.col("balance") >= 0})
    return x.agg(F.count_if("passed").alias("passed"), F.count_if(F.array_contains("reasons", "citations")).alias("low_citations"), F.count_if(F.array_contains("reasons", "balance")).alias("low_balance"))


@query("inverted_abstracts", "select doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[^ ]+'), ' ') as text from documents")
def inverted_abstracts(spark, d):
    """Each whole text to its inverted index (word, places), and back."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    x = table(spark, d, "documents").select("doc_id", tx.inverted_index(words).alias("index"))
    return x.select("doc_id", F.coalesce(tx.inverted_text(F.col("index")), F.lit("")).alias("text"))


@query("cost_estimates", "select l_orderkey, l_linenumber, round(round_even(l_extendedprice, 0) / 3.06, 6) as gpu_hours from lineitem")
def cost_estimates(spark, d):
    told = F.concat(F.lit("It cost $"), F.rint("l_extendedprice").cast("int"))
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", extract.hours_for_cost(F.get(extract.costs(told), F.lit(0))).alias("gpu_hours")))


@query("expected_velocity", "with {papers}, y as (select year, avg(citations) as m from papers group by 1) select year, round(m / greatest(1, {AS_OF} - year), 6) as velocity, case when {AS_OF} - year <= 2 then 10 when {AS_OF} - year <= 5 then 8 else 5 end as expected from y")
def expected_velocity(spark, d):
    age = F.greatest(F.lit(1), F.lit(AS_OF) - F.col("year"))
    y = papers(spark, d).groupBy("year").agg(F.avg("citations").alias("m"))
    return rounded(y.select("year", (F.col("m") / age).alias("velocity"), F.when(F.lit(AS_OF) - F.col("year") <= 2, 10).when(F.lit(AS_OF) - F.col("year") <= 5, 8).otherwise(5).alias("expected")))


@query("yearly_histograms", "with {papers} select venue, count(*) filter (citations <= 50) as low, count(*) filter (citations > 50 and citations <= 200) as middle, count(*) filter (citations > 200) as high from papers group by 1")
def yearly_histograms(spark, d):
    b = F.when(F.col("citations") <= 50, "low").when(F.col("citations") <= 200, "middle").otherwise("high")
    return agg.pivot_by_year(papers(spark, d).withColumn("b", b), "venue", "b", ["low", "middle", "high"])
