"""Queries over outlier context, samples, validation, forms and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import affiliations
from scholia.operators import quality, stages, stats
from scholia.plans.base import papers, query, rounded, table

_TITLES = ["A novel giant network", "Small steps", "Introducing things", "A massive model", "Plain words", "Tiny but new"]
_PICK = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "]"
_CONTEXT = f"""x as (select paper_id, lower({_PICK}[1 + paper_id % 6]) as t, year + 20 as y, citations * 4 as c, price * price * 25 as v, citations * 7 as h, case when paper_id % 5 > 0 then price / 1000 end as gb from papers),
 f as (select *, case when abs(v - 175e9) / 175e9 < .3 then 'gpt3' when abs(v - 540e9) / 540e9 < .3 then 'palm' when abs(v - 1.76e12) / 1.76e12 < .3 then 'gpt4' end as k,
  regexp_matches(t, 'novel|new|introducing|proposing') as nov, regexp_matches(t, 'large|giant|massive|billion') as lar, regexp_matches(t, 'efficient|lightweight|tiny|small') and v > 2e8 as sma, y < 2018 and v > 1e10 as ear, c > 1000 as cit from x),
 s as (select *, case when sma or ear then 'suspicious' when k is not null or lar then 'expected' when nov or cit then 'possible' else 'unknown' end as severity from f)"""


@query("outlier_context", "with {papers}, " + _CONTEXT + """ select paper_id, severity, (k is not null)::int + (k is null and nov)::int + (k is null and lar)::int + sma::int + ear::int + cit::int + (not (k is not null or nov or lar or sma or ear or cit))::int as reasons,
 not (v > 1e10 and h < 1000) and (severity = 'expected' or severity <> 'suspicious' and not (coalesce(gb, 0) > 0 and abs(v - gb * .25e9) / (gb * .25e9) > 1)) as keep from s""")
def outlier_context(spark, d):
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("paper_id") % 6).cast("int"))
    v, gb = F.col("price") * F.col("price") * 25, F.when(F.col("paper_id") % 5 > 0, F.col("price") / 1000)
    x = papers(spark, d).select("paper_id", v.alias("v"), gb.alias("gb"), (F.col("citations") * 7).alias("h"), stats.outlier_context("parameters", v, title, F.col("year") + 20, F.col("citations") * 4).alias("x"))
    keep = stats.keep_outlier("parameters", F.col("v"), F.col("x")["severity"], {"gpu_hours": F.col("h"), "model_size_gb": F.col("gb")})
    return x.select("paper_id", F.col("x")["severity"].alias("severity"), F.size(F.col("x")["reasons"]).alias("reasons"), keep.alias("keep"))


@query("sample_equal", "with {papers}, n as (select year, count(*) as n, row_number() over (order by year) as r, count(*) over () as k from papers group by 1) select year, least(n, 100 // k + (r <= 100 % k)::int)::bigint as n from n")
def sample_equal(spark, d):
    return stats.sample_by_strata(papers(spark, d), "year", "paper_id", 100).groupBy("year").agg(F.count("*").alias("n"))


@query("sample_proportional", "with {papers}, n as (select venue, count(*) as n, sum(count(*)) over () as t from papers group by 1), q as (select venue, n * 200 // t as q from n) select count(*) as strata, 200::bigint as n, true as each_has_its_share from q")
def sample_proportional(spark, d):
    p = papers(spark, d)
    got = stats.sample_by_strata(p, "venue", "paper_id", 200, "proportional").groupBy("venue").agg(F.count("*").alias("got"))
    all_ = p.groupBy("venue").agg(F.count("*").alias("n")).join(got, "venue", "left")
    total = p.agg(F.count("*").alias("t"))
    x = all_.crossJoin(F.broadcast(total))  # one row
    return x.agg(F.count("*").alias("strata"), F.sum("got").alias("n"), F.every(F.coalesce("got", F.lit(0)) >= F.floor(F.col("n") * 200 / F.col("t"))).alias("each_has_its_share"))


_AUTHORS = "a as (select author_id, count(*) filter (source = '1-URGENT') as i, count(*) filter (source = '5-LOW') as u, count(*) filter (source not in ('1-URGENT', '5-LOW')) as a, min(citations) / 300 as c from papers group by 1)"


def _authors(spark, d):
    s = F.col("source")
    return papers(spark, d).groupBy("author_id").agg(F.count_if(s == "1-URGENT").alias("i"), F.count_if(s == "5-LOW").alias("u"), F.count_if(~s.isin("1-URGENT", "5-LOW")).alias("a"), (F.min("citations") / 300).alias("c"))


@query("classification_edge_cases", "with {papers}, " + _AUTHORS + """ select author_id, 'low_confidence' as reason, round(c::double, 6) as value from a where c < .5 union all select author_id, 'high_unknown_percentage', round(u / (a + i + u), 6) from a where u / (a + i + u) > .5
 union all select author_id, 'borderline_threshold', round(i / (a + i), 6) from a where a + i > 0 and i / (a + i) between .2 and .3""")
def classification_edge_cases(spark, d):
    return rounded(quality.edge_cases(_authors(spark, d), "author_id", F.col("a"), F.col("i"), F.col("u"), F.col("c")))


@query("classification_validation", "with {papers}, " + _AUTHORS + """ select count(*) as papers, round(avg(c), 6) as average_confidence, round(min(c)::double, 6) as min_confidence, round(max(c)::double, 6) as max_confidence, count(*) filter (c < .5) as low_confidence, count(*) filter (c > .8) as high_confidence,
 round(avg((u > a + i)::int), 6) as review_share, .8 as academic_accuracy, 1.0 as industry_accuracy, round(least(1.0, .4 * .9 + .3 * avg(c) + .3 * (1 - avg((u > a + i)::int))), 6) as score from a""")
def classification_validation(spark, d):
    x = _authors(spark, d).withColumn("category", F.when(F.col("u") > F.col("a") + F.col("i"), "needs_review").otherwise("other"))
    return rounded(quality.classification_validation(x, "category", F.col("c"), lambda a: affiliations.affiliation_class(a, industry=["Google", "OpenAI", "Microsoft", "Meta", "DeepMind"])["type"]))


FORM = {"o_orderstatus": {"required": True, "options": ["F", "O"]}, "o_totalprice": {"kind": "double", "least": 2000, "most": 400000}, "o_orderpriority": {"pattern": r"^[1-4]-", "needs": "note"}}


@query("form_errors", """with x as (select o_orderkey, case when o_orderkey % 9 > 0 then o_orderstatus else ' ' end as s, o_totalprice as p, o_orderpriority as q, o_orderkey % 4 > 0 as note from orders)
 select o_orderkey, concat_ws('; ', case when trim(s) = '' then 'o_orderstatus: missing' end, case when trim(s) not in ('', 'F', 'O') then 'o_orderstatus: not an option' end, case when p < 2000 then 'o_totalprice: below 2000' end, case when p > 400000 then 'o_totalprice: above 400000' end,
 case when not regexp_matches(q, '^[1-4]-') then 'o_orderpriority: of another form' end, case when not note then 'o_orderpriority: needs note' end) as errors, case when trim(s) = '' then 'status' when not note then 'note' else 'complete' end as phase from x""")
def form_errors(spark, d):
    x = table(spark, d, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderstatus")).otherwise(" ")).withColumn("note", F.when(F.col("o_orderkey") % 4 > 0, "yes"))
    return x.select("o_orderkey", F.array_join(stages.form_errors(FORM), "; ").alias("errors"), stages.phase({"status": F.trim("o_orderstatus") != "", "note": F.col("note").isNotNull()}).alias("phase"))


@query("extractor_fallback", "select p_partkey, coalesce(nullif(regexp_extract(p_type, 'O.*', 0), ''), case when p_size > 25 then p_brand end, p_name) as value, case when contains(p_type, 'O') then 'type' when p_size > 25 then 'brand' else 'name' end as by from part")
def extractor_fallback(spark, d):
    known = stages.Extractors()
    known.register("name", lambda x: x["p_name"], 9)
    known.register("brand", lambda x: F.when(x["p_size"] > 25, x["p_brand"]), 2)
    known.register("type", lambda x: F.regexp_extract(x["p_type"], "O.*", 0), 1, lambda v: v != "")
    p = table(spark, d, "part")
    return p.select("p_partkey", known.apply(F.struct(*p.columns)).alias("x")).select("p_partkey", "x.*")


@query("stage_checks", """with {papers}, c as (select 'valid_years' as "check", avg((year between 1993 and 1997)::int) as score, 2.0 as weight, .5 as least from papers union all select 'cited', avg((citations > 100)::int), 1.0, .9 from papers),
 w as (select * from c union all select 'overall', sum(score * weight) / sum(weight), sum(weight), avg(least) from c) select "check", round(score, 6) as score, weight, round(least, 6) as least, score >= least as passed from w""")
def stage_checks(spark, d):
    known = stages.Checks()
    known.register("collection", "valid_years", lambda p: p.agg(F.avg(F.col("year").between(1993, 1997).cast("int")).alias("score")), 2.0, 0.5)
    known.register("collection", "cited", lambda p: p.agg(F.avg((F.col("citations") > 100).cast("int")).alias("score")), 1.0, 0.9)
    return rounded(known.run("collection", papers(spark, d)))
