"""Queries over extension points, failures, enrichment and norms."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import scores
from scholia.operators import extend, reports, stats
from scholia.plans.base import papers, query, rounded, table

_YEAR = "case domain when 'BUILDING' then null when 'MACHINERY' then 0 else year + 15 + length(domain) end"


@query("outlier_patterns", f"""with {{papers}}, x as (select domain as field, nullif({_YEAR}, 0) as y from papers where citations >= 300)
 select field, count(*) as n, min(y)::int as min_year, max(y)::int as max_year, case when avg(y) > 2020 then 'recent' when count(y) > 0 then 'historical' end as concentration, (select count(*) from papers) as papers, round(count(*) / (select count(*) from papers), 6) as rate from x group by 1""")
def outlier_patterns(spark, d):
    p = papers(spark, d)
    odd = p.filter("citations >= 300").select(F.col("domain").alias("field"), F.expr(_YEAR).alias("year"))
    return rounded(stats.outlier_pattern(odd, p))


@query("norm_checks", """with {papers} select paper_id, case when price / 200 - 300 > 0 then abs(price / 200 - 300 - 500) / 300 < 3 end as gpu_hours, case when balance > 0 then abs(balance / 10 - 100) / 200 < 3 end as parameters, abs(paper_id % 90 + 1 - 32) / 16 < 3 as batch_size from papers""")
def norm_checks(spark, d):
    return papers(spark, d).select("paper_id", stats.within_norms("gpu_hours", F.col("price") / 200 - 300).alias("gpu_hours"), stats.within_norms("parameters", F.col("balance") / 10).alias("parameters"), stats.within_norms("batch_size", F.col("paper_id") % 90 + 1).alias("batch_size"))


@query("enrichment_statistics", """with x as (select o_orderkey % 7 = 0 as w, o_orderkey % 5 = 0 as s2, case when o_orderkey % 11 = 0 then null when o_orderkey % 3 = 0 then ['openalex', 'dblp'] when o_orderkey % 3 = 1 then ['semanticscholar'] else [] end as c, case when o_orderkey % 4 = 0 then ['openalex', 'semanticscholar'] else ['dblp'] end as a from orders)
 select 'openalex' as source, count(*) filter (w or coalesce(list_contains(c, 'openalex'), false) or list_contains(a, 'openalex')) as papers_enriched, count(*) filter (list_contains(c, 'openalex')) as citations_found, count(*) filter (list_contains(a, 'openalex')) as abstracts_found from x
 union all select 'semanticscholar', count(*) filter (s2 or coalesce(list_contains(c, 'semanticscholar'), false) or list_contains(a, 'semanticscholar')), count(*) filter (list_contains(c, 'semanticscholar')), count(*) filter (list_contains(a, 'semanticscholar')) from x""")
def enrichment_statistics(spark, d):
    k = F.col("o_orderkey")
    of = lambda *names: F.array(*[F.struct(F.lit(n).alias("source")) for n in names]).cast("array<struct<source:string>>")
    x = table(spark, d, "orders").select(
        F.when(k % 7 == 0, F.concat(F.lit("W"), k)).otherwise(F.when(k % 2 == 0, "")).alias("openalex_id"), F.when(k % 5 == 0, F.array(F.struct(F.struct(F.lit("s2_paper").alias("identifier_type")).alias("data")))).alias("identifiers"),
        F.when(k % 11 == 0, None).when(k % 3 == 0, of("openalex", "dblp")).when(k % 3 == 1, of("semanticscholar")).otherwise(of()).alias("citations"), F.when(k % 4 == 0, of("openalex", "semanticscholar")).otherwise(of("dblp")).alias("abstracts"))
    return reports.enrichment_statistics(x)


_MESSAGES = ["HTTP 404", "read timeout", "status 503", "Connection reset", "odd"]


@query("failed_papers", "with e as (select event_id, " + "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + f"][1 + event_id % {len(_MESSAGES)}] as m from events where event_type = 'error'), k as (select event_id, " +
       "case " + " ".join(f"when contains(lower(m), '{part}') then '{kind}'" for part, kind, _ in scores.ERRORS) + " else 'unknown' end as kind, case " + " ".join(f"when contains(lower(m), '{part}') then {str(perm).lower()}" for part, _, perm in scores.ERRORS) + " else false end as permanent from e) select *, count(*) over (partition by permanent, kind) as of_kind from k")
def failed_papers(spark, d):
    m = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES)).cast("int"))
    x = table(spark, d, "events").filter("event_type = 'error'").select("event_id", scores.error_kind(m).alias("e")).select("event_id", "e.*")
    return reports.failures(x, "event_id", "kind", "permanent")


_RULES = [("size", "p_size", 5.0, 45.0, None, False, "warning"), ("price", "p_retailprice", None, 950.0, None, True, "error"), ("brand", "p_brand", None, None, "#1[0-9]?$", False, "warning"), ("kind", "p_type", None, None, "^[A-L]", True, "error"),
          ("text", "p_type", 0.0, None, None, False, "info"), ("note", "note", None, None, "x", True, "error"), ("other", "absent", 0.0, 1.0, None, True, "error")]


@query("broken_rules", """select p_partkey, 'size' as rule, 'p_size' as field, 'warning' as severity from part where p_size < 5 or p_size > 45 union all select p_partkey, 'price', 'p_retailprice', 'error' from part where p_retailprice > 950
 union all select p_partkey, 'brand', 'p_brand', 'warning' from part where not regexp_matches(p_brand, '#1[0-9]?$') union all select p_partkey, 'kind', 'p_type', 'error' from part where not regexp_matches(p_type, '^[A-L]')
 union all select p_partkey, 'text', 'p_type', 'info' from part union all select p_partkey, 'note', 'note', 'error' from part where p_partkey % 3 > 0""")
def broken_rules(spark, d):
    rules = spark.createDataFrame(_RULES, extend.RULES)
    x = table(spark, d, "part").withColumn("note", F.when(F.col("p_partkey") % 3 == 0, "an x").when(F.col("p_partkey") % 3 == 1, "none"))
    return extend.broken_rules(x, "p_partkey", rules, ["p_size", "p_retailprice", "p_brand", "p_type", "note"])


@query("analyzed_texts", r"""with x as (select doc_id, nullif(regexp_extract(coalesce(text, ''), '(\d+)', 1), '') as number, case when contains(lower(text), 'license') then 'license' end as word from documents)
 select doc_id, case when word is not null and (number is null or .5 >= length(number) / 10) then word else number end as value, case when word is not null and (number is null or .5 >= length(number) / 10) then .5 when number is not null then length(number) / 10 end::double as confidence,
 case when word is not null and (number is null or .5 >= length(number) / 10) then 'a_word' when number is not null then 'number' end as "by" from x""")
def analyzed_texts(spark, d):
    known = extend.Analyzers()
    known.register("number", (lambda t: F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), r"(\d+)", 1), F.lit("")), lambda t, v: F.length(v) / 10))
    known.register("a_word", (lambda t: F.when(F.lower(t).contains("license"), "license"), lambda t, v: F.lit(0.5)))
    return table(spark, d, "documents").select("doc_id", known.apply(F.col("text")).alias("x")).select("doc_id", "x.*")


@query("discovered_urls", """with c as (select o_orderkey, 'http://a/' || o_custkey as url, 'archive' as "by", .9::double as confidence from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'http://a/' || o_custkey, 'venue', .9 from orders where o_orderkey % 3 = 0
 union all select o_orderkey, 'http://s/' || o_orderkey, 'search', .4 from orders union all select o_orderkey, 'http://a/' || o_custkey, 'search', .4 from orders where o_orderkey % 5 = 0)
 select o_orderkey, url, "by", confidence from (select *, row_number() over (partition by o_orderkey, url order by confidence desc, "by") as r from c) where r = 1""")
def discovered_urls(spark, d):
    a, k = F.concat(F.lit("http://a/"), "o_custkey"), F.col("o_orderkey")
    known = extend.Collectors()
    known.register("venue", (F.when(k % 3 == 0, F.array(a, F.lit(""))), 0.9))
    known.register("archive", (F.when(k % 2 == 0, F.array(a)).otherwise(F.array().cast("array<string>")), 0.9))
    known.register("search", (F.when(k % 5 == 0, F.array(F.concat(F.lit("http://s/"), k), a)).otherwise(F.array(F.concat(F.lit("http://s/"), k))), 0.4))
    return known.discover(table(spark, d, "orders"), "o_orderkey")
