"""Queries over the paper view: citations, windows, statistics, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import scores
from scholia.operators import aggregates as agg
from scholia.operators import filters, joins, optimizer, quality, stats, windows
from scholia.plans.base import AS_OF, papers, query, rounded, table

PCT = ", ".join(f"round(quantile_cont(citations, {p / 100}), 6) as p{p}" for p in agg.PERCENTS)
BASE = "case tier " + " ".join(f"when '{k}' then [{', '.join(map(str, v))}]" for k, v in scores.TIER_BASE.items()) + f" else [{', '.join(map(str, scores.TIER_BASE['tier4']))}] end"
BASE_AT = f"({BASE})[greatest(0, least({AS_OF} - year, 4)) + 1]"


@query("citation_report", f"""with {{papers}} select venue, year, case when grouping(venue) + grouping(year) = 2 then 'overall' when grouping(venue) = 1 then 'year' when grouping(year) = 1 then 'venue' else 'venue_year' end as level,
 count(*) as n, round(avg(citations), 6) as mean, round(stddev_pop(citations), 6) as std, {PCT} from papers group by grouping sets ((venue), (venue, year), (year), ())""")
def citation_report(spark, d):
    return rounded(agg.citation_report(papers(spark, d)))


THRESHOLD = f"""with {{papers}}, per as (select venue, year, count(*) as n, max(tier) as tier, max(citations) as most, quantile_cont(citations, .5) as p50, quantile_cont(citations, .7) as p70, quantile_cont(citations, .75) as p75,
 quantile_cont(citations, .8) as p80, quantile_cont(citations, .9) as p90 from papers group by venue, year),
 mixed as (select *, least(trunc(.6 * p75 + .4 * {BASE_AT})::bigint, trunc(p70)::bigint) as m from per),
 thr as (select *, greatest(case when m >= 1 and most < 1 then most else m end, 0) as threshold from mixed)"""


@query("adaptive_thresholds", THRESHOLD + """ select t.venue, t.year, t.n, threshold, round(least(1.0, t.n / 50), 6) as confidence, (select count(*) from papers p where p.venue = t.venue and p.year = t.year and p.citations >= threshold) as above,
 trunc(p50)::bigint as alternative_50, trunc(p80)::bigint as alternative_80, trunc(p90)::bigint as alternative_90 from thr t""")
def adaptive_thresholds(spark, d):
    return rounded(agg.adaptive_thresholds(papers(spark, d), AS_OF))


@query("citation_histogram", "with {papers} select case when citations <= 5 then '0-5' when citations <= 20 then '6-20' when citations <= 50 then '21-50' when citations <= 100 then '51-100' else '100+' end as bucket, count(*) as n from papers group by 1")
def citation_histogram(spark, d):
    return agg.histogram(papers(spark, d))


@query("collection_statistics", """with {papers}, m as (select avg(citations) as mu, stddev_pop(citations) as sd, count(*)::double as n from papers)
 select count(*) as n, round(avg(citations), 6) as mean, round(quantile_cont(citations, .5), 6) as median, round(stddev_pop(citations), 6) as std, min(citations) as least, max(citations) as most,
 round(quantile_cont(citations, .25), 6) as q25, round(quantile_cont(citations, .75), 6) as q75, round(max(m.n) / ((max(m.n) - 1) * (max(m.n) - 2)) * sum(pow((citations - m.mu) / m.sd, 3)), 6) as skew, sum(citations)::bigint as total from papers, m""")
def collection_statistics(spark, d):
    return rounded(agg.collection_statistics(papers(spark, d), "citations"))


@query("h_index", "with {papers}, r as (select author_id, citations, row_number() over (partition by author_id order by citations desc) as i from papers) select author_id, max(least(i, greatest(citations, 0)))::bigint as h_index from r group by author_id")
def h_index(spark, d):
    return agg.h_index(papers(spark, d), "author_id", "citations")


@query("growth_rate", """with {papers}, y as (select venue, year, avg(citations) as m from papers group by venue, year),
 p as (select venue, arg_min(m, year) as a, arg_max(m, year) as b, max(year) - min(year) as span from y group by venue) select venue, round(case when span > 0 and a > 0 and b > 0 then pow(b / a, 1.0 / span) - 1 else 0 end, 6) as growth from p""")
def growth_rate(spark, d):
    return rounded(agg.growth_rate(papers(spark, d), "venue", "year", "citations"))


@query("yearly_trend", """with {papers}, y as (select venue, year, avg(citations) as m from papers group by venue, year), r as (select *, row_number() over (partition by venue order by year)::double as i from y)
 select venue, round(corr(m, i), 6) as r, case when corr(m, i) > .3 then 'increasing' when corr(m, i) < -.3 then 'decreasing' else 'stable' end as trend from r group by venue""")
def yearly_trend(spark, d):
    return rounded(agg.yearly_trend(papers(spark, d), "venue", "year", "citations"))


@query("venue_diversity", "with {papers}, n as (select count(*)::double as c from papers group by venue) select round(-sum(c / (select sum(c) from n) * ln(c / (select sum(c) from n))), 6) as entropy from n")
def venue_diversity(spark, d):
    return rounded(agg.diversity(papers(spark, d), "venue"))


@query("venue_statistics", """with {papers}, y as (select lower(venue) as venue, year, count(*) as n, avg(citations) as m, sum(citations) as s from papers group by 1, 2),
 a as (select lower(venue) as venue, count(distinct author_id) as authors from papers group by 1)
 select y.venue, sum(n)::bigint as papers, sum(s)::bigint as citations, arg_max(year, {'m': m, 'y': -year}) as peak_year, arg_max(year, {'n': n, 'y': -year}) as busiest_year, min(year) as first_year, max(year) as last_year, any_value(authors) as authors from y join a using (venue) group by y.venue""")
def venue_statistics(spark, d):
    return agg.venue_statistics(papers(spark, d), "venue", "year", "citations", "author_id")


@query("quality_indicators", """with {papers} select round(avg(citations), 6) as mean, round(quantile_cont(citations, .5), 6) as median, round(var_pop(citations), 4) as variance, round(avg((citations = 0)::int), 6) as zero_rate, count(distinct venue) as venues,
 round(avg((citations >= 250)::int), 6) as breakthrough_rate, round(avg((year >= {AS_OF} - 3)::int), 6) as recent_rate from papers""")
def quality_indicators(spark, d):
    out = agg.quality_indicators(papers(spark, d), AS_OF, "venue", "year", "citations", F.col("citations") >= 250)
    return rounded(out.withColumn("variance", F.round("variance", 4)))


@query("rule_confusion", """with x as (select l.quality = 1 as t, d.n_chars >= 300 as s from labels l join documents d using (doc_id)), n as (select count(*) filter (t and s) as tp, count(*) filter (not t and s) as fp, count(*) filter (not t and not s) as tn, count(*) filter (t and not s) as fn from x),
 p as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as pr, coalesce(tp / nullif(tp + fn, 0), 0) as re from n)
 select tp, fp, tn, fn, round(pr, 6) as precision, round(re, 6) as recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) as f1, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy from p""")
def rule_confusion(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(agg.confusion(x, F.col("quality") == 1, F.col("n_chars") >= 300))


@query("cost_ledger", """select l_shipmode as extractor, l_op as operation, count(*) as n, round(sum(c), 4) as total, round(avg(c), 6) as mean, min(c) as least, max(c) as most from (select l_returnflag as l_shipmode, l_linestatus as l_op, l_extendedprice as c from lineitem) group by grouping sets ((l_shipmode), (l_op), ())""")
def cost_ledger(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("extractor"), F.col("l_linestatus").alias("operation"), F.col("l_extendedprice").alias("c"))
    out = agg.cost_ledger(x, "extractor", "operation", "c")
    return out.select("extractor", "operation", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most")


@query("richness_summary", "select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as least, max(value) as most, round(stddev_samp(value), 6) as std from events group by event_type")
def richness_summary(spark, d):
    out = agg.summary(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", F.round("std", 6).alias("std"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("temporal_pivot", "with {papers} select year, " + ", ".join(f"count(distinct author_id) filter (domain = '{s}') as \"{s}\"" for s in SEGMENTS) + " from papers group by year")
def temporal_pivot(spark, d):
    return agg.pivot_by_year(papers(spark, d), "year", "domain", SEGMENTS, "author_id")


@query("yearly_proportions", "with {papers}, n as (select year, domain, count(*) as n from papers group by 1, 2) select year, domain, n, round(n * 100.0 / sum(n) over (partition by year), 6) as percent from n")
def yearly_proportions(spark, d):
    n = papers(spark, d).groupBy("year", "domain").agg(F.count("*").alias("n"))
    return rounded(agg.proportions(n, "year", "n"))


@query("domain_cooccurrence", """with e as (select distinct user_id, event_type from events), n as (select event_type, count(*) as n from e group by 1)
 select x.event_type as a, y.event_type as b, count(*) as pairs, round(count(*) * 100.0 / least(any_value(n1.n), any_value(n2.n)), 6) as strength from e x join e y on x.user_id = y.user_id and x.event_type < y.event_type join n n1 on n1.event_type = x.event_type join n n2 on n2.event_type = y.event_type group by 1, 2""")
def domain_cooccurrence(spark, d):
    return rounded(agg.cooccurrence(table(spark, d, "events"), "user_id", "event_type"))


@query("label_combinations", "with s as (select user_id, string_agg(distinct event_type, '+' order by event_type) as labels from events group by 1) select labels, count(*) as n from s group by 1")
def label_combinations(spark, d):
    return agg.label_sets(table(spark, d, "events"), "user_id", "event_type")


@query("corrected_counts", """with {papers}, n as (select domain, count(*) as n, avg((citations >= 100)::int) as r from papers group by 1), c as (select domain, n, n / nullif(r, 0) as c from n)
 select domain, n, round(c * 1444 / sum(c) over (), 6) as corrected from c""")
def corrected_counts(spark, d):
    n = papers(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.avg((F.col("citations") >= 100).cast("double")).alias("r"))
    return rounded(agg.corrected_counts(n, "domain", "n", F.col("r"), 1444.0))


# ---------------------------------------------------------------- windows


@query("top_papers_per_venue", "with {papers}, r as (select venue, paper_id, citations, row_number() over (partition by venue order by citations desc, paper_id) as rank from papers) select * from r where rank <= 8")
def top_papers_per_venue(spark, d):
    return windows.top_n(papers(spark, d).select("venue", "paper_id", "citations"), ["venue"], [F.desc("citations"), "paper_id"], 8)


@query("select_with_fill", """with {papers}, a as (select year, domain, paper_id, citations, (row_number() over (partition by year, domain order by citations desc, paper_id) <= 3)::int as i from papers),
 b as (select *, sum(i) over (partition by year) as c, row_number() over (partition by year order by i desc, citations desc, paper_id) as selection_rank from a) select year, domain, paper_id, citations, selection_rank from b where selection_rank <= least(18, greatest(17, c))""")
def select_with_fill(spark, d):
    rows = papers(spark, d).select("year", "domain", "paper_id", "citations")
    return windows.top_with_fill(rows, "year", "domain", [F.desc("citations"), "paper_id"], 3, 17, 18)


@query("first_by_title", "with x as (select doc_id, lower(trim(text)) as t from documents), r as (select *, row_number() over (partition by t order by doc_id) as i from x) select doc_id, length(t) as n from r where i = 1")
def first_by_title(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.lower(F.trim("text")).alias("t"))
    return windows.first_of(x, ["t"], ["doc_id"]).select("doc_id", F.length("t").cast("long").alias("n"))


@query("best_versions", """with {papers}, s as (select author_id, paper_id, case status when 'F' then 20.0 when 'O' then 10.0 else 0.0 end + case when year < 1995 then 20.0 else 5.0 end + (substr(source, 1, 1)::int) / 5 * 30.0 + 0.5 * 20.0 + case when price > 100000 then 10.0 when price > 50000 then 5.0 else 0.0 end as score from papers),
 r as (select *, row_number() over (partition by author_id order by score desc, paper_id) as i from s) select author_id, paper_id, round(score, 6) as score from r where i = 1""")
def best_versions(spark, d):
    p = papers(spark, d)
    status = F.when(F.col("status") == "F", "valid").when(F.col("status") == "O", "unknown").otherwise("invalid")
    score = scores.version_score(status, F.col("year") < 1995, F.lit(True), F.substring("source", 1, 1).cast("int"), 5, F.lit(0.5), F.col("price"))
    return rounded(windows.first_of(p.select("author_id", "paper_id", score.alias("score")), ["author_id"], [F.desc("score"), "paper_id"]))


@query("percentile_rank", "with {papers} select paper_id, round((rank() over (partition by venue order by citations) - 1) / count(*) over (partition by venue) * 100, 6) as percentile from papers")
def percentile_rank(spark, d):
    return rounded(windows.percentile_rank(papers(spark, d), "venue", "citations").select("paper_id", "percentile"))


@query("burst_detection", """with g as (select user_id, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as gap from events), n as (select user_id, count(*) as n, count(*) filter (gap < 14400) as rapid from g group by 1)
 select user_id, n, rapid, round(rapid / n, 6) as severity from n where n >= 3 and rapid >= 2""")
def burst_detection(spark, d):
    return rounded(windows.bursts(table(spark, d, "events"), "user_id", "ts", "event_id", 14400))


@query("trailing_rate", "select event_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts))::bigint range between 86400 preceding and current row) as recent from events")
def trailing_rate(spark, d):
    return windows.trailing_count(table(spark, d, "events"), "user_id", "ts", 86400).select("event_id", "recent")


@query("recent_trend", """with x as (select *, value - lag(value) over w as s, lag(value, 1) over w as b, lag(value, 2) over w as a from events window w as (partition by user_id order by event_id))
 select event_id, case when value > b and b > a then 'improving' when value < b and b < a then 'declining' else 'stable' end as trend, coalesce(avg(abs(s)) over (partition by user_id order by event_id rows between 3 preceding and current row) < .01, false) as converged from x""")
def recent_trend(spark, d):
    return windows.recent_trend(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "trend", "converged")


@query("venue_rank", "with {papers}, n as (select venue, count(*) as n from papers group by 1) select venue, n, row_number() over (order by n desc, venue) as rank, round((count(*) over () - row_number() over (order by n desc, venue) + 1) / count(*) over () * 100, 2) as percentile from n")
def venue_rank(spark, d):
    n = papers(spark, d).groupBy("venue").agg(F.count("*").alias("n"))
    return windows.rank_and_percentile(n, "n", "venue")


@query("cumulative_share", "with {papers}, n as (select venue, count(*) as n from papers group by 1) select venue, n, row_number() over (order by n desc, venue) as rank, round(sum(n) over (order by n desc, venue rows unbounded preceding) / sum(n) over (), 6) as share from n")
def cumulative_share(spark, d):
    n = papers(spark, d).groupBy("venue").agg(F.count("*").alias("n"))
    return rounded(windows.cumulative_share(n, "n", "venue"))


@query("stratified_sample", "with {papers}, r as (select year, paper_id, row_number() over (partition by year order by md5(paper_id::varchar)) as rank from papers) select * from r where rank <= 20")
def stratified_sample(spark, d):
    return windows.stratified_sample(papers(spark, d).select("year", "paper_id"), "year", F.col("paper_id"), 20)


# ---------------------------------------------------------------- statistics


@query("combined_outliers", """with s as (select l_returnflag as g, count(*) as n, avg(l_extendedprice) as m, stddev_pop(l_extendedprice) as sd, quantile_cont(l_extendedprice, .25) as q1, quantile_cont(l_extendedprice, .5) as q2, quantile_cont(l_extendedprice, .75) as q3 from lineitem group by 1),
 d as (select l_returnflag as g, quantile_cont(abs(l_extendedprice - q2), .5) as mad from lineitem join s on g = l_returnflag group by 1),
 v as (select l_orderkey, l_linenumber, l_extendedprice as v, s.*, mad, abs(l_extendedprice - m) / sd > 1.55 as is_z, (l_extendedprice < q1 - .3 * (q3 - q1) or l_extendedprice > q3 + .3 * (q3 - q1)) as is_iqr, abs(.6745 * (l_extendedprice - q2) / mad) > 1.2 as is_mad from lineitem join s on g = l_returnflag join d using (g))
 select l_orderkey, l_linenumber, is_z, is_iqr, is_mad from v where is_z::int + is_iqr::int + is_mad::int >= 2""")
def combined_outliers(spark, d):
    x = stats.outliers(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", 1.55, 0.3, 1.2)
    return x.filter("is_outlier").select("l_orderkey", "l_linenumber", "is_z", "is_iqr", "is_mad")


FIT = """fit as (select l_returnflag as flag, regr_count(l_extendedprice, l_quantity)::bigint as n, regr_slope(l_extendedprice, l_quantity) as slope, regr_intercept(l_extendedprice, l_quantity) as intercept, regr_r2(l_extendedprice, l_quantity) as r2,
 regr_syy(l_extendedprice, l_quantity) as syy, regr_sxx(l_extendedprice, l_quantity) as sxx from lineitem group by 1), err as (select *, sqrt((1 - r2) * syy / (sxx * (n - 2))) as std_err, sqrt((1 - r2) * syy / n) as residual_std from fit)"""


@query("linear_trend", f"with {FIT} select flag, n, round(slope, 4) as slope, round(intercept, 3) as intercept, round(r2, 6) as r2, round(std_err, 4) as std_err, case when abs(slope) < std_err then 'stable' when slope > 0 then 'increasing' else 'decreasing' end as direction from err")
def linear_trend(spark, d):
    x = stats.linear_trend(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_quantity", "l_extendedprice")
    return x.select("flag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("std_err", 4).alias("std_err"), "direction")


@query("forecast", f"with {FIT} select flag, round(intercept + slope * 51, 3) as next, round(intercept + slope * 51 - 1.96 * residual_std, 3) as next_low, round(intercept + slope * 51 + 1.96 * residual_std, 3) as next_high from err")
def forecast(spark, d):
    fit = stats.linear_trend(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_quantity", "l_extendedprice")
    return stats.forecast(fit, F.lit(50.0), {"next": 1.0}).select("flag", *[F.round(c, 3).alias(c) for c in ("next", "next_low", "next_high")])


@query("trend_p_values")
def trend_p_values(spark, d):
    fit = stats.linear_trend(papers(spark, d).withColumn("y", F.col("year").cast("double")), "venue", "y", "citations")
    return fit.select("venue", "n", F.round(stats.p_value("slope", "std_err", "n"), 6).alias("p"))


@query("calibration", "select l_linestatus || l_returnflag as field, regr_count(l_extendedprice, l_quantity)::bigint as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, regr_r2(l_extendedprice, l_quantity) > .7 as reliable from lineitem group by 1 having count(*) >= 5")
def calibration(spark, d):
    x = stats.calibration(table(spark, d, "lineitem").withColumn("field", F.concat("l_linestatus", "l_returnflag")), "field", "l_extendedprice", "l_quantity")
    return x.select("field", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "reliable")


@query("temporal_consistency", "with {papers} select venue, count(*) as n, round(exp(regr_slope(ln(citations), year)) - 1, 6) as growth from papers where citations > 0 group by venue")
def temporal_consistency(spark, d):
    return rounded(stats.temporal_consistency(papers(spark, d), "venue", "year", "citations"))


@query("cross_consistency", """with {papers}, s as (select venue, avg(citations) as m, stddev_pop(citations) as sd, count(*) as n from papers group by 1)
 select venue, any_value(n) as n, round(any_value(sd / m), 6) as cv, round(avg((abs(citations - m) > 2 * sd)::int), 6) as outlier_share, any_value(sd / m) <= 1 and avg((abs(citations - m) > 2 * sd)::int) <= .2 as consistent from papers join s using (venue) group by venue""")
def cross_consistency(spark, d):
    return rounded(stats.cross_consistency(papers(spark, d), "venue", "citations"))


@query("embedding_clusters")
def embedding_clusters(spark, d):
    return stats.clusters(table(spark, d, "embeddings"), "embedding", 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query("text_clusters")
def text_clusters(spark, d):
    return stats.text_clusters(table(spark, d, "benchmark"), "text", 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("threshold_adaptation")
def threshold_adaptation(spark, d):
    c = F.col("citations")
    seen = papers(spark, d).groupBy("venue", "year").agg(F.avg((c >= 150).cast("double")).alias("precision"), F.avg((c >= 50).cast("double")).alias("recall"), F.avg((c >= 100).cast("double")).alias("efficiency"))
    seen = seen.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return rounded(optimizer.adapted(seen, "venue", "year", {"paper": 0.5, "combined": 0.5, "citations": 10, "venue": 0.5}))


# ---------------------------------------------------------------- predicates


@query("filter_with_preservation", THRESHOLD + """ select reason, count(*) as n from (select case when p.citations >= 300 then 'breakthrough' when p.citations is null then 'no_citations' when p.citations >= coalesce(threshold, 5) then 'above_threshold' else 'below_threshold' end as reason from papers p left join thr using (venue, year)) group by 1""")
def filter_with_preservation(spark, d):
    p = papers(spark, d)
    t = agg.adaptive_thresholds(p, AS_OF).select("venue", "year", "threshold")
    return filters.preserve_filter(p, t, ["venue", "year"], "citations", F.col("citations") >= 300).groupBy("reason").agg(F.count("*").alias("n"))


CHECKS = {"citations": "citations >= 100", "recent": "year >= 1995", "domain": "domain <> 'BUILDING'"}


@query("reasons_and_rejections", "with {papers}, r as (" + " union all ".join(f"select '{k}' as reason from papers where not ({v})" for k, v in CHECKS.items()) + ") select reason, count(*) as n, round(count(*) / (select count(*) from r), 6) as share from r group by 1")
def reasons_and_rejections(spark, d):
    x = filters.with_reasons(papers(spark, d), {k: F.expr(v) for k, v in CHECKS.items()})
    return rounded(filters.rejection_counts(x))


@query("threshold_impact", "with {papers} select 'low' as scenario, count(*) filter (citations >= 50) as passed, count(*) as n from papers union all select 'high', count(*) filter (citations >= 250), count(*) from papers")
def threshold_impact(spark, d):
    return filters.threshold_impact(papers(spark, d), {"low": F.col("citations") >= 50, "high": F.col("citations") >= 250})


@query("borderline_papers", "with {papers} select count(*) filter (abs(citations - 100) <= 10) as borderline, count(*) as n from papers")
def borderline_papers(spark, d):
    return papers(spark, d).agg(F.count_if(filters.borderline(F.col("citations"), 100, 0.1)).alias("borderline"), F.count("*").alias("n"))


@query("contract_violations", """select 'price_range' as rule, count(*) as n, min(l_orderkey) as first_key from lineitem where not (l_extendedprice between 5000 and 50000) having count(*) > 0
 union all select 'price_critical', count(*), min(l_orderkey) from lineitem where not (l_extendedprice between 500 and 500000) having count(*) > 0 union all select 'quantity_range', count(*), min(l_orderkey) from lineitem where not (l_quantity between 2 and 49) having count(*) > 0""")
def contract_violations(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    rules = filters.range_rules({"price": (5000, 50000), "quantity": (2, 49)})
    return filters.violation_counts(x, rules, "l_orderkey")


VELOCITY = f"case when citations > 0 then citations / greatest(1, {AS_OF} - year) else 0 end"


@query("breakthrough_scores", f"""with {{papers}}, v as (select paper_id, {VELOCITY} as v, greatest(1, {AS_OF} - year) as age, tier from papers)
 select paper_id, round(least(1.0, .3 * case when v >= 50 then 1.0 when v >= 20 then .8 when v >= 10 then .6 when v >= 5 then .4 when v >= 2 then .2 else 0 end + .25 * least(1.0, 2 / 5) + .2 * least(1.0, .3)
 + .15 * case tier when 'tier1' then 1.0 when 'tier2' then .8 when 'tier3' then .6 else .4 end + .1 * case when age <= 1 then 1.0 when age <= 2 then .8 when age <= 3 then .6 when age <= 5 then .4 else .2 end), 6) as score from v""")
def breakthrough_scores(spark, d):
    s = scores.breakthrough(F.col("citations"), F.col("year"), F.lit(2), F.lit(1), F.col("tier"), AS_OF)
    return rounded(papers(spark, d).select("paper_id", s.alias("score")))


@query("scaling_rules", """select l_orderkey, l_linenumber, case when h >= p * 20 and h <= p * 500 then 'ok' when h >= p * 2 and h <= p * 5000 then 'warning' else 'error' end as verdict, round(log10(h / (pow(p * 1e9, .7) / 1e6)), 6) as gap from (select l_orderkey, l_linenumber, l_quantity as p, l_extendedprice as h from lineitem)""")
def scaling_rules(spark, d):
    p, h = F.col("l_quantity") * 1e9, F.col("l_extendedprice")
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.scaling_verdict(p, h).alias("verdict"), scores.scaling_gap(h, p).alias("gap")))


# ---------------------------------------------------------------- quality


@query("completeness", "select round(avg((text is not null and length(trim(text)) > 0)::int), 6) as has_text, round(avg((lang is not null and length(trim(lang)) > 0)::int), 6) as has_lang, round(avg((quality is not null)::int), 6) as has_quality, count(*) as n, round(.8 * (avg((text is not null and length(trim(text)) > 0)::int) + avg((lang is not null and length(trim(lang)) > 0)::int)) / 2 + .2 * avg((quality is not null)::int), 6) as score, .8 * (avg((text is not null and length(trim(text)) > 0)::int) + avg((lang is not null and length(trim(lang)) > 0)::int)) / 2 + .2 * avg((quality is not null)::int) >= .8 as passed from documents left join labels using (doc_id)")
def completeness(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(quality.completeness(x, ["text", "lang"], ["quality"]))


@query("duplicate_title_score", "with t as (select lower(text) as t, count(*) as c from documents where length(trim(text)) > 0 group by 1) select (sum(c - 1))::bigint as repeats, sum(c)::bigint as n, round(greatest(0, 1 - 2 * sum(c - 1) / sum(c)), 6) as score from t")
def duplicate_title_score(spark, d):
    return rounded(quality.duplicate_title_score(table(spark, d, "documents"), "text"))


@query("venue_consistency", "with v as (select lower(c_name) as v, count(distinct c_name) as forms from customer group by 1) select count(*) as venues, count(*) filter (forms > 1) as inconsistent, round(1 - count(*) filter (forms > 1) / count(*), 6) as score from v")
def venue_consistency(spark, d):
    return rounded(quality.venue_consistency(table(spark, d, "customer"), "c_name"))


@query("year_validity", "with {papers} select count(*) as n, count(*) filter (not coalesce(year between 1950 and 1998, false)) as invalid, round(1 - count(*) filter (not coalesce(year between 1950 and 1998, false)) / count(*), 6) as score from papers")
def year_validity(spark, d):
    return rounded(quality.year_validity(papers(spark, d), F.col("year"), 1997))


@query("url_accuracy", r"select count(*) as n, count(*) filter (regexp_matches(url, '^[a-z]+://[^/\s]+')) as valid, round(count(*) filter (regexp_matches(url, '^[a-z]+://[^/\s]+')) / count(*), 6) as score from pages")
def url_accuracy(spark, d):
    return rounded(quality.url_accuracy(table(spark, d, "pages"), "url"))


@query("venue_coverage", "with {papers}, n as (select venue, count(*) as n from papers group by 1) select count(*) as venues, sum(n)::bigint as n, max(n) as most, 0::bigint as unknown, round(greatest(0, least(1, 10 * count(*) / sum(n))), 6) as score, max(n) > 10 * sum(n) / count(*) as imbalanced from n")
def venue_coverage(spark, d):
    return rounded(quality.venue_coverage(papers(spark, d), "venue"))


@query("year_coverage", "with {papers} select min(year) as first, max(year) as last, round(least(1.0, (max(year) - min(year) + 1) / 5), 6) as score, max(year) >= {AS_OF} - 1 as recent from papers")
def year_coverage(spark, d):
    return rounded(quality.year_coverage(papers(spark, d), "year", AS_OF))


@query("source_coverage", "select count(distinct case when lower(source) <> 'unknown' then source end) as sources, round(least(1.0, count(distinct source) / 3), 6) as score from documents")
def source_coverage(spark, d):
    return rounded(quality.source_coverage(table(spark, d, "documents"), "source"))


@query("domain_balance", "with n as (select source, count(*) as n from documents group by 1) select source, n, round(n / sum(n) over (), 6) as share, case when n / sum(n) over () > .5 then 'dominant' when n / sum(n) over () < .05 and sum(n) over () > 100 then 'rare' else 'ok' end as verdict from n")
def domain_balance(spark, d):
    return rounded(quality.domain_balance(table(spark, d, "documents"), "source"))


@query("temporal_balance", "with {papers}, y as (select unnest(range(1990, 2001))::int as year), n as (select year, count(*) as n from papers group by 1), x as (select y.year, coalesce(n, 0) as n from y left join n using (year)) select year, n, round(n / sum(n) over (), 6) as share, n / sum(n) over () >= .05 as enough from x")
def temporal_balance(spark, d):
    return rounded(quality.temporal_balance(papers(spark, d), "year", 1990, 2000))


@query("identical_counts", "with {papers} select citations, count(*) as n, min(paper_id) as example from papers where citations > 100 group by 1 having count(*) > 5")
def identical_counts(spark, d):
    return quality.identical_counts(papers(spark, d), "citations", "paper_id")


@query("field_coverage", " union all ".join(f"select l_returnflag, '{f}' as field, count(*) as n, round(avg(({f} is not null)::int), 6) as coverage, count(distinct {f}) as \"values\", round(avg({f}), 6) as mean, round(stddev_samp({f}), 6) as std from lineitem group by 1" for f in ("l_quantity", "l_discount", "l_tax")))
def field_coverage(spark, d):
    return rounded(quality.field_coverage(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"]))


# ---------------------------------------------------------------- joins


@query("id_cascade", """with a as (select c_custkey as k, min(c_name) as v from customer where c_acctbal > 5000 group by 1), b as (select c_custkey as k, min(c_name) as v from customer where c_acctbal > 0 group by 1)
 select o_orderkey, coalesce(a.v, b.v) as found, case when a.v is not null then 'rich' when b.v is not null then 'solvent' else 'none' end as found_by from orders left join a on a.k = o_custkey left join b on b.k = o_custkey""")
def id_cascade(spark, d):
    c = table(spark, d, "customer")
    rich, solvent = c.filter("c_acctbal > 5000"), c.filter("c_acctbal > 0")
    out = joins.lookup_cascade(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [(rich, F.col("o_custkey"), "rich"), (solvent, F.col("o_custkey"), "solvent")], "c_custkey", "c_name")
    return out.select("o_orderkey", "found", "found_by")


@query("enrichment", "select c_custkey, count(o_orderkey) as n, coalesce(max(o_totalprice), 0) as most from customer left join orders on o_custkey = c_custkey group by 1")
def enrichment(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    x = joins.enrich(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), o.select("o_orderkey", "o_totalprice"), "c_custkey", "o_orderkey")
    return x.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("most"))


@query("multi_source_merge", """with a as (select o_custkey as k, case when o_orderstatus = 'F' then o_orderpriority end as p, o_orderkey as i, 0 as s from orders), b as (select c_custkey as k, c_mktsegment as p, c_custkey as i, 1 as s from customer), u as (select * from a union all select * from b)
 select k, arg_min(p, {'s': s, 'i': i}) filter (p is not null) as p, count(*) as records from u group by k""")
def multi_source_merge(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    a = o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("p"), F.col("o_orderkey").alias("i"), F.array("o_orderkey").alias("r"))
    b = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("p"), F.col("c_custkey").alias("i"), F.array("c_custkey").alias("r"))
    return joins.merge_sources([a, b], "k", ["p"], ["r"], "i").select("k", "p", F.size("r").cast("long").alias("records"))


@query("resume_union", "select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0 union all select o_orderkey, 0.0 from orders where o_orderkey % 2 <> 0")
def resume_union(spark, d):
    o = table(spark, d, "orders")
    new = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    return joins.resume(new, o.select("o_orderkey", F.lit(0.0).alias("o_totalprice")), "o_orderkey")


@query("unprocessed", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def unprocessed(spark, d):
    done = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_done(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("exact_duplicates", "select md5(text) as key, count(*) as n, min(doc_id) as first_id, count(distinct source) as sources from documents where text is not null group by text having count(*) > 1 and count(distinct source) > 1")
def exact_duplicates(spark, d):
    return joins.exact_duplicates(table(spark, d, "documents"), F.md5(F.col("text").cast("binary")), "doc_id", "source")


@query("manual_vs_automated", """with {papers}, a as (select venue, year, avg(citations) as v from papers where paper_id % 2 = 0 group by 1, 2), b as (select venue, year, avg(citations) as v from papers where paper_id % 2 <> 0 group by 1, 2)
 select venue, year, round(a.v, 6) as one, round(b.v, 6) as two, coalesce(abs(a.v - b.v) <= .1 * greatest(abs(a.v), abs(b.v)), false) as agree from a full join b using (venue, year)""")
def manual_vs_automated(spark, d):
    p = papers(spark, d)
    half = lambda odd: p.filter(F.col("paper_id") % 2 == odd).groupBy("venue", "year").agg(F.avg("citations").alias("v"))
    other = p.filter(F.col("paper_id") % 2 != 0).groupBy("venue", "year").agg(F.avg("citations").alias("v"))
    return rounded(joins.compare_long(half(0), other, ["venue", "year"], "v"))


@query("overlap", "with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders), x as (select a.k as l, b.k as r from a full join b on a.k = b.k) select count(*) filter (l is not null and r is not null) as both, count(*) filter (r is null) as left_only, count(*) filter (l is null) as right_only, round(count(*) filter (l is not null and r is not null) * 100.0 / count(*) filter (l is not null), 6) as coverage from x")
def overlap(spark, d):
    return rounded(joins.overlap(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k"))


@query("venue_merge", "with {papers}, n as (select venue, count(*) as n, sum(citations)::bigint as citations from papers group by 1) select case when venue in ('NATION_1', 'NATION_2', 'NATION_3') then 'ASIA' else venue end as venue, sum(n)::bigint as n, sum(citations)::bigint as citations from n group by 1")
def venue_merge(spark, d):
    n = papers(spark, d).groupBy("venue").agg(F.count("*").alias("n"), F.sum("citations").alias("citations"))
    mapping = spark.createDataFrame([(x, "ASIA") for x in ("NATION_1", "NATION_2", "NATION_3")], "venue string, canonical string")
    return joins.merge_by_mapping(n, mapping, "venue", "canonical", ["n", "citations"])


@query("domain_year_grid", "with {papers}, g as (select * from (select distinct domain from papers) cross join (select distinct year from papers)), n as (select domain, year, count(*) as n from papers group by 1, 2) select g.domain, g.year, coalesce(n, 0) as n from g left join n on n.domain = g.domain and n.year = g.year")
def domain_year_grid(spark, d):
    return joins.grid_coverage(papers(spark, d), "domain", "year")


@query("missing_expected", "select n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey % 7 = 0)")
def missing_expected(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").filter("s_suppkey % 7 = 0")
    return joins.missing_expected(n.select("n_name", "n_nationkey"), s.select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey").select("n_name")


@query("set_operations", "select 'both' as part, count(*) as n from (select c_custkey from customer intersect select o_custkey from orders) union all select 'left', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'right', count(*) from (select o_custkey from orders except select c_custkey from customer)")
def set_operations(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    parts = {"both": a.intersect(b), "left": a.subtract(b), "right": b.subtract(a)}
    out = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
