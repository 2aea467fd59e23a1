"""Queries over prose indicators, affiliations and request waits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import prose
from scholia.plans.base import AS_OF, papers, query, rounded, table
from scholia.streaming import alerts

def _hits(words):
    return "(" + " + ".join(f"contains(low, '{w}')::int" for w in words) + ")"


#: Phrases that are put behind each text in turn, so that every table entry occurs, and some that nearly do.
PLANTED = [*dict.fromkeys(w for words in (*prose.PHRASES.values(), *(x for _, x in prose.FAMILIES.values()), *prose.SIGNS.values(), *prose.FLAGS.values()) for w in words), "Outcome", "experimenting", "methods", "implementing", "finding"]
_PICK = "[" + ", ".join(f"'{w}'" for w in PLANTED) + "]"
PLANTED_SQL = f"t as (select doc_id, coalesce(text, '') || ' ' || {_PICK}[1 + doc_id % {len(PLANTED)}] || ' ' || {_PICK}[1 + (7 * doc_id + 3) % {len(PLANTED)}] || ' ' || {_PICK}[1 + (doc_id // 3) % {len(PLANTED)}] as text from documents), l as (select doc_id, text, lower(text) as low from t)"


def planted(spark, d):
    pick = lambda e: F.get(F.array(*map(F.lit, PLANTED)), F.expr(f"cast({e} % {len(PLANTED)} as int)"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), pick("doc_id"), pick("(7 * doc_id + 3)"), pick("(doc_id div 3)")).alias("text"))


@query("experimental_indicators", f"with {PLANTED_SQL} select doc_id, " + ", ".join(f"{_hits(w)} as {k}" for k, w in prose.PHRASES.items()) + ", " + ", ".join(f"{_hits(w)} > 0 as {k}" for k, w in prose.FLAGS.items()) + " from l")
def experimental_indicators(spark, d):
    return planted(spark, d).select("doc_id", prose.indicators(F.col("text")).alias("x")).select("doc_id", "x.*")


_SECTION = {k: f"regexp_matches(text, '(?i){p}')" for k, p in prose.SECTIONS.items()}
_EXPERIMENTAL = f"""with {PLANTED_SQL}, p as (select doc_id, {', '.join(f"{_hits(w)} / {len(w)} as f_{k}" for k, (_, w) in prose.FAMILIES.items())}, {', '.join(f"{x} as s_{k}" for k, x in _SECTION.items())}, {', '.join(f"{_hits(w)} > 0 as g_{k}" for k, w in prose.SIGNS.items())} from l),
 q as (select *, {' + '.join(f'g_{k}::int' for k in prose.SIGNS)} as signs, {' + '.join(f's_{k}::int' for k in prose.SECTIONS)} as sections from p),
 r as (select *, least(1.0, .3 * f_experimental + .2 * f_methodology + .2 * f_implementation + .15 * f_quantitative + .02 * sections + .01 * signs)::double as score from q)
 select doc_id, round(score, 6) as score, score >= .4 or (s_results and s_experiments) or signs >= 3 or (g_implementation_details and g_performance_metrics) as is_experimental,
 round(least(1.0, .7 * score + case when s_results then .15 else 0 end + case when s_methodology then .1 else 0 end + case when s_evaluation then .05 else 0 end)::double, 6) as confidence from r"""


@query("experimental_scores", _EXPERIMENTAL)
def experimental_scores(spark, d):
    return rounded(planted(spark, d).select("doc_id", prose.experimental(F.col("text")).alias("x")).select("doc_id", "x.*"))


#: Sentences, and whether they tell of a record.
CLAIMS = [("State of the Art", True), ("a SOTA result", True), ("a new   record", True), ("it surpassed previous work", True), ("we outperformed", True), ("Best  performance", True), ("achieves new heights", True), ("superior to existing", True),
          ("plain words", False), ("BERT base", True), ("a vital step", True), ("record new", False), ("Yolo", True), ("ResNets", True), ("achieving", False), ("performance best", False), ("surpasses all", False), ("AlphaFold 2", True)]


@query("sota_papers", "with {papers} select paper_id from papers where [" + ", ".join(str(x).lower() for _, x in CLAIMS) + f"][1 + paper_id % {len(CLAIMS)}]" + " or citations > 50 * ({AS_OF} - year) and year < {AS_OF}")
def sota_papers(spark, d):
    claim = F.get(F.array(*[F.lit(x) for x, _ in CLAIMS]), (F.col("paper_id") % len(CLAIMS)).cast("int"))
    return papers(spark, d).filter(prose.is_sota(claim, F.col("citations"), F.col("year"), AS_OF)).select("paper_id")


@query("plausibility", """with {papers}, x as (select paper_id, year + 24 as year, ['V100', 'A100 80GB', 'TPU v3', 'H100', 'RTX 3090'][1 + paper_id % 5] as kind, case when paper_id % 7 <> 0 then citations * 4000 end as hours, case when paper_id % 7 > 1 then price * case when paper_id % 3 = 0 then 1e5 else 1e7 end end as params from papers)
 select paper_id, round((case when kind = 'V100' and year < 2017 or kind = 'A100 80GB' and year < 2020 or kind = 'TPU v3' and year < 2016 or kind = 'H100' and year < 2022 then .3 else 1 end
 * case when year <= 2018 and params > 1e9 then .7 when year <= 2020 and params > 1e10 then .6 when year <= 2022 and params > 1e11 then .7 when params > 1e12 then .8 else 1 end
 * case when hours > 1000000 then .5 when hours > 100000 then .8 else 1 end * case when coalesce(hours, 0) = 0 and coalesce(params, 0) = 0 then .3 else 1 end)::double, 6) as score from x""")
def plausibility(spark, d):
    kind = F.get(F.array(*map(F.lit, ["V100", "A100 80GB", "TPU v3", "H100", "RTX 3090"])), (F.col("paper_id") % 5).cast("int"))
    hours = F.when(F.col("paper_id") % 7 != 0, F.col("citations") * 4000)
    params = F.when(F.col("paper_id") % 7 > 1, F.col("price") * F.when(F.col("paper_id") % 3 == 0, 1e5).otherwise(1e7))
    return rounded(papers(spark, d).select("paper_id", prose.plausibility(kind, F.col("year") + 24, hours, params).alias("score")))


@query("field_agreement", "select count(*) filter (lower(c_mktsegment) = 'building') as text, count(*) filter (abs(c_acctbal - 5000) <= .1 * greatest(abs(c_acctbal), 5000)) as number, count(*) filter (c_mktsegment = 'BUILDING') as list from customer")
def field_agreement(spark, d):
    c = table(spark, d, "customer")
    return c.agg(F.count_if(prose.field_agreement("text", F.col("c_mktsegment"), F.lit(" Building "))).alias("text"), F.count_if(prose.field_agreement("number", F.col("c_acctbal"), F.lit(5000.0))).alias("number"),
                 F.count_if(prose.field_agreement("list", F.array("c_mktsegment"), F.array(F.lit("BUILDING")))).alias("list"))


@query("request_waits", """with x as (select event_id, event_type, ts, (value >= 20)::int as ok, row_number() over w as n, count(*) over f as in_window, min(epoch(ts)) over f as oldest from events
  window w as (partition by event_type order by ts, event_id), f as (partition by event_type order by epoch(date_trunc('second', ts))::bigint range between 3600 preceding and current row)),
 y as (select *, n - coalesce(max(case when ok = 1 then n end) over (partition by event_type order by n), 0) as e, avg(ok) over (partition by event_type order by n rows between 49 preceding and current row) as r from x),
 z as (select *, case when e >= 10 then 'offline' when e >= 5 or r < .5 then 'critical' when e >= 3 or r < .8 then 'degraded' else 'healthy' end as health from y)
 select event_id, health, in_window, round(least(60.0, greatest(case when in_window >= 3 then oldest + 3600 - epoch(ts) else 0 end * case health when 'healthy' then 1 when 'degraded' then 2 when 'critical' then 5 else 10 end,
  case when e > 0 then least(60.0, 2.0 ^ least(e, 16)) else 0 end) * case when event_id % 40 > 0 then least((1 + event_id % 40) / 10, 3.0) else 1 end), 6) as wait from z""")
def request_waits(spark, d):
    x = alerts.request_waits(table(spark, d, "events"), "event_type", "ts", "event_id", F.col("value") >= 20, 3, 3600, size=1 + F.col("event_id") % 40)
    return rounded(x.select("event_id", "health", "in_window", "wait"))
