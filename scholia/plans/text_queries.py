"""Queries over texts, URLs and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import extract, fuzzy, scores
from scholia.functions import text as tx
from scholia.operators import contain, dedup, joins
from scholia.operators.graph import connected
from scholia.plans.base import papers, query, rounded, table
from scholia.streaming import alerts


def _regex(c: str, patterns: list[str], by: str = "", flags: str = "g") -> str:
    for p in patterns:
        p = p.replace("'", "''")
        c = f"regexp_replace({c}, '{p}', '{by}', '{flags}')"
    return c


@query("title_keys", "select doc_id, md5(trim(regexp_replace(" + _regex("regexp_replace(lower(coalesce(text, '')), '^\\s+|\\s+$', '', 'g')", tx.TITLE_NOISE) + ", '\\s+', ' ', 'g'))) as key from documents")
def title_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.title_key(F.col("text")).cast("binary")).alias("key"))


@query("author_keys", "select c_custkey, trim(regexp_replace(replace(lower(c_name), '.', ' '), '\\s+', ' ', 'g')) as key from customer")
def author_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.author_key(F.col("c_name")).alias("key"))


DOIS = "case page_id % 4 when 0 then 'https://doi.org/10.' || (1000 + page_id) || '/a.b' when 1 then 'doi:10.12/x' when 2 then ' 10.55555/y(z) ' else 'none' end"


@query("doi_keys", f"with x as (select page_id, {DOIS} as doi from pages), y as (select page_id, trim(case when starts_with(trim(doi), 'https://doi.org/') then substr(trim(doi), 17) when starts_with(trim(doi), 'doi:') then substr(trim(doi), 5) else trim(doi) end) as k from x) select page_id, case when regexp_matches(k, '^10\\.\\d{{4,}}/[^\\s]+') then k end as doi from y".replace("{{", "{").replace("}}", "}"))
def doi_keys(spark, d):
    return table(spark, d, "pages").select("page_id", tx.doi_key(F.expr(DOIS)).alias("doi"))


ARXIV = "case page_id % 4 when 0 then 'arXiv:2101.0' || (1000 + page_id % 1000) || 'v2' when 1 then 'http://arxiv.org/pdf/2101.12345.pdf' when 2 then 'cs.LG/0701234' else 'x' end"


@query("arxiv_keys", f"with x as (select page_id, {ARXIV} as a from pages), y as (select page_id, regexp_replace(regexp_replace(case when starts_with(a, 'arXiv:') then substr(a, 7) when starts_with(a, 'http://arxiv.org/pdf/') then substr(a, 22) else a end, '\\.pdf$', ''), 'v\\d+$', '') as k from x) select page_id, case when regexp_matches(k, '^(?:\\d{{4}}\\.\\d{{4,5}}|[a-zA-Z\\-\\.]+/\\d{{7}})') then k end as arxiv_id from y".replace("{{", "{").replace("}}", "}"))
def arxiv_keys(spark, d):
    return table(spark, d, "pages").select("page_id", tx.arxiv_key(F.expr(ARXIV)).alias("arxiv_id"))


@query("content_hashes", "with {papers} select paper_id, sha256(concat_ws('|', domain, author, venue, year::varchar)) as hash from papers")
def content_hashes(spark, d):
    return papers(spark, d).select("paper_id", tx.content_hash(F.col("domain"), F.array("author"), F.col("venue"), F.col("year")).alias("hash"))


@query("title_year_hashes", "with {papers} select paper_id, substr(md5(lower(author) || '_' || year), 1, 16) as hash from papers")
def title_year_hashes(spark, d):
    return papers(spark, d).select("paper_id", tx.title_year_hash(F.col("author"), F.col("year")).alias("hash"))


WORDS = ["license", "the", "email", "contact"]


@query("keyword_counts", "select doc_id, " + ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)})::bigint as n_{w}" for w in WORDS) + " from (select doc_id, coalesce(text, '') as text from documents)")
def keyword_counts(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", *[tx.occurrences(low, w).alias(f"n_{w}") for w in WORDS])


@query("word_counts", r"select doc_id, len(list_filter(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+'), lambda w: w in ('the', 'und', 'que')))::bigint as n from (select doc_id, coalesce(text, '') as text from documents)")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.coalesce("text", F.lit("")), ["the", "und", "que"]).alias("n"))


KINDS = {"en": ["the ", " and "], "de": [" der ", " und ", " die "], "es": [" que ", " los "], "fr": [" les ", " et ", " des "]}


def _hits(words):
    return " + ".join(f"contains(text, '{w}')::int" for w in words)


@query("domain_argmax", "with h as (select doc_id, " + ", ".join(f"{_hits(w)} as h_{k}" for k, w in KINDS.items()) + " from documents) select doc_id, case when greatest(h_en, h_de, h_es, h_fr) = 0 then 'other' when h_en >= greatest(h_de, h_es, h_fr) then 'en' when h_de >= greatest(h_es, h_fr) then 'de' when h_es >= h_fr then 'es' else 'fr' end as label from h")
def domain_argmax(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.most_hits(F.col("text"), KINDS, "other").alias("label"))


@query("first_match_labels", "select doc_id, case when regexp_matches(text, 'license|License') then 'license' when contains(text, '@') then 'contact' when regexp_matches(text, '[0-9]{4}') then 'number' else 'plain' end as label from documents")
def first_match_labels(spark, d):
    rules = [("license", "license|License"), ("contact", "@"), ("number", "[0-9]{4}")]
    return table(spark, d, "documents").select("doc_id", tx.first_label(F.col("text"), rules, "plain").alias("label"))


@query("letter_grades", "with {papers} select paper_id, case " + " ".join(f"when citations / 500 >= {b} then '{g}'" for b, g in tx.GRADES) + " else 'F' end as grade from papers")
def letter_grades(spark, d):
    return papers(spark, d).select("paper_id", tx.grade(F.col("citations") / 500).alias("grade"))




#: Sentences by line number: <> is the line's number, [] the number after it, {} its quantity. Each reaches other patterns.
RESOURCES = ["We trained on [] V100 GPUs for {} days. The model has <>.5 billion parameters.", "{} x A100 for 3 weeks, model size: <> B, total: {},000 GPU-hours following [3]", "trained on [] T4 in parallel on 4 nodes for 2.5 hours, <>00 million parameters",
             "pre-training, then fine-tuning with cloud credits of 5,000 dollars; {} times more compute", "", "for {} hours"]
_Q, _N = "l_quantity::int", "l_linenumber"


def _told(values: list[str]) -> str:
    return "case l_linenumber % 6 " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _resources(spark, d):
    text = F.get(F.array(*map(F.lit, RESOURCES)), (F.col("l_linenumber") % 6).cast("int"))
    for mark, value in (("{}", F.col("l_quantity").cast("int")), ("<>", F.col("l_linenumber")), ("[]", F.col("l_linenumber") + 1)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))


@query("requirements", f"""select l_orderkey, l_linenumber, {_told(["'V100'", "'A100'", "'T4'", 'null', 'null', 'null'])} as gpu_type, ({_told([f'{_N} + 1', _Q, f'{_N} + 1', 'null', 'null', 'null'])})::bigint as gpu_count,
 ({_told([f'{_Q} * 24', '504', '2.5', 'null', 'null', _Q])})::double as training_hours, ({_told([f'({_N} + .5) * 1000', f'{_N} * 1000', f'{_N} * 100', 'null', 'null', 'null'])})::double as parameters_millions,
 ({_told([f'({_N} + 1) * {_Q} * 24', f'{_Q} * 1000', f'({_N} + 1) * 2.5', 'null', 'null', 'null'])})::double as gpu_hours, ({_told(['1', '1', '1', '0', '0', 'round(1 / 6 + .2, 6)'])})::double as confidence from lineitem""")
def requirements(spark, d):
    return rounded(_resources(spark, d).select("l_orderkey", "l_linenumber", extract.requirements(F.col("t")).alias("r")).select("l_orderkey", "l_linenumber", "r.*"))


@query("pattern_kinds", f"""select l_orderkey, l_linenumber, {_told(["'explicit_resource'", "'explicit_resource,implicit_information'", "'distributed_training'", "'multiple_phases,cloud_credits,relative_reference'", "''", "''"])} as kinds from lineitem""")
def pattern_kinds(spark, d):
    return _resources(spark, d).select("l_orderkey", "l_linenumber", F.array_join(extract.pattern_kinds(F.col("t")), ",").alias("kinds"))


@query("suppression_scores", """with x as (select p_partkey, p_size % 7 as a, nullif(p_size % 6, 5) as s, p_size % 5 as b, p_size as c from part),
 w as (select p_partkey, .3 * case when a < 3 then 1.0 when a < 6 then .5 else 0 end + coalesce(.25 * case when s < 3 then 1.0 when s < 5 then .5 when s is not null then 0 end, 0) + .25 * case when b < 3 then 1.0 when b < 5 then .5 else 0 end + .2 * case when c < 25 then 1.0 when c < 50 then .5 else 0 end as t, .3 + case when s is not null then .25 else 0 end + .25 + .2 as d from x)
 select p_partkey, round(t / d, 6) as score from w""")
def suppression_scores(spark, d):
    a, s, b, c = F.col("p_size") % 7, F.nullif(F.col("p_size") % 6, F.lit(5)), F.col("p_size") % 5, F.col("p_size")
    return rounded(table(spark, d, "part").select("p_partkey", extract.suppression(a, s, b, c).alias("score")))


@query("richness_formulas", "select p_partkey, round(.4 * least(1.0, p_size / 50) + .3 * least(1.0, (p_size % 6) / 4) + .3 * least(1.0, (p_size % 13) / 10), 6) as by_keywords, round(least(.6, 100.0 * (p_size % 9) / (p_size * 4) * .15) * case when p_size % 2 = 0 then .7 else 1 end, 6) as by_density from part")
def richness_formulas(spark, d):
    s = F.col("p_size")
    return rounded(table(spark, d, "part").select("p_partkey", extract.richness_keyword(s, s % 6, s % 13).alias("by_keywords"), extract.richness_density(s % 9, s * 4, s % 2 == 0).alias("by_density")))


@query("error_kinds", "with m as (select event_id, case event_id % 5 when 0 then 'HTTP 404' when 1 then 'read timeout' when 2 then 'status 503' when 3 then 'Connection reset' else 'odd' end as m from events) select event_id, case when contains(m, '404') then 'not_found' when contains(m, 'timeout') then 'timeout' when contains(m, 'Connection') then 'connection' when contains(m, '50') then 'server_error' else 'unknown' end as kind, contains(m, '404') as permanent from m")
def error_kinds(spark, d):
    m = F.expr("case event_id % 5 when 0 then 'HTTP 404' when 1 then 'read timeout' when 2 then 'status 503' when 3 then 'Connection reset' else 'odd' end")
    return table(spark, d, "events").select("event_id", scores.error_kind(m).alias("e")).select("event_id", "e.*")


@query("json_properties", "select event_id, json_extract_string(props, '$.k') as k, len(json_keys(props))::bigint as n from events")
def json_properties(spark, d):
    x = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n"))
    return x


@query("url_parts", r"select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/:\s]+)', 1) as host from pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("contained_passages", "select b.item_id, count(*) as documents from benchmark b join documents d on contains(d.text, b.text) group by 1")
def contained_passages(spark, d):
    found = contain.containing(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"))


#: Ways to write a venue; {} is a name.
VENUES = ["Proc. of the 12th Intl. Conf. on {}", "{} 2023", "{} Workshop '24 (poster)", "NIPS {} - 2021", "Journal of {}, vol. 7", "{} Symp. and Tutorials", "ML for {}: main track", "Proceedings of the {} findings"]
_VENUE_SQL = "select p_partkey, replace([" + ", ".join("'" + v.replace("'", "''") + "'" for v in VENUES) + f"][1 + p_partkey % {len(VENUES)}], '{{}}', p_name) as v from part"
_BARE = "upper(trim(v))"
for _p in tx.VENUE_NOISE:
    _BARE = f"regexp_replace({_BARE}, '{_p.replace(chr(92) + chr(39), chr(39) * 2)}', '', 'gi')"
_EXPAND = "map {" + ", ".join(f"'{k}': '{v.upper()}'" for k, v in tx.VENUE_ABBREVIATIONS.items()) + "}"
_KEYS = f"""with v as ({_VENUE_SQL}), w as (select p_partkey, v, unnest(string_split({_BARE}, ' ')) as w, generate_subscripts(string_split({_BARE}, ' '), 1) as i from v),
 c as (select p_partkey, i, regexp_replace(w, '[^A-Za-z0-9_]', '', 'g') as w from w), e as (select p_partkey, i, coalesce({_EXPAND}[w], w) as w from c),
 x as (select p_partkey, i, unnest(string_split(w, ' ')) as w, generate_subscripts(string_split(w, ' '), 1) as j from e),
 k as (select p_partkey, w, row_number() over (partition by p_partkey order by i, j) as r from x where w <> '' and w not in ({', '.join(f"'{w}'" for w in tx.VENUE_STOP_WORDS)}))
 select p_partkey, coalesce(string_agg(w, ' ' order by r > 1, case when r > 1 then w end), '') as key from part left join k using (p_partkey) group by 1"""


def _venues(spark, d):
    shape = F.get(F.array(*map(F.lit, VENUES)), (F.col("p_partkey") % len(VENUES)).cast("int"))
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.replace(shape, F.lit("{}"), F.col("p_name")).alias("venue"))


@query("venue_keys", _KEYS)
def venue_keys(spark, d):
    return _venues(spark, d).select("p_partkey", tx.venue_key(F.col("venue")).alias("key"))


@query("venue_kinds", "select p_partkey, case p_partkey % 5 when 0 then 'workshop' when 1 then 'journal' when 2 then 'conference' when 3 then 'preprint' else 'other' end as kind from part")
def venue_kinds(spark, d):
    shape = F.get(F.array(*map(F.lit, ["Journal Workshop of ", "IEEE Transactions on ", "Symposium for ", "bioRxiv ", "Book of "])), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", tx.venue_kind(F.concat(shape, F.lit("things"))).alias("kind"))


@query("abbreviation_matches", "select p_partkey, p_partkey % 7 = 5 as written_out from part")
def abbreviation_matches(spark, d):
    """Keys sort their words and drop stop words, so only expansions that
    survive that are found."""
    one, two = (F.get(F.array(*map(F.lit, x)), (F.col("p_partkey") % 7).cast("int")) for x in (["KD", "x", "y", "WWWISE machine LEARNING", "z", "SAID intelligence ARTIFICIAL", "q"], ["a", "KDDX", "b", "ANY HTML machine learning", "c", "FAIR artificial intelligence", "d"]))
    return table(spark, d, "part").select("p_partkey", tx.abbreviation_match(one, two).alias("written_out"))


@query("loose_titles", r"select p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(lower(['The  ', 'An ', '', 'a: '][1 + p_partkey % 4] || p_name || [' (study)', ' Method', '!', ' analysis paper'][1 + p_partkey % 4])), '[^a-z0-9_ ]', '', 'g'), '^(the|a|an) +', ''), ' +(paper|study|analysis|approach|method)$', '') as key from part")
def loose_titles(spark, d):
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % 4).cast("int"))
    title = F.concat(pick("The  ", "An ", "", "a: "), F.col("p_name"), pick(" (study)", " Method", "!", " analysis paper"))
    return table(spark, d, "part").select("p_partkey", tx.loose_title(title).alias("key"))


def _names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("title"))


@query("fuzzy_pairs")
def fuzzy_pairs(spark, d):
    """Pairs of distinct titles, with how many parts have each."""
    return rounded(dedup.similar_titles(_names(spark, d), "title", 0.95))


@query("fuzzy_groups")
def fuzzy_groups(spark, d):
    """Groups of titles under the least title, with their parts."""
    names = _names(spark, d)
    pairs = dedup.similar_titles(names, "title", 0.95)
    known = connected(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    out = names.withColumn("h", F.xxhash64("title")).join(known.withColumnRenamed("node", "h"), "h", "left")
    return out.groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("title").alias("title"), F.count("*").alias("n")).select("title", "n")


@query("best_venue_match")
def best_venue_match(spark, d):
    c, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = c.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lower("n_name"), F.lit("s")).alias("v"))
    known = n.select(F.lower("n_name").alias("v"))
    return rounded(joins.best_match(rows, F.col("v"), known, "v", fuzzy.similarity("title"), 0.9, [("equal", F.col("_n") == F.col("_c"))]))


# ---------------------------------------------------------------- streams (over event time, in batch form)


@query("event_rates", "select time_bucket(interval '6 hours', ts) as start, time_bucket(interval '6 hours', ts) + interval '6 hours' as end, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2, 3")
def event_rates(spark, d):
    return rounded(alerts.rates(table(spark, d, "events"), "ts", "event_type", "6 hours"))


@query("event_sessions", """with g as (select user_id, ts, case when ts >= lag(ts) over w + interval '6 hours' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
 s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select min(ts) as start, max(ts) + interval '6 hours' as end, user_id, count(*) as n from (select user_id, ts, k from s) group by user_id, k""")
def event_sessions(spark, d):
    return alerts.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")


@query("alert_rules", "select event_id, 'low_rate' as rule, 'warning' as severity from events where value < 10 union all select event_id, 'high_memory', 'warning' from events where value > 80 union all select event_id, 'memory_critical', 'critical' from events where value > 95")
def alert_rules(spark, d):
    x = table(spark, d, "events").select("event_id", F.col("value").alias("papers_per_minute"), F.col("value").alias("memory_percent"), F.lit(0.0).alias("cpu_percent"), F.lit(0).alias("errors"), F.lit(1).alias("processed"))
    return alerts.evaluate(x).select("event_id", "rule", "severity")


@query("alert_suppression", "with r as (select event_type, count(*) over (partition by event_type order by epoch(date_trunc('second', ts))::bigint range between 3600 preceding and current row) > 2 as s from events) select event_type, count(*) as evaluated, count(*) filter (s) as suppressed, round(count(*) filter (s) / count(*), 6) as rate from r group by 1")
def alert_suppression(spark, d):
    return rounded(alerts.effectiveness(alerts.suppressed(table(spark, d, "events"), "event_type", "ts", "event_id", 2, 3600), "event_type"))


@query("alert_cooldown", """with recursive f as (select event_type, min({'t': ts, 'e': event_id}) as x from events group by 1
 union all select f.event_type, min({'t': e.ts, 'e': e.event_id}) from f join events e on e.event_type = f.event_type and e.ts >= f.x.t + interval 86400 second group by f.event_type, f.x)
 select x.e as event_id, event_type, x.t as ts from f""")
def alert_cooldown(spark, d):
    return alerts.cooled_down(table(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], "ts", "event_id", 86400)


@query("api_health", """with x as (select event_id, event_type, (value >= 20)::int as ok, row_number() over w as n from events window w as (partition by event_type order by ts, event_id)),
 y as (select *, n - coalesce(max(case when ok = 1 then n end) over (partition by event_type order by n), 0) as trailing_errors, avg(ok) over (partition by event_type order by n rows between 49 preceding and current row) as success_rate from x)
 select event_id, trailing_errors, round(success_rate, 6) as success_rate, case when trailing_errors >= 10 then 'offline' when trailing_errors >= 5 or success_rate < .5 then 'critical' when trailing_errors >= 3 or success_rate < .8 then 'degraded' else 'healthy' end as health from y""")
def api_health(spark, d):
    x = alerts.health(table(spark, d, "events"), "event_type", "ts", "event_id", F.col("value") >= 20)
    return rounded(x.select("event_id", F.col("trailing_errors").cast("long").alias("trailing_errors"), "success_rate", "health"))
