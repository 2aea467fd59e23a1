"""Queries over titles that match, authors, affiliations and what papers measure."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import affiliations as af
from scholia.functions import domain_metrics as dm
from scholia.functions import matching
from scholia.operators import joins, venues
from scholia.plans.base import papers, query, rounded, table

_quoted = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words: list[str], by):
    return F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))


# ---------------------------------------------------------------- titles

#: How a part's name is written a second time; {} is the name. All are equal or contained once cleaned.
TITLES = ["{}", "{} (Extended Abstract)", "{}: Supplementary material", "On {} and more", "{}!", "{} [v2]", "{} - a study", "({})"]
#: Whether a spelling cleans to the name itself.
_EXACT = [True, True, True, False, True, True, False, True]
#: Second author lists, and how they overlap with ['Ann Lee', 'Bob Ray', 'C. Day']; null: no factor.
AUTHORS = [(["Ann Lee", "Bob Ray", "C. Day"], 1.0), (["Lee, A."], 1 / 2), (["Zoe Lee", "Bob Ray"], 1 / 3), (["X Y"], 0.0), ([], None), (["Day, Carl", "Ray, Jr., Bob", "Lee"], 2 / 3), (["Bob Ray", "Bob Ray", "D Day", "Q Q"], 1 / 3), (["Jr"], None)]
_TITLES_SQL = f"""x as (select p_partkey as k, p_size, {_quoted(map(str, _EXACT))}[1 + p_partkey % {len(TITLES)}] = 'True' as same, [{', '.join('null' if s is None else repr(s) for _, s in AUTHORS)}][1 + (p_partkey // 3) % {len(AUTHORS)}] as o,
  case p_partkey % 7 when 0 then 0 when 1 then null else p_size % 4 end as gap, p_partkey % 50 = 49 as blank from part),
 y as (select *, case when same then 1.0 else .98 end * case when gap > 1 then .5 else 1 end * coalesce(.3 + .7 * o, 1) as s from x)"""


@query("title_matches", f"""with {_TITLES_SQL} select k as p_partkey, round(case when blank then 0 else s end, 6) as similarity,
 case when blank then 'no_match' when same and s >= 1 then 'exact' when s >= .95 then 'high_confidence' when s >= .85 then 'medium_confidence' when not same or s > .7 then 'low_confidence' else 'no_match' end as label, not blank and s >= .85 as accepted from y""")
def title_matches(spark, d):
    k = F.col("p_partkey")
    two = F.replace(_pick(TITLES, k), F.lit("{}"), F.col("p_name"))
    authors = F.get(F.array(*[F.array(*map(F.lit, a)).cast("array<string>") for a, _ in AUTHORS]), (F.floor(k / 3) % len(AUTHORS)).cast("int"))
    year = F.when(k % 7 == 0, 0).when(k % 7 != 1, 2000 + F.col("p_size") % 4)
    first = F.array(F.lit("Ann Lee"), F.lit("Bob Ray"), F.lit("C. Day"))
    pairs = table(spark, d, "part").select("p_partkey", F.when(k % 50 != 49, F.col("p_name")).alias("one"), two.alias("two"), F.lit(2000).alias("y1"), year.alias("y2"), first.alias("a1"), authors.alias("a2"))
    out = matching.with_title_match(pairs, "one", "two", "y1", "y2", "a1", "a2")
    return rounded(out.select("p_partkey", "similarity", "label", matching.at_least(F.col("label"), "medium_confidence").alias("accepted")))


# ---------------------------------------------------------------- affiliations

#: Affiliations of every kind; {} is a customer's segment.
AFFILIATIONS = ["Dept of Physics, {} University, Paris 75005", "Google Research", "{}", "Nvidia Corporation, Ltd.", "{} Labs, Oslo", "College of {}; School of Arts", "", "{} Company Limited, Univ of Rome", "research center for {}, Faculty of Law", "Institute of {} Technologies Inc."]
_AFF = f"a as (select c_custkey, replace({_quoted(AFFILIATIONS)}[1 + c_custkey % {len(AFFILIATIONS)}], '{{}}', c_mktsegment) as a from customer)"
KNOWN = (["Rome", "HOUSEHOLD"], ["Google", "Nvidia"])


def _affiliations(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.replace(_pick(AFFILIATIONS, F.col("c_custkey")), F.lit("{}"), F.col("c_mktsegment")).alias("a"))


_SHORT = "regexp_replace(lower(a), '[,;]+', ' ', 'g')"
for _k, _v in af.SHORT.items():
    _SHORT = f"regexp_replace({_SHORT}, '\\b{_k}\\b', '{_v}', 'g')"
_COUNT = lambda words: f"len(list_filter({_quoted(words)}, lambda w: contains(low, w)))"
_FIRST = lambda words: f"list_filter({_quoted(words)}, lambda w: contains(low, lower(w)))[1]"


@query("affiliation_types", f"""with {_AFF}, l as (select c_custkey, trim(regexp_replace(regexp_replace({_SHORT}, '\\b\\d{{4,5}}\\b', '', 'g'), '\\s+', ' ', 'g')) as low from a),
 n as (select c_custkey, {_COUNT(af.ACADEMIC_KEYWORDS)} as x, {_COUNT(af.INDUSTRY_KEYWORDS)} as y, {_FIRST(KNOWN[0])} as ka, {_FIRST(KNOWN[1])} as ki from l)
 select c_custkey, case when ka is not null then 'academic' when ki is not null then 'industry' when x > y then 'academic' when y > x then 'industry' else 'unknown' end as type,
 round(case when ka is not null or ki is not null then .95 when x = y then 0 else least(.8, greatest(x, y) / 3) end, 6) as confidence, coalesce(ka, ki) as organisation from n""")
def affiliation_types(spark, d):
    return rounded(_affiliations(spark, d).select("c_custkey", af.affiliation_class(F.col("a"), *KNOWN).alias("t")).select("c_custkey", "t.*"))


#: Affiliations of authors, again with each rule's hits and misses.
WORKPLACES = AFFILIATIONS + ["{} Research Group", "Graduate School, {} Research Institute", "{} Software Solutions GmbH", "Research, University of {}", "Research Labs {} Corporation", "Department of {}", "{} Systems, Engineering", "PhD student", "{} Academy Inc", "postdoc at {} Services"]
_WORK = f"a as (select c_custkey, replace({_quoted(WORKPLACES)}[1 + c_custkey % {len(WORKPLACES)}], '{{}}', c_mktsegment) as a from customer)"
_RE = lambda patterns: "2 * (" + " + ".join(f"regexp_matches(low, '{p}')::int" for p in patterns) + ")"
_IN = lambda words: f"len(list_intersect(string_split_regex(low, '\\s+'), {_quoted(words)}))"
_HAS = lambda words: f"len(list_filter({_quoted(words)}, lambda w: contains(low, w))) > 0"


@query("author_types", f"""with {_WORK}, l as (select c_custkey, lower(a) as low from a),
 n as (select *, {_HAS(af.ACADEMIC_NAMES)} as ka, {_HAS(af.INDUSTRY_NAMES)} as ki, contains(low, 'research') and {_HAS(af.RESEARCH['academic'])} as ra, contains(low, 'research') and {_HAS(af.RESEARCH['industry'])} as ri, regexp_matches(low, '{af.FORM}') as form,
  {_RE(af.ACADEMIC_PATTERNS)} + {_IN(af.ACADEMIC_WORDS)} as x, {_RE(af.INDUSTRY_PATTERNS)} + {_IN(af.INDUSTRY_WORDS)} as y, {_RE(af.STRONG['academic'])} > 0 as sa, {_RE(af.STRONG['industry'])} > 0 as si from l),
 s as (select *, x + case when ra then 3 else 0 end as p, y + case when ri and not ra then 3 else 0 end as q from n),
 t as (select *, case when low = '' then 'unknown' when ka then 'academic' when ki then 'industry' when p > q and p >= 3 then 'academic' when q > p and q >= 3 then 'industry' when p = q and p > 0 then case when form then 'industry' else 'academic' end else 'unknown' end as type from s)
 select c_custkey, type, case when low = '' or type = 'unknown' then 0 when type = 'academic' then case when ka then .95 when sa then .8 else .6 end else case when ki then .95 when si then .8 else .6 end end::double as confidence from t""")
def author_types(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.replace(_pick(WORKPLACES, F.col("c_custkey")), F.lit("{}"), F.col("c_mktsegment")).alias("a"))
    x = x.withColumn("type", af.author_type(F.col("a")))
    return x.select("c_custkey", "type", af.author_confidence(F.col("a"), F.col("type")).alias("confidence"))


_TYPE = "case source when '1-URGENT' then 'industry' when '5-LOW' then 'unknown' when '2-HIGH' then 'unknown' else 'academic' end"


@query("authorship_categories", f"""with {{papers}}, c as (select author_id, year, count(*) as n, count(*) filter ({_TYPE} = 'unknown') as u, count(*) filter ({_TYPE} = 'industry') as i, count(*) filter ({_TYPE} = 'academic') as a from papers group by 1, 2),
 s as (select *, case when u >= .5 * n then 'needs_manual_review' when i > 0 then 'industry_eligible' when a >= .6 * n then 'academic_eligible' else 'needs_manual_review' end as category,
  (.5 * (a + i) / n + .5 * (a * .8 + i * .95) / n) * case when a > 0 and i > 0 then .9 else 1 end as confidence from c)
 select category, count(*) as n, round(avg(confidence), 6) as confidence from s group by 1""")
def authorship_categories(spark, d):
    kind = F.when(F.col("source") == "1-URGENT", "industry").when(F.col("source").isin("5-LOW", "2-HIGH"), "unknown").otherwise("academic")
    sure = F.when(kind == "industry", 0.95).when(kind == "academic", 0.8).otherwise(0.0)
    x = papers(spark, d).groupBy("author_id", "year").agg(F.collect_list(kind).alias("t"), F.collect_list(sure).alias("s"))
    x = x.select(af.authorship_category(F.col("t")).alias("category"), af.authorship_confidence(F.col("t"), F.col("s")).alias("c"))
    return rounded(x.groupBy("category").agg(F.count("*").alias("n"), F.avg("c").alias("confidence")))


@query("extraction_checks", """with x as (select o_orderkey as k, (o_orderkey % 10) / 10 as c, o_orderkey % 4 as n, case when o_orderkey % 6 = 5 then 2 else 3 + o_orderkey % 3 end as w, length(o_orderpriority || ' by ' || o_orderstatus) as len, o_orderkey % 5 as g from orders)
 select k as o_orderkey, c >= .5 as confidence, n >= 1 as count, len >= 12 as length, n = 0 or w >= 3 as structure, g <> 2 as author, c >= .5 and n >= 1 and len >= 12 and w >= 3 as valid from x""")
def extraction_checks(spark, d):
    k = F.col("o_orderkey")
    width = F.when(k % 6 == 5, 2).otherwise((3 + k % 3).cast("int"))
    names = F.when(k % 4 > 0, F.array_repeat(F.repeat(F.lit("x"), width), (k % 4).cast("int"))).otherwise(F.array().cast("array<string>"))
    # 0: whole name, 1: a last name, 2: neither, 3: no authors, 4: a null beside a hit
    status = F.concat(F.lit("BY "), F.col("o_orderstatus"))
    authors = F.when(k % 5 == 0, F.array(F.lit("No One"), status)).when(k % 5 == 1, F.array(F.concat(F.lit("Ann "), F.col("o_orderstatus")))).when(k % 5 == 2, F.array(F.lit("Zoe Quux"), F.lit("quuxquux"))).when(k % 5 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit(None), status))
    checks = af.extraction_checks((k % 10) / 10, names, F.concat("o_orderpriority", F.lit(" by "), "o_orderstatus"), authors, (0.5, 1, 12))
    return table(spark, d, "orders").select("o_orderkey", checks.alias("c")).select("o_orderkey", "c.*")


#: (affiliation, what it is taken apart into: organisation, department, city, state, country, domain, confidence, leading organisation); {} is a segment in capitals, <> the same with one capital.
PARSED = [
    ("Department of CS, {} University, Palo Alto, CA, USA", ("{} University", "Computer Science", "Palo Alto", "CA", "USA", None, 1.0, "{} University")),
    ("{} Institute for AI and ML, Zürich, Switzerland ann@cs.example.org", ("{} Institute for artificial intelligence and machine learning", "Artificial Intelligence And Machine Learning", "Zürich", None, "Switzerland", "cs.example.org", 1.0, "{} Institute for artificial intelligence")),
    ("MIT, Cambridge, MA", ("MIT", None, "Cambridge", "MA", None, None, 1.0, "MIT")),
    ("EE Department, UC {}, Berkeley", ("UC {}", "Electrical Engineering", "Berkeley", None, None, None, 1.0, "UC {}")),
    ("The {} Company; Second University, Rome", ("{} Company", None, "Rome", None, None, None, 1.0, "{} Company")),
    ("School of Math (University of {}), 12345", ("University of {}", "Mathematics", None, None, None, None, 1.0, "University of {}")),
    ("   ", (None, None, None, None, None, None, 0.0, None)),
    ("{} research lab, unknown city", ("{} research lab", "<> Research", "unknown city", None, None, None, 0.56, "{} research lab")),
    ("dept", ("department", None, None, None, None, None, 0.72, "department")),
    ("{} Foundation & Acme Corporation / Lyon / France", ("{} Foundation & Acme Corporation", None, "Lyon", None, "France", None, 1.0, "{} Foundation")),
]
_FIELDS = ["organisation", "department", "city", "state", "country", "email_domain"]
_SEGMENT = lambda text: "replace(replace(" + ("null" if text is None else "'" + text + "'") + ", '{}', c_mktsegment), '<>', c_mktsegment[1] || lower(c_mktsegment[2:]))"
_CASE = lambda values: "case c_custkey % " + str(len(PARSED)) + " " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


@query("parsed_affiliations", "select c_custkey, " + ", ".join(f"{_CASE(_SEGMENT(x[1][i]) for x in PARSED)} as {f}" for i, f in enumerate(_FIELDS)) + f", {_CASE(x[1][6] for x in PARSED)} as confidence, {_CASE(_SEGMENT(x[1][7]) for x in PARSED)} as leading from customer")
def parsed_affiliations(spark, d):
    text = F.replace(_pick([t for t, _ in PARSED], F.col("c_custkey")), F.lit("{}"), F.col("c_mktsegment"))
    x = joins.by_text(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), text, p=af.parsed_affiliation, leading=af.leading_organisation)
    return rounded(x.select("c_custkey", "p.*", "leading"))


# ---------------------------------------------------------------- organisations

ORGS = [
    (0, "Furniture Guild", "industry", ["furn works", "shared"], ["furn.org", "both.net"], ["wood", "chair"]),
    (1, "State Building Office", "government", ["sbo", "shared"], ["sbo.gov", "both.net"], ["office"]),
    (2, "Machine Works", "industry", [], ["mach.com"], ["mach", "gear"]),
    (3, "House College", "academic", ["hc"], ["house.edu"], ["college", "wood"]),
]
#: (affiliation, organisation, type, way, confidence)
RECOGNISED = [
    ("Dept of Gears, MACHINE WORKS, Oslo", "Machine Works", "industry", "exact", 0.95), ("someone <a@house.edu> of shared things", "House College", "academic", "domain", 0.85), ("see both.net", "State Building Office", "government", "domain", 0.85),
    ("the shared hall", "State Building Office", "government", "alias", 0.9), ("x@nowhere.org at SBO", "State Building Office", "government", "alias", 0.9), ("x@nowhere.org, formerly mach.com or SBO", "Machine Works", "industry", "domain", 0.85),
    ("Furnitur Gild", "Furniture Guild", "industry", "fuzzy", 0.7 + 0.15 * (200 * 13 / 28 - 80) / 20), ("State Bilding Offices", "State Building Office", "government", "fuzzy", 0.7 + 0.15 * (200 * 20 / 42 - 80) / 20), ("wood and chair and gear", None, "industry", "keyword", 0.6), ("a college of wood", None, "academic", "keyword", 0.4),
    ("nothing at all", None, "unknown", "none", 0.0), ("", None, "unknown", "none", 0.0), ("Furniture Guild of House College", "Furniture Guild", "industry", "exact", 0.95),
]
_ORG = lambda i: f"case c_custkey % {len(RECOGNISED)} " + " ".join(f"when {k} then " + ("null" if x[i] is None else repr(x[i])) for k, x in enumerate(RECOGNISED)) + " end"


@query("organisation_cascade", f"select c_custkey, {_ORG(1)} as org, {_ORG(2)} as org_type, {_ORG(3)} as org_by, round({_ORG(4)}, 6) as org_confidence from customer")
def organisation_cascade(spark, d):
    dim = spark.createDataFrame(ORGS, "ordinal int, name string, type string, aliases array<string>, domains array<string>, keywords array<string>")
    x = table(spark, d, "customer").withColumn("affiliation", _pick([t for t, *_ in RECOGNISED], F.col("c_custkey")))
    return rounded(venues.organisations(x, F.col("affiliation"), dim).select("c_custkey", "org", "org_type", "org_by", "org_confidence"))


# ---------------------------------------------------------------- what papers measure

LANGUAGE = ["Pre-training on {}.5 billion tokens; vocabulary size of 32,000; sequence length set to {}. GLUE", "{}M tokens, {},000 wordpieces, context window of {}; fine-tuned BERT, evaluated on SQuAD and BERT", "trained on {} words of CommonCrawl", "BERT and GPT are models", "a vocab of {},{}; {}K words"]
VISION = ["{}x1{} with augmentation at {} images per second on ImageNet", "{}x1{} pixels, {} fps, multi-scale, CIFAR10 and CIFAR-100", "1080p frames, throughput of {}", "nothing of COCO but a multiscale MixUp"]
CONTROL = ["{}M environment steps, {} parallel workers, simulation time: {}.5 days, replay buffer size: {}K transitions on Atari", "trained for {}B episodes over {} gpu days in MuJoCo; {}B transitions", "we go to the gym", "dmc", "{} days of training with {}K frames"]
_Q = "l_quantity::int"


def _by_line(n: int, values: list) -> str:
    return "case l_linenumber % " + str(n) + " " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _measured(spark, d, texts: list[str]):
    t = F.replace(_pick(texts, F.col("l_linenumber")), F.lit("{}"), F.col("l_quantity").cast("int").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))


_TOKENS = [f"({_Q} * 1e9 + 5e8)", f"{_Q} * 1e6", _Q, "null", f"{_Q} * 1e3"]


@query("domain_metrics", f"""select l_orderkey, l_linenumber, ({_by_line(5, _TOKENS)})::bigint as tokens, ({_by_line(5, ['32000', f'{_Q} * 1000', 'null', 'null', f"({_Q}::varchar || {_Q}::varchar)::bigint"])})::bigint as vocabulary,
 ({_by_line(5, [_Q, _Q, 'null', 'null', 'null'])})::bigint as sequence, l_linenumber % 5 = 0 as pre_training, l_linenumber % 5 = 1 as fine_tuning, floor(({_by_line(5, _TOKENS)}) * .75)::bigint as words,
 {_by_line(5, ["'GLUE'", "'BERT,SQuAD'", "'CommonCrawl'", "''", "''"])} as benchmarks from lineitem""")
def domain_metrics(spark, d):
    x = _measured(spark, d, LANGUAGE)
    return x.select("l_orderkey", "l_linenumber", dm.language_metrics(F.col("t")).alias("m"), F.array_join(dm.language_benchmarks(F.col("t")), ",").alias("benchmarks")).select("l_orderkey", "l_linenumber", "m.*", "benchmarks")


_H = f"('1' || {_Q})::bigint"


@query("vision_metrics", f"""with x as (select l_orderkey, l_linenumber, ({_by_line(4, [_Q, f'floor({_Q} * 16 / 9)', '1920', 'null'])})::bigint as width, ({_by_line(4, [_H, _Q, '1080', 'null'])})::bigint as height, ({_by_line(4, [_Q, _Q, _Q, 'null'])})::double as fps,
 l_linenumber % 4 in (0, 3) as augmentation, l_linenumber % 4 in (1, 3) as multi_scale, {_by_line(4, ["'ImageNet'", "'CIFAR-10,CIFAR-100'", "''", "'COCO'"])} as benchmarks from lineitem)
 select *, round(least(3.0, coalesce(width * height / 50176, 1) * case when multi_scale then 1.5 else 1 end * case when augmentation then 1.2 else 1 end), 6) as overhead from x""")
def vision_metrics(spark, d):
    x = _measured(spark, d, VISION)
    return rounded(x.select("l_orderkey", "l_linenumber", dm.vision_metrics(F.col("t")).alias("m"), F.array_join(dm.vision_benchmarks(F.col("t")), ",").alias("benchmarks")).select("l_orderkey", "l_linenumber", "m.*", "benchmarks"))


@query("control_metrics", f"""select l_orderkey, l_linenumber, ({_by_line(5, [f'{_Q} * 1e6', f'{_Q} * 1e9', 'null', 'null', f'{_Q} * 1e3'])})::bigint as steps, ({_by_line(5, [f'{_Q} + .5', _Q, 'null', 'null', _Q])})::double as days,
 ({_by_line(5, [_Q, 'null', 'null', 'null', 'null'])})::bigint as environments, ({_by_line(5, [f'{_Q} * 1000', _Q, 'null', 'null', 'null'])})::bigint as replay, round(({_by_line(5, [f'({_Q} + .5) * 24 * {_Q}', f'{_Q} * 24', '0', '0', f'{_Q} * 24'])})::double, 6) as hours,
 {_by_line(5, ["'Atari'", "'MuJoCo'", "'Go,Gym,OpenAI Gym'", "'DMC,DeepMind Control'", "''"])} as benchmarks from lineitem""")
def control_metrics(spark, d):
    x = _measured(spark, d, CONTROL)
    return rounded(x.select("l_orderkey", "l_linenumber", dm.control_metrics(F.col("t")).alias("m"), F.array_join(dm.control_benchmarks(F.col("t")), ",").alias("benchmarks")).select("l_orderkey", "l_linenumber", "m.*", "benchmarks"))
