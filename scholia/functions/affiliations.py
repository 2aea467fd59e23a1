"""Affiliations: which authors are academic, which work in industry, and
whether an extraction of affiliations is to be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import collapsed, text_or_empty

# Patterns and words of academic affiliations, and institutions by name.
ACADEMIC_PATTERNS = [r"\buniversit", r"\bcolleg", r"\binstitut", r"\bacadem", r"\bschool\s+of", r"\bdepartment\s+of", r"\bfacult", r"\bcentre\s+for", r"\bcenter\s+for", r"\bresearch\s+(?:center|centre|institute)",
                     r"\bgraduate\s+school", r"\bpostdoc", r"\bph\.?d", r"\bdoctoral", r"\bpost-doc"]
ACADEMIC_WORDS = ["university", "college", "institute", "academia", "school", "department", "faculty", "laboratory", "lab", "research", "professor", "student", "postdoc", "doctoral", "graduate"]
ACADEMIC_NAMES = ["mit", "stanford", "berkeley", "cmu", "caltech", "harvard", "princeton", "yale", "columbia", "cornell", "upenn", "nyu", "ucla", "usc", "umich", "uiuc", "georgia tech", "ut austin", "uw", "ucsd", "umd", "wisc",
                  "purdue", "brown", "rice", "duke", "unc", "virginia", "washington", "oxford", "cambridge", "eth", "epfl", "imperial", "ucl", "edinburgh", "toronto", "waterloo", "mcgill", "ubc", "melbourne", "sydney", "anu",
                  "tsinghua", "peking", "tokyo", "kyoto", "seoul national", "kaist", "iit", "iisc", "technion", "tel aviv", "max planck", "inria", "cnrs", "ens", "polytechnique", "sorbonne"]
# The same of industry.
INDUSTRY_PATTERNS = [r"\b(?:inc|corp|ltd|llc|gmbh|ag|sa|plc)\b", r"\blabs?\b", r"\bresearch\s+(?:division|group|team)", r"\btechnolog", r"\bsoftware", r"\bengineering", r"\bsolutions", r"\bsystems", r"\bproducts", r"\bservices"]
INDUSTRY_WORDS = ["corporation", "company", "incorporated", "limited", "labs", "laboratory", "technologies", "software", "hardware", "solutions", "products", "services", "engineering", "development", "r&d"]
INDUSTRY_NAMES = ["google", "microsoft", "facebook", "meta", "apple", "amazon", "ibm", "intel", "nvidia", "amd", "qualcomm", "broadcom", "cisco", "oracle", "sap", "salesforce", "adobe", "vmware", "twitter", "netflix", "uber",
                  "airbnb", "lyft", "spotify", "deepmind", "openai", "anthropic", "cohere", "hugging face", "tesla", "spacex", "boston dynamics", "waymo", "cruise", "baidu", "alibaba", "tencent", "bytedance", "huawei", "samsung",
                  "lg", "sony", "panasonic", "toshiba", "fujitsu", "siemens", "bosch", "philips", "ericsson", "nokia", "accenture", "deloitte", "pwc", "ey", "kpmg", "mckinsey"]
# Strong signs of either, a company's form, and what "research" goes with.
STRONG = {"academic": [r"\buniversit", r"\bcolleg", r"\binstitut"], "industry": [r"\b(?:inc|corp|ltd|llc)\b", r"\blabs\b"]}
FORM = r"\b(?:inc|corp|ltd|llc)\b"
RESEARCH = {"academic": ["university", "institute", "college"], "industry": ["labs", "corporation", "company"]}
PATTERN, RESEARCH_BONUS, LEAST = 2, 3, 3


def _any(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _score(low: Column, patterns: list[str], words: list[str]) -> Column:
    hits = sum((F.when(low.rlike(p), PATTERN).otherwise(0) for p in patterns), F.lit(0))
    return hits + F.size(F.array_intersect(F.split(low, r"\s+"), F.array(*map(F.lit, words))))


def author_type(affiliation: Column) -> Column:
    """academic, industry or unknown, from an author's first affiliation:
    institutions by name (academic ones first), else by score. A pattern counts
    2, a word 1, "research" 3 for the side that it goes with; the higher side
    needs 3; equal scores are industry if a company's form is there."""
    low = F.lower(text_or_empty(affiliation))
    research = low.contains("research")
    side = F.when(research & _any(low, RESEARCH["academic"]), "academic").when(research & _any(low, RESEARCH["industry"]), "industry")
    a = _score(low, ACADEMIC_PATTERNS, ACADEMIC_WORDS) + F.when(side == "academic", RESEARCH_BONUS).otherwise(0)
    i = _score(low, INDUSTRY_PATTERNS, INDUSTRY_WORDS) + F.when(side == "industry", RESEARCH_BONUS).otherwise(0)
    scored = F.when((a > i) & (a >= LEAST), "academic").when((i > a) & (i >= LEAST), "industry").when((a == i) & (a > 0), F.when(low.rlike(FORM), "industry").otherwise("academic")).otherwise("unknown")
    return F.when(low == "", "unknown").when(_any(low, ACADEMIC_NAMES), "academic").when(_any(low, INDUSTRY_NAMES), "industry").otherwise(scored)


def author_confidence(affiliation: Column, kind: Column) -> Column:
    """How sure ``author_type``'s answer is: .95 by name, .8 by a strong sign,
    else .6; 0 for unknown."""
    low = F.lower(text_or_empty(affiliation))
    out = F.lit(0.0)
    for name, names in (("academic", ACADEMIC_NAMES), ("industry", INDUSTRY_NAMES)):
        strong = reduce(lambda a, b: a | b, [low.rlike(p) for p in STRONG[name]])
        out = F.when(kind == name, F.when(_any(low, names), 0.95).when(strong, 0.8).otherwise(0.6)).otherwise(out)
    return F.when(low == "", 0.0).otherwise(out)


def authorship_category(types: Column) -> Column:
    """Of a paper's author types: half of them unknown, or none at all, needs
    review; then any industry; then 60 percent academic; the rest needs review."""
    n = F.size(types)
    count = lambda t: F.size(F.filter(types, lambda x: x == t))
    return F.when((n <= 0) | (count("unknown") >= 0.5 * n), "needs_manual_review").when(count("industry") > 0, "industry_eligible").when(count("academic") >= 0.6 * n, "academic_eligible").otherwise("needs_manual_review")


def authorship_confidence(types: Column, sure: Column) -> Column:
    """Half the share of known types, half the mean of their confidences; .9 of
    that for papers with both sides. 0 without authors."""
    n = F.size(types)
    count = lambda t: F.size(F.filter(types, lambda x: x == t))
    known = (count("academic") + count("industry")) / F.nullif(n, F.lit(0))
    mean = F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(sure), F.lit(0))
    mixed = F.when((count("academic") > 0) & (count("industry") > 0), 0.9).otherwise(1.0)
    return F.when(n <= 0, 0.0).otherwise((0.5 * known + 0.5 * F.coalesce(mean, known)) * mixed)


# What an extraction of affiliations must have at least.
MIN_CONFIDENCE, MIN_AFFILIATIONS, MIN_TEXT, MIN_NAME = 0.5, 1, 20, 3


def extraction_checks(confidence: Column, names: Column, text: Column, authors: Column | None = None, least: tuple[float, int, int] = (MIN_CONFIDENCE, MIN_AFFILIATIONS, MIN_TEXT)) -> Column:
    """struct of the checks on an extraction (names of affiliations, text) and
    whether it is valid: confidence, count and length reach ``least``, and every
    affiliation has a name of three characters. Whether an author's name, or a
    last name, is found in the text is told but doesn't decide; without authors
    it is true."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    body = F.lower(text_or_empty(text))
    sure, many, long = F.coalesce(confidence, F.lit(0.0)) >= least[0], F.size(names) >= least[1], F.length(body) >= least[2]
    formed = F.forall(names, lambda x: F.coalesce(F.length(x) >= MIN_NAME, F.lit(False)))
    found = F.lit(True)
    if authors is not None:
        known = F.filter(authors, lambda x: x.isNotNull())
        last = lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1)
        hit = F.exists(known, lambda x: F.contains(body, F.lower(x)) | (x.contains(" ") & F.contains(body, F.lower(last(x)))))
        found = (F.coalesce(F.size(known), F.lit(0)) <= 0) | F.coalesce(hit, F.lit(False))
    return F.struct(sure.alias("confidence"), many.alias("count"), long.alias("length"), formed.alias("structure"), found.alias("author"), (sure & many & long & formed).alias("valid"))


# ---------------------------------------------------------------- classes by known organisations and keywords

# Keywords of either side, short forms of affiliations, and how sure an answer can be.
ACADEMIC_KEYWORDS = ["university", "institut", "college", "school", "research center", "laboratory", "department of", "faculty of", "dept", "lab", "center for", "centre for"]
INDUSTRY_KEYWORDS = ["corporation", "inc.", "ltd.", "llc", "labs", "research lab", "ai lab", "technologies", "corp", "company", "limited", "incorporated"]
SHORT = {"univ": "university", "inst": "institute", "tech": "technology", "sci": "science", "comp": "computer", "eng": "engineering", "dept": "department"}
KNOWN_SURE, KEYWORD_SURE, KEYWORDS_FULL = 0.95, 0.8, 3


def plain_affiliation(raw: Column) -> Column:
    """Lower case, commas and semicolons as spaces, short forms written out,
    without e-mails, numbers of four or five digits, and ordinals of streets."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(raw)), "[,;]+", " "), r"\s+", " ")
    for short, long in SHORT.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    for pattern in (r"\S+@\S+", r"\b\d{4,5}\b", r"\b\d+\s+(st|nd|rd|th)\b"):
        out = F.regexp_replace(out, pattern, "")
    return collapsed(out)


def affiliation_class(affiliation: Column, academic: list[str] = (), industry: list[str] = ()) -> Column:
    """struct<type, confidence, organisation>. Organisations known by name come
    first (academic ones before industry, in order: .95); else keywords: the
    side with more hits, a third of their number, .8 at most; equal numbers are
    unknown, 0."""
    low = plain_affiliation(affiliation)
    named = [F.when(low.contains(name.lower()), F.struct(F.lit(kind).alias("type"), F.lit(KNOWN_SURE).alias("confidence"), F.lit(name).alias("organisation"))) for kind, names in (("academic", academic), ("industry", industry)) for name in names]
    hits = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    a, i = hits(ACADEMIC_KEYWORDS), hits(INDUSTRY_KEYWORDS)
    kind = F.when(a > i, "academic").when(i > a, "industry").otherwise("unknown")
    sure = F.when(a == i, 0.0).otherwise(F.least(F.lit(KEYWORD_SURE), F.greatest(a, i) / KEYWORDS_FULL))
    return F.coalesce(*named, F.struct(kind.alias("type"), sure.alias("confidence"), F.lit(None).cast("string").alias("organisation")))


# ---------------------------------------------------------------- parts of an affiliation

# Further short forms, and the words and names that tell the parts of an affiliation apart.
MORE_SHORT = {"cs": "computer science", "ai": "artificial intelligence", "ml": "machine learning", "ee": "electrical engineering", "ece": "electrical and computer engineering", "math": "mathematics", "phys": "physics",
              "bio": "biology", "chem": "chemistry", "med": "medicine"}
UNITS = r"(?:department|dept\.?|school|faculty|institute|center|centre|laboratory|lab)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"
COUNTRIES = {"USA": "USA", "UK": "UK", "CA": "CA", "CANADA": "Canada", "FRANCE": "France", "GERMANY": "Germany", "CHINA": "China", "JAPAN": "Japan", "SWITZERLAND": "Switzerland"}
NOT_PLACES = ["university", "institute", "college", "department", "dept", "school"]
ORGANISATION_WORDS = ["university", "institute", "college", "corporation", "company", "research", "laboratory", "foundation", "academy"]
IN_PARENTHESES = ["university", "institute", "research"]
UNIVERSITIES = ["MIT", "UCLA", "UCB", "NYU", "CMU", "UIUC", "USC", "UCSD"]
VAGUE = ["unknown", "research lab", "laboratory"]
PLACE_LENGTH, SHORT_LENGTH = 30, 10


def _spelled_out(text: Column) -> Column:
    out = text
    for short, long in (SHORT | MORE_SHORT).items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", long)
    # one look spares the replacements where there is no short form
    return F.when(text.rlike(rf"(?i)\b(?:{'|'.join(SHORT | MORE_SHORT)})\b"), out).otherwise(text)


def clean_organisation(name: Column) -> Column:
    """Without a leading "the", "at" or "from" and marks at the ends, short
    forms written out."""
    out = _spelled_out(F.regexp_replace(collapsed(name), r"(?i)^(?:the|at|from)(?:\s+|$)", ""))
    return F.regexp_replace(collapsed(out), r"^[,\-\s]+|[,\-\s]+$", "")


def parsed_affiliation(affiliation: Column) -> Column:
    """struct<organisation, department, city, state, country, email_domain,
    confidence>: a fold over the parts between commas, semicolons and slashes.

    E-mails and parentheses are taken out first. A department is the first part
    that names a unit (of or for something, or something before it). Two capital
    letters are a state. From the second part on, a short part without a unit's
    or school's word is a country if it is one of COUNTRIES, or else the city,
    once there is an organisation. The organisation is the first part with "UC"
    and a word, with an organisation's word, or one of UNIVERSITIES; or the
    first part of all if it is no department; or one in parentheses. Nothing,
    with confidence 0, for null and blank text."""
    text = F.coalesce(affiliation, F.lit(""))
    domain = F.nullif(F.regexp_extract(text, EMAIL, 1), F.lit(""))
    text = F.regexp_replace(text, EMAIL, "")
    inside = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), 1)
    bare = F.regexp_replace(text, r"\([^)]+\)", "")
    parts = F.filter(F.transform(F.split(bare, "[,;/]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("i"), none.alias("organisation"), none.alias("department"), none.alias("city"), none.alias("state"), none.alias("country"))
    country_of = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])

    def step(s: Column, part: Column) -> Column:
        low = F.lower(part)
        unit = [F.nullif(F.regexp_extract(part, rf"(?iU){p}", 1), F.lit("")) for p in (rf"{UNITS}\s+(?:of|for)\s+(\w+(?:\s+\w+)*)", rf"(\w+(?:\s+\w+)*)\s+{UNITS}")]
        department = F.coalesce(s["department"], F.initcap(_spelled_out(F.coalesce(*unit))))
        is_state = (F.length(part) == 2) & (part == F.upper(part)) & (part != low) & s["state"].isNull()
        state = F.when(is_state, part).otherwise(s["state"])
        place = ~is_state & (s["i"] >= 1) & (F.length(part) <= PLACE_LENGTH) & ~_any(low, NOT_PLACES)
        land = country_of[F.upper(part)]
        country = F.when(place & land.isNotNull(), land).otherwise(s["country"])
        in_city = place & land.isNull() & s["organisation"].isNotNull() & ~part.eqNullSafe(s["state"]) & s["city"].isNull()
        city = F.when(in_city, part).otherwise(s["city"])
        branch = F.regexp_extract(part, r"(?U)UC\s+(\w+)", 1)
        named = F.when(branch != "", F.concat(F.lit("UC "), branch)).when(_any(low, ORGANISATION_WORDS), clean_organisation(part)).when(F.upper(part).isin(UNIVERSITIES), F.upper(part)).when((s["i"] == 0) & department.isNull(), clean_organisation(part))
        organisation = F.when(s["organisation"].isNull() & ~is_state & (F.length(part) > 2), named).otherwise(s["organisation"])
        return F.struct((s["i"] + 1).alias("i"), organisation.alias("organisation"), department.alias("department"), city.alias("city"), state.alias("state"), country.alias("country"))

    aside = F.get(F.filter(inside, lambda c: _any(F.lower(c), IN_PARENTHESES)), F.lit(0))

    def finish(s: Column) -> Column:
        organisation = F.coalesce(F.nullif(s["organisation"], F.lit("")), clean_organisation(aside))
        low, rest = F.lower(organisation), F.lower(bare)
        has = organisation.isNotNull() & (organisation != "")
        sure = F.when(~F.coalesce(has, F.lit(False)), 0.3).when(low.contains("unknown") & low.contains("affiliation"), 0.3).when(_any(low, VAGUE), 0.7).otherwise(1.0)
        sure = sure * F.when(s["department"].isNull() & _any(rest, ["dept", "department"]), 0.8).otherwise(1.0) * F.when(domain.isNotNull() & organisation.isNull(), 0.7).otherwise(1.0)
        sure = sure * F.when(F.lower(s["city"]).contains("unknown"), 0.8).otherwise(1.0)
        trimmed = F.length(F.regexp_replace(bare, r"^\s+|\s+$", ""))
        sure = sure * F.when((F.length(bare) > 0) & (trimmed < SHORT_LENGTH), 0.9).otherwise(1.0)
        blank = F.regexp_replace(F.coalesce(affiliation, F.lit("")), r"\s", "") == ""
        return F.struct(organisation.alias("organisation"), s["department"].alias("department"), s["city"].alias("city"), s["state"].alias("state"), s["country"].alias("country"), domain.alias("email_domain"), F.when(blank, 0.0).otherwise(sure).alias("confidence"))

    return F.aggregate(parts, start, step, finish)


def leading_organisation(affiliation: Column) -> Column:
    """The organisation of an affiliation that may hold several: of the first
    before a semicolon, else of the first before "and" or "&". Text beyond ASCII
    from which none can be parsed is its own, cleaned."""
    text = F.coalesce(affiliation, F.lit(""))
    many = text.contains(";")
    joined = ~many & (F.lower(text).contains(" and ") | text.contains(" & "))
    first = F.when(many, F.get(F.split(text, ";"), F.lit(0))).when(joined, F.get(F.split(text, r"(?i)\s+(?:and|&)\s+"), F.lit(0))).otherwise(text)
    kept = F.when(~many & ~joined & text.rlike(r"[^\x00-\x7F]"), clean_organisation(text))
    return F.when(text != "", F.coalesce(parsed_affiliation(first)["organisation"], kept))
