"""Text and identifier functions: Column in, Column out, all inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as noise at the end of a title.
TITLE_NOISE = [r"\s*\(extended abstract\)", r"\s*\(short paper\)", r"\s*\(long paper\)", r"\s*\(poster\)", r"\s*\(demo\)",
               r"\s*\(supplementary material\)", r"\s*\(appendix\)", r"\s*-\s*supplementary.*", r"\s*:\s*supplementary.*"]
TITLE_NOISE_WIDE = [r"\s*\(extended abstract\)", r"\s*\(short paper\)", r"\s*\(long paper\)", r"\s*\(poster\)", r"\s*\(demo\)", r"\s*\(vision paper\)",
                    r"\s*\(position paper\)", r"\s*\(supplementary material\)", r"\s*\(appendix\)", r"\s*:\s*supplementary.*", r"\s*-\s*supplementary.*",
                    r"\s*\[.*\]$", r"\s*\(.*arxiv.*\)"]
# Prefixes of identifiers.
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "http://dx.doi.org/", "https://dx.doi.org/", "doi:", "DOI:"]
ARXIV_PREFIXES = ["https://arxiv.org/abs/", "http://arxiv.org/abs/", "https://arxiv.org/pdf/", "http://arxiv.org/pdf/", "arXiv:", "arxiv:"]
DOI, ARXIV_NEW, ARXIV_OLD = r"10\.\d{4,}/[^\s]+", r"\d{4}\.\d{4,5}", r"[a-zA-Z\-\.]+/\d{7}"
# Score at least -> grade.
GRADES = [(0.97, "A+"), (0.93, "A"), (0.90, "A-"), (0.87, "B+"), (0.83, "B"), (0.80, "B-"), (0.77, "C+"), (0.73, "C"), (0.70, "C-"), (0.67, "D+"), (0.63, "D"), (0.60, "D-")]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def present(c: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.length(stripped(c)) > 0, F.lit(False))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """White-space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without(c: Column, patterns: list[str], by: str = "") -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, by), patterns, c)


def title_key(title: Column) -> Column:
    """Lower case, no venue noise at the end, single spaces; punctuation stays."""
    return collapsed(without(stripped(F.lower(text_or_empty(title))), TITLE_NOISE))


def title_words(title: Column) -> Column:
    """As ``title_key`` with more kinds of noise, punctuation as spaces."""
    plain = without(stripped(F.lower(text_or_empty(title))), TITLE_NOISE_WIDE)
    return collapsed(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s\-:,]", " "), "[:,-]", " "))


def author_key(name: Column) -> Column:
    return collapsed(F.replace(F.lower(text_or_empty(name)), F.lit("."), F.lit(" ")))


def _unprefixed(c: Column, prefixes: list[str]) -> Column:
    """The first matching prefix goes, once."""
    out = c
    for p in reversed(prefixes):
        out = F.when(c.startswith(p), F.substr(c, F.lit(len(p) + 1))).otherwise(out)
    return out


def doi_key(doi: Column) -> Column:
    bare = stripped(_unprefixed(stripped(doi), DOI_PREFIXES))
    return F.when(bare.rlike("^" + DOI), bare)


def arxiv_key(arxiv: Column) -> Column:
    bare = _unprefixed(stripped(arxiv), ARXIV_PREFIXES)
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"v\d+$", "")
    return F.when(bare.rlike(f"^(?:{ARXIV_NEW}|{ARXIV_OLD})"), bare)


def ids_in_url(url: Column) -> Column:
    hit = lambda p: F.nullif(F.regexp_extract(url, p, 0), F.lit(""))
    return F.struct(hit(DOI).alias("doi"), F.coalesce(hit(ARXIV_NEW), hit(ARXIV_OLD)).alias("arxiv_id"))


def inverted_index(words: Column) -> Column:
    """map<word, positions> of an array of words, within the row: words sorted
    with their places, cut where the word changes. Each step is bound by a
    lambda, so that it is done once."""
    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        return F.transform(F.array(starts), lambda a: F.zip_with(a, F.slice(F.concat(a, F.array(F.size(s))), F.lit(2), F.size(a)), lambda i, j: F.struct(F.get(s, i)["w"].alias("w"), F.transform(F.slice(s, i + 1, j - i), lambda x: x["i"]).alias("at"))))

    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.map_from_entries(F.flatten(F.flatten(F.transform(F.filter(F.array(placed), lambda s: F.size(s) > 0), cut))))


def inverted_text(index: Column) -> Column:
    """map<word, positions> to the text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def content_hash(title: Column, authors: Column, venue: Column, year: Column) -> Column:
    """sha256 of title, sorted author names, venue and year, joined by |."""
    names = F.array_join(F.array_sort(F.coalesce(authors, F.array().cast("array<string>"))), "|")
    return F.sha2(F.concat_ws("|", text_or_empty(title), names, text_or_empty(venue), text_or_empty(year)), 256)


def title_year_hash(title: Column, year: Column) -> Column:
    return F.substring(F.md5(F.concat(title_key(title), F.lit("_"), text_or_empty(year)).cast("binary")), 1, 16)


def first_present(*cols: Column, bad=("unknown", "n/a")) -> Column:
    """The first value that isn't blank or a stand-in for nothing."""
    return F.coalesce(*[F.when(present(c) & ~F.lower(stripped(c)).isin(*bad), stripped(c)) for c in cols], F.lit(""))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def word_count(text: Column, words: list[str]) -> Column:
    """Whole-word occurrences of any of ``words``, without regard to case; ASCII
    letters, digits, the underscore and all beyond ASCII are parts of words."""
    inside = r"[\w\x{80}-\x{10FFFF}]"
    return F.regexp_count(text, F.lit(rf"(?i)(?<!{inside})(?:{'|'.join(words)})(?!{inside})")).cast("long")


def first_label(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule whose pattern is found."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules], F.lit(otherwise))


def most_hits(text: Column, keywords: dict[str, list[str]], otherwise: str) -> Column:
    """The label with most keywords in the text; the earlier one on ties."""
    hits = [F.struct(sum((text.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["label"]).otherwise(otherwise)


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, letter in GRADES[1:]:
        out = out.when(score >= least, letter)
    return out.otherwise("F")


# Names of organisations' kinds, and abbreviations in affiliations.
SHORT_FORMS = {"univ": "university", "inst": "institute", "dept": "department", "tech": "technology", "lab": "laboratory", "ctr": "center", "natl": "national"}


def affiliation_key(raw: Column) -> Column:
    """Lower case without e-mails, postal codes and street numbers, short forms written out."""
    out = F.regexp_replace(F.lower(text_or_empty(raw)), r"\S+@\S+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\b\d{5}(-\d{4})?\b", " "), r"\b\d+\s+(?=\w+\s+(?:st|street|ave|avenue|road|rd)\b)", " ")
    out = F.regexp_replace(out, r"[^a-z0-9À-ɏ\s]", " ")
    for short, long in SHORT_FORMS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return collapsed(out)


# Kinds of venue by the first keyword found.
VENUE_KINDS = [("workshop", r"workshop|\bws\b"), ("journal", r"journal|transactions|letters|review"), ("conference", r"conference|proceedings|symposium|meeting"), ("preprint", r"arxiv|preprint|biorxiv")]


def venue_kind(venue: Column) -> Column:
    return first_label(F.lower(text_or_empty(venue)), VENUE_KINDS, "other")


# Venue abbreviations and what they stand for.
VENUE_ABBREVIATIONS = {
    "NIPS": "Neural Information Processing Systems", "NEURIPS": "Neural Information Processing Systems", "IJCAI": "International Joint Conference on Artificial Intelligence",
    "AAAI": "Association for the Advancement of Artificial Intelligence", "SIGIR": "Special Interest Group on Information Retrieval", "SIGKDD": "Knowledge Discovery and Data Mining",
    "KDD": "Knowledge Discovery and Data Mining", "WWW": "World Wide Web Conference", "CHI": "Computer Human Interaction", "CSCW": "Computer Supported Cooperative Work",
    "UIST": "User Interface Software and Technology", "ICSE": "International Conference on Software Engineering", "FSE": "Foundations of Software Engineering",
    "OOPSLA": "Object-Oriented Programming Systems Languages and Applications", "PLDI": "Programming Language Design and Implementation", "POPL": "Principles of Programming Languages",
    "OSDI": "Operating Systems Design and Implementation", "SOSP": "Symposium on Operating Systems Principles", "NSDI": "Networked Systems Design and Implementation",
    "VLDB": "Very Large Data Base", "SIGMOD": "Special Interest Group on Management of Data", "ICDE": "International Conference on Data Engineering",
    "ML": "Machine Learning", "AI": "Artificial Intelligence", "CV": "Computer Vision", "NLP": "Natural Language Processing", "RL": "Reinforcement Learning", "DL": "Deep Learning",
    "CONF": "Conference", "SYMP": "Symposium", "WORKSHOP": "Workshop", "PROC": "Proceedings", "INTL": "International", "NATL": "National", "ASSOC": "Association", "COMP": "Computer",
    "SCI": "Science", "TECH": "Technology", "ENG": "Engineering", "MATH": "Mathematics", "STAT": "Statistics", "PHYS": "Physics"}
# What is noise in a venue's name, and its stop words.
VENUE_NOISE = [r"\s*\d{4}", r"\s*\'\d{2}", r"\s*\(.*\)", r"\s*-\s*\d{4}", r"\s*workshops?", r"\s*demos?", r"\s*tutorials?", r"\s*posters?", r"\s*extended\s*abstracts?", r"\s*short\s*papers?",
               r"\s*long\s*papers?", r"\s*volume\s*\d+", r"\s*vol\.\s*\d+", r"\s*proceedings\s*of\s*the", r"\s*conference\s*papers?", r"\s*main\s*track", r"\s*findings"]
VENUE_STOP_WORDS = ["THE", "OF", "ON", "IN", "FOR", "AND", "OR", "AT", "TO", "WITH", "BY", "PROCEEDINGS", "CONFERENCE", "JOURNAL", "TRANSACTIONS", "SYMPOSIUM", "WORKSHOP"]


def venue_key(venue: Column) -> Column:
    """Upper case without noise, abbreviations written out, stop words dropped;
    the first word stays first and the rest are sorted."""
    bare = without(F.upper(stripped(text_or_empty(venue))), [f"(?i){p}" for p in VENUE_NOISE])
    words = F.transform(F.split(collapsed(bare), " "), lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    known = F.create_map(*[x for short, long in VENUE_ABBREVIATIONS.items() for x in (F.lit(short), F.array(*map(F.lit, long.upper().split())))])
    words = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), F.array(w))))
    words = F.filter(words, lambda w: (w != "") & ~w.isin(*VENUE_STOP_WORDS))
    return F.array_join(F.concat(F.slice(words, 1, 1), F.array_sort(F.slice(words, 2, 10_000))), " ")


def abbreviation_match(one: Column, two: Column) -> Column:
    """Whether, by their keys, one venue holds an abbreviation that the other
    writes out."""
    known = F.array(*[F.struct(F.lit(short).alias("short"), F.lit(long.upper()).alias("long")) for short, long in VENUE_ABBREVIATIONS.items()])
    keys = F.array(F.struct(venue_key(one).alias("a"), venue_key(two).alias("b")))
    return F.exists(keys, lambda k: F.exists(known, lambda p: k["a"].contains(p["short"]) & k["b"].contains(p["long"]) | k["b"].contains(p["short"]) & k["a"].contains(p["long"])))


def loose_title(title: Column) -> Column:
    """For archives: no punctuation, no leading article, none of some last words."""
    plain = F.regexp_replace(collapsed(F.lower(text_or_empty(title))), r"(?U)[^\w\s]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^(the|a|an)\s+", ""), r"\s+(paper|study|analysis|approach|method)$", "")
