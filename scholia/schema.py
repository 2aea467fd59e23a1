"""The paper model: explicit types, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AUTHOR = "struct<name:string,affiliations:array<string>,email:string>"


def _provenance(data: str) -> str:
    return f"array<struct<source:string,timestamp:timestamp_ntz,original:boolean,data:struct<{data}>>>"


PAPER_DDL = f"""paper_id string, openalex_id string, arxiv_id string, doi string, title string, venue string, normalized_venue string, year int,
keywords array<string>, authors array<{_AUTHOR}>, citations {_provenance('count:bigint')}, abstracts {_provenance('text:string,language:string')},
urls {_provenance('url:string')}, identifiers {_provenance('identifier_type:string,identifier_value:string')}, citation_velocity double,
breakthrough_score double, venue_confidence double, deduplication_confidence double, collection_source string, collection_timestamp timestamp_ntz"""


def paper_schema() -> T.StructType:
    return T.StructType.fromDDL(PAPER_DDL)


def latest_citations(citations: Column) -> Column:
    """The greatest count of any record, 0 without records."""
    return F.coalesce(F.array_max(F.transform(citations, lambda c: c["data"]["count"])), F.lit(0))


def best_abstract(abstracts: Column) -> Column:
    """The first original record's text, else the first, else empty."""
    original = F.get(F.filter(abstracts, lambda x: x["original"]), F.lit(0))
    return F.coalesce(original["data"]["text"], F.get(abstracts, F.lit(0))["data"]["text"], F.lit(""))


def best_urls(urls: Column) -> Column:
    original = F.filter(urls, lambda x: x["original"])
    return F.transform(F.when(F.size(original) > 0, original).otherwise(urls), lambda x: x["data"]["url"])


def best_pdf_url(urls: Column) -> Column:
    """Of the URLs that contain pdf: originals first, then the latest."""
    pdfs = F.filter(urls, lambda x: F.lower(x["data"]["url"]).contains("pdf"))
    keyed = F.transform(pdfs, lambda x, i: F.struct(x["original"].cast("int").alias("o"), x["timestamp"].alias("t"), (-i).alias("i"), x["data"]["url"].alias("u")))
    return F.array_max(keyed)["u"]


def promote_identifiers(papers: DataFrame) -> DataFrame:
    """Fill empty doi, arxiv_id and openalex_id from identifier records; what
    finds its place taken goes to ``discovered``."""
    def records(kind):
        return F.filter("identifiers", lambda x: x["data"]["identifier_type"] == kind)

    names = {"doi": "doi", "arxiv_id": "arxiv", "openalex_id": "openalex"}
    empty = {c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True)) for c in names}
    filled = {c: F.when(empty[c], F.coalesce(F.get(records(k), F.lit(0))["data"]["identifier_value"], F.col(c))).otherwise(F.col(c)) for c, k in names.items()}

    def taken(kind):  # its place was filled before
        known = [empty[c] & (kind == k) for c, k in names.items()]
        return ~(known[0] | known[1] | known[2])

    rest = F.filter("identifiers", lambda x: taken(x["data"]["identifier_type"]))
    pairs = F.transform(rest, lambda x: F.struct(x["data"]["identifier_type"].alias("k"), x["data"]["identifier_value"].alias("v")))
    grouped = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    # first, for a name inside a lambda may be taken for the new column of that name
    told = papers.withColumn("discovered", F.coalesce(grouped, F.create_map().cast("map<string,string>")))
    return told.withColumns(filled)
