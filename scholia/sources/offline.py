"""Sources as Python data sources over files: one partition per page file.

A source is registered once (``register(spark)``) and read with
``spark.read.format("scholia_pages").option("path", dir)``; a parser for the
site's page layout turns a page into rows. Fetching pages from the network is
outside this library."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, title string, authors array<string>, venue string, year int, pdf_url string, abstract string"
TAG = re.compile(r"<[^>]+>")


def plain(html: str) -> str:
    return re.sub(r"\s+", " ", unescape(TAG.sub(" ", html))).strip()


def _listing(item: str, title: str, authors: str, pdf: str):
    def parse(text: str, venue: str, year: int):
        for block in re.split(item, text)[1:]:
            t, a, p = (re.search(x, block, re.S) for x in (title, authors, pdf))
            if t:
                names = [x.strip() for x in re.split(r",|;", plain(a.group(1)))] if a else []
                yield plain(t.group(1)), [x for x in names if x], venue, year, p.group(1) if p else None, None
    return parse


def _oai(text: str, venue: str, year: int):
    for block in re.findall(r"<record>.*?</record>", text, re.S):
        get = lambda tag: [plain(x) for x in re.findall(rf"<dc:{tag}[^>]*>(.*?)</dc:{tag}>", block, re.S)]  # noqa: E731, B023
        date = get("date")
        yield (get("title") or [""])[0], get("creator"), venue, int(date[0][:4]) if date else year, next((x for x in get("identifier") if "pdf" in x), None), (get("description") or [None])[0]


def _records(text: str, venue: str, year: int):
    """JSON answers: a list under data, results, notes or items."""
    found = json.loads(text)
    rows = found if isinstance(found, list) else next((found[k] for k in ("data", "results", "notes", "items") if k in found), [])
    for r in rows:
        r = r.get("content", r)
        names = [a.get("name") or a.get("display_name") if isinstance(a, dict) else a for a in r.get("authors") or []]
        yield r.get("title") or "", names, r.get("venue") or venue, int(r.get("year") or r.get("publication_year") or year), r.get("pdf_url") or r.get("pdf"), r.get("abstract")


# Which page layout each site has.
PARSERS = {
    "ijcai": _listing(r'class="paper_wrapper"', r'class="title">(.*?)<', r'class="authors">(.*?)<', r'href="([^"]+\.pdf)"'),
    "acl": _listing(r'class="d-sm-flex', r'class="align-middle"[^>]*>(.*?)</a>', r"</strong><br/?>(.*?)</span>", r'href="([^"]+\.pdf)"'),
    "cvf": _listing(r'class="ptitle"', r'<a href="[^"]*">(.*?)</a>', r"<dd>(.*?)</dd>", r'href="([^"]+\.pdf)"'),
    "pmlr": _listing(r'class="paper"', r'class="title">(.*?)<', r'class="authors">(.*?)<', r'href="([^"]+\.pdf)"'),
    "aaai": _oai, "openreview": _records, "semantic_scholar": _records, "openalex": _records, "crossref": _records, "nature": _records, "neurips": _records, "mlr": _records,
}
# Which source serves which venue; * is the rest.
ROUTES = {"ijcai": "ijcai", "acl": "acl", "emnlp": "acl", "naacl": "acl", "coling": "acl", "cvpr": "cvf", "iccv": "cvf", "wacv": "cvf", "icml": "pmlr", "aistats": "pmlr", "uai": "pmlr", "aaai": "aaai", "iclr": "openreview", "colm": "openreview", "neurips": "neurips", "nature": "nature", "*": "semantic_scholar"}


def route(venue: str) -> str:
    return ROUTES.get(venue.strip().lower(), ROUTES["*"])


class PageFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[PageFile]:
        import glob
        return [PageFile(p) for p in sorted(glob.glob(self.options["path"].removeprefix("file://").rstrip("/") + "/*"))]

    def read(self, part: PageFile) -> Iterator[tuple]:
        venue, year = self.options.get("venue", ""), int(self.options.get("year", "0"))
        site = self.options.get("site") or route(venue)
        with open(part.path, encoding="utf-8", errors="replace") as f:
            for row in PARSERS[site](f.read(), venue, year):
                yield (site, *row)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scholia_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
