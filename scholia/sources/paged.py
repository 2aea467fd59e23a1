"""A paginated service as a stream: pages are pulled by offset, once each.

``scholia_paged`` reads the saved answers of such a service: a folder of files
whose names sort in request order, each a JSON array (or {"data": [...]}) of
records. Options:

* path: the folder (any address that pyarrow's file systems know; a plain path
  is local to whoever reads it, so on a cluster it must be shared),
* page: records that one request asks for (default 100),
* limit: most records of the whole stream (default: no limit).

The rules are those of a pull by offset: a page with fewer records than asked
for is the last one, and so is an empty or unreadable one; the request that
would run past the limit asks for what is left, so the limit is never overshot.
Files behind the last page are not read.

An offset is (pages, records). It follows from the folder alone, so a query
that starts again from its checkpoint asks for the pages after its last batch
and for none twice. Each page is a partition that an executor reads; the driver
only counts records. A folder without files is a stream without rows yet.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page int, place int, record string"


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs
    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _records(path: str, file: str) -> list:
    system, _ = _open(path)
    with system.open_input_stream(file) as f:
        raw = f.read()
    try:
        found = json.loads(raw)
    except ValueError:
        return []
    found = found.get("data") if isinstance(found, dict) else found
    return found if isinstance(found, list) else []


class Page(InputPartition):
    def __init__(self, number: int, file: str, take: int):
        super().__init__(number)
        self.number, self.file, self.take = number, file, take


class _Pull:
    """What pages there are, and how much of each is wanted."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.page, self.limit = int(options.get("page", 100)), int(options["limit"]) if "limit" in options else None
        self.counts: dict[str, int] = {}

    def pages(self) -> list[Page]:
        out, total = [], 0
        for i, file in enumerate(_files(self.path)):
            ask = self.page if self.limit is None else min(self.page, self.limit - total)
            if ask <= 0:
                break
            if file not in self.counts:
                self.counts[file] = len(_records(self.path, file))
            got = min(self.counts[file], ask)
            if got:
                out.append(Page(i, file, got))
            total += got
            if got < ask:
                break
        return out

    def rows(self, part: Page | None) -> Iterator[tuple]:
        if part is None:  # no pages at all
            return
        for i, record in enumerate(_records(self.path, part.file)[:part.take]):
            yield part.number, i, record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)


class PullReader(_Pull, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages()

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition)


class PullStreamReader(_Pull, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"pages": 0, "records": 0}

    def latestOffset(self) -> dict:
        known = self.pages()
        return {"pages": len(known), "records": sum(p.take for p in known)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [p for p in self.pages() if start["pages"] <= p.number < end["pages"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scholia_paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PullReader:
        return PullReader(dict(self.options))

    def streamReader(self, schema) -> PullStreamReader:
        return PullStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Paged)


def pulled(spark: SparkSession, path: str, page: int = 100, limit: int | None = None, stream: bool = True) -> DataFrame:
    """(page, place, record) of the saved pages, the record as JSON text."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("scholia_paged").option("path", path).option("page", page)
    return (reader if limit is None else reader.option("limit", limit)).load()
