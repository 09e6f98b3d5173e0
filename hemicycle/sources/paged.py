"""A paged JSON service as a Spark data source: one task per page, retries with growing pauses, pages by any URL (file: too)."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "page int, item_id string, party string, json string"
#: Our own two rows, for examples without a service.
SAMPLE = [{"id": "sample-1", "party": "S", "title": "A first sample"}, {"id": "sample-2", "party": "M", "title": "A second sample"}]


def fetch(url: str, tries: int = 3, pause: float = 0.5):
    """The JSON at the URL; after the n-th failure it waits n times the pause."""
    for n in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            if n == tries:
                raise
            time.sleep(n * pause)


def entries(answer, path: str) -> list[dict]:
    """The list (or the one object) that lies under the dotted path."""
    for step in filter(None, path.split(".")):
        answer = answer.get(step) if isinstance(answer, dict) else None
    return answer if isinstance(answer, list) else [answer] if isinstance(answer, dict) else []


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(1, int(self.options.get("pages", 1)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        answer = fetch(o["url"].replace("{page}", str(partition.value)), int(o.get("tries", 3)), float(o.get("pause", 0.5)))
        for e in entries(answer, o.get("items", "")):
            name = next((str(e[k]) for k in ("dok_id", "id") if e.get(k)), None)
            party = next((str(e[k]) for k in ("parti", "party") if e.get(k)), None)
            if name:
                yield partition.value, name, party, json.dumps(e, ensure_ascii=False, sort_keys=True)


class PagedSource(DataSource):
    """Options: url (with {page}), pages, items (dotted path of the list), tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "hemicycle_pages"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_pages(spark: SparkSession, url: str | None, pages: int = 1, items: str = "", parties: list[str] | None = None, limit: int | None = None, **options) -> DataFrame:
    """page, item_id, party and json of a service's entries, of these parties, the first `limit` by page and id. Without a URL: two sample rows."""
    if url is None:
        df = spark.createDataFrame([(1, e["id"], e["party"], json.dumps(e, sort_keys=True)) for e in SAMPLE], _SCHEMA)
    else:
        spark.dataSource.register(PagedSource)
        df = spark.read.format("hemicycle_pages").options(url=url, pages=pages, items=items, **options).load()
    df = df.where(F.upper("party").isin([p.upper() for p in parties])) if parties else df
    return df.orderBy("page", "item_id").limit(limit) if limit else df
