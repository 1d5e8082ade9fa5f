"""A paged list service as a data source: a partition for each page, and filters that the service applies itself.

The service is stood in for by a folder of captured pages, page_1.json and so on, each an object with the rows (data) and the
number of the last page (lastPageNum); a session that reaches the service itself would only replace `fetch`. The folder
has to be one that driver and executors share."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "title string, career string, department string, cnUrl string, siteId int, language string, published string"
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def fetch(folder: str, page: int) -> dict:
    """One page of the service; a page that isn't there is empty."""
    try:
        with open(os.path.join(folder, f"page_{page}.json"), encoding="utf-8") as file:
            return json.load(file)
    except FileNotFoundError:
        return {"data": [], "lastPageNum": 0}


class _Page(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.conditions = folder, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equal values go to the service as its conditions; other filters are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.value is not None and f.attribute[0] not in self.conditions:
                self.conditions[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(1, int(fetch(self.folder, 1).get("lastPageNum") or 0) + 1)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no pages at all
            return
        for row in fetch(self.folder, partition.value).get("data") or []:
            if all(row.get(c) == v for c, v in self.conditions.items()):
                yield tuple(row.get(c) for c in COLUMNS)


class PagedRoster(DataSource):
    """spark.dataSource.register(PagedRoster), then spark.read.format("paged_roster").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "paged_roster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
