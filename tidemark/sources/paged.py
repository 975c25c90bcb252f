"""A data source of pages: one partition per page, each fetched by the task that reads it.

spark.dataSource.register(PagedSource); spark.read.format("paged").options(url="https://.../cards?offset={offset}&num={size}",
pages=8, size=2000, path="data", retries=3).load() gives page, pos, value (JSON). The url may be a file: templates work alike, so
tests need no network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, pos int, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, size = partition.value, int(self.options.get("size", 2000))
        rows = fetch(self.options["url"].format(page=page, offset=page * size, size=size), int(self.options.get("retries", 3)))
        for key in filter(None, self.options.get("path", "").split(".")):
            rows = rows.get(key, [])
        for pos, row in enumerate(rows if isinstance(rows, list) else [rows]):
            yield page, pos, json.dumps(row, ensure_ascii=False)


def fetch(url: str, retries: int = 3, wait: float = 1.0):  # noqa: ANN201
    """The JSON of a link, tried again after growing waits."""
    from urllib.request import urlopen

    for k in range(retries):
        try:
            with urlopen(url, timeout=60) as answer:
                return json.load(answer)
        except OSError:
            if k + 1 == retries:
                raise
            time.sleep(wait * 2**k)
    return None
