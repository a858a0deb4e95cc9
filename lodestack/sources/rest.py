"""A REST list and its details as a data source, with an injectable fetch function.

A list is read page by page (offset and limit, or the Link header's rel="next"); offsets have to rise. Pages are found on
the driver, one partition each; tasks fetch the details. An item whose detail cannot be had is a row with an error, and the others go on.

As a stream the list is one that grows at its end. Its offset is the number of items seen, which the checkpoint keeps; a batch is a range of the
list, cut in pages, and tasks fetch pages and details, so a batch that is run again after a failure reads the same items.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE = 50
NEXT = r'<([^<>]+)>;\s*rel="next"'
SCHEMA = "id string, title string, last_published_at string, url string, content string, error string"
Fetch = Callable[[str], tuple[int, dict[str, str], str]]


def next_link(header: Column) -> Column:
    """The rel="next" target of an RFC 8288 Link header, else an empty string."""
    return F.regexp_extract(header, NEXT, 1)


def http_fetch(url: str) -> tuple[int, dict[str, str], str]:
    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310  the caller names the service
        return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()


def _get(fetch: Fetch, url: str) -> tuple[dict[str, str], dict]:
    status, headers, body = fetch(url)
    if not 200 <= status < 300:
        raise RuntimeError(f"{url} answered {status}")
    return headers, json.loads(body)


def list_pages(base: str, fetch: Fetch, size: int = PAGE) -> Iterator[list[str]]:
    """Identifiers of each page; stops without a next link, and when the offset does not rise."""
    url, offset = f"{base}?offset=0&limit={size}", 0
    while url:
        headers, body = _get(fetch, url)
        yield [str(x["id"]) for x in body["items"]]
        found = re.search(NEXT, headers.get("link", ""))
        url = found[1] if found else ""
        if url:
            after = int(parse_qs(urlparse(url).query).get("offset", ["-1"])[0])
            if after <= offset:
                raise RuntimeError("pagination stalled")
            offset = after


def detail(base: str, fetch: Fetch, i: str) -> tuple:
    """A row of SCHEMA: the item, or its id and what went wrong."""
    try:
        _, d = _get(fetch, f"{base}/{i}")
        return (str(d["id"]), d.get("title"), d.get("lastPublishedAt"), d.get("url"), d.get("content"), None)
    except Exception as e:  # noqa: BLE001  whatever one item does, the others go on
        return (i, None, None, None, None, f"{type(e).__name__}: {e}")


class _Page(InputPartition):
    def __init__(self, ids: list[str]):
        super().__init__(ids)
        self.ids = ids


class RestReader(DataSourceReader):
    def __init__(self, base: str, fetch: Fetch):
        self.base, self.fetch = base, fetch

    def partitions(self) -> list[_Page]:
        return [_Page(ids) for ids in list_pages(self.base, self.fetch)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for i in partition.ids:
            yield detail(self.base, self.fetch, i)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class RestStream(DataSourceStreamReader):
    """Offsets are {"items": number of items of the list}."""

    def __init__(self, base: str, fetch: Fetch, size: int = PAGE):
        self.base, self.fetch, self.size, self.known = base, fetch, size, 0

    def _page(self, offset: int, size: int) -> list[str]:
        _, body = _get(self.fetch, f"{self.base}?offset={offset}&limit={size}")
        return [str(x["id"]) for x in body["items"]]

    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        """How long the list is: pages ever further on until one is empty, then between the last two, so few requests for a long list."""
        full, step = self.known, self.size
        while self._page(full + step - 1, 1):
            full, step = full + step, 2 * step
        empty = full + step - 1
        while full < empty:  # an item is at full - 1, if any, and none at empty
            middle = (full + empty) // 2
            if self._page(middle, 1):
                full = middle + 1
            else:
                empty = middle
        self.known = full
        return {"items": full}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        if end["items"] < start["items"]:
            raise RuntimeError(f"the list has become shorter: {end['items']} of {start['items']} items")
        return [_Range(at, min(at + self.size, end["items"])) for at in range(start["items"], end["items"], self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        ids = self._page(partition.start, partition.end - partition.start)
        if len(ids) != partition.end - partition.start:
            raise RuntimeError(f"{len(ids)} items at {partition.start}, not {partition.end - partition.start}")
        for i in ids:
            yield detail(self.base, self.fetch, i)

    def commit(self, end: dict) -> None:
        pass


def rest_source(name: str, fetch: Fetch = http_fetch) -> type[DataSource]:
    """A data source class for spark.dataSource.register; option `path` is the list's URL."""

    class RestSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return RestReader(self.options["path"], fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002, N802
            return RestStream(self.options["path"], fetch, int(self.options.get("page", PAGE)))

    return RestSource


def read_rest(spark: SparkSession, url: str, fetch: Fetch = http_fetch) -> DataFrame:
    spark.dataSource.register(rest_source("lodestack_rest", fetch))
    return spark.read.format("lodestack_rest").load(url)


def stream_rest(spark: SparkSession, url: str, fetch: Fetch = http_fetch, page: int = PAGE) -> DataFrame:
    """The list as a stream of SCHEMA: new items as the list grows."""
    spark.dataSource.register(rest_source("lodestack_rest", fetch))
    return spark.readStream.format("lodestack_rest").option("page", page).load(url)
