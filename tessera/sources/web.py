"""Crawl sources: paged listings and fetches behind a transport that can be replaced.

``register`` adds the data source ``paged``. Options: ``transport`` (module:function), and any
others, which are handed to the transport; ``attempts`` and ``backoff`` for errors of the connection;
``proxies`` (module:class), whose choice for each request is handed over as ``proxy``. The transport is called as
``transport(options, partition, token)`` and returns (rows, next token); paging within a
partition ends when the token is None, and follows the continuation token it is given.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Hosts of the encyclopedia by language, and the extra parameter of one of them.
ENCYCLOPEDIA_HOSTS = {
    "english": "https://en.wikipedia.org/w/api.php",
    "chinese": "https://zh.wikipedia.org/w/api.php",
    "japanese": "https://ja.wikipedia.org/w/api.php",
    "spanish": "https://es.wikipedia.org/w/api.php",
    "german": "https://de.wikipedia.org/w/api.php",
    "french": "https://fr.wikipedia.org/w/api.php",
    "arabic": "https://ar.wikipedia.org/w/api.php",
}
CONTENT_PARAMETERS = {"chinese": {"variant": "zh-cn"}}

# The beginnings of addresses of news articles.
NEWS_PREFIXES = [
    "https://www.bbc.com/news/articles/",
    "https://www.bbc.com/news/world-",
    "https://www.bbc.com/news/uk-",
    "https://www.bbc.com/news/business-",
    "https://www.bbc.com/news/science-",
    "https://www.bbc.com/news/newsbeat-",
    "https://www.bbc.com/news/entertainment-",
    "https://www.bbc.com/news/explainers-",
    "https://www.bbc.com/news/education-",
    "https://www.bbc.com/news/blogs-",
    "https://www.bbc.com/news/health-",
]


def encyclopedia_host(language: str) -> str:
    """Return the address of a language's interface; an unknown language is an error."""
    try:
        return ENCYCLOPEDIA_HOSTS[language]
    except KeyError:
        raise ValueError(f"unsupported language: {language}") from None


@dataclass
class Retry:
    """How often and how long to try: ``total`` attempts, pauses growing by ``backoff`` seconds."""

    total: int = 5
    backoff: float = 0.1
    statuses: tuple[int, ...] = (500, 502, 503, 504)
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def call(self, request: Callable[[], tuple[int, bytes]]) -> bytes | None:
        """Return the body of the first answer that is no failure; None if every attempt fails."""
        for attempt in range(self.total):
            try:
                status, body = request()
                if status not in self.statuses:
                    return body if status == 200 else None
            except OSError:
                pass
            if attempt + 1 < self.total:
                self.sleep(self.backoff * 2**attempt)
        return None

    def run(self, request: Callable[[], Any]) -> Any:
        """Return what ``request`` returns, trying again after errors of the connection; the last one is raised."""
        for attempt in range(self.total):
            try:
                return request()
            except OSError:
                if attempt + 1 == self.total:
                    raise
                self.sleep(self.backoff * 2**attempt)
        return None


class Proxies:
    """Where requests go out; override ``choose`` to use one."""

    def choose(self) -> dict[str, str] | None:
        """Return the proxy of the next request, by scheme, or None."""
        return None


def is_gzip(headers: dict[str, str]) -> bool:
    """Tell from a head answer whether a download is a gzip archive."""
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "")
    return "gzip" in kind.lower()


def rate_limit(headers: dict[str, str]) -> dict[str, int | None]:
    """Read the limit, the remaining requests and the time of renewal from an answer's headers."""
    low = {k.lower(): v for k, v in headers.items()}
    value = lambda name: int(low[name]) if low.get(name, "").isdigit() else None
    return {name: value(f"x-ratelimit-{name}") for name in ("limit", "remaining", "reset")}


def named(place: str) -> Callable:
    """Return what ``module:name`` names."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


class _Partition(InputPartition):
    def __init__(self, value: str) -> None:
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.names = schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        """One task for each of the option ``partitions``, a JSON list; dates, pages or languages."""
        return [_Partition(p) for p in json.loads(self.options.get("partitions", '[""]'))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Follow the continuation tokens of one partition and yield its rows."""
        transport = named(self.options["transport"])
        proxies = named(self.options["proxies"])() if "proxies" in self.options else Proxies()
        retry = Retry(int(self.options.get("attempts", 5)), float(self.options.get("backoff", 0.1)))
        token = None
        while True:
            sent = {**self.options, "proxy": json.dumps(proxies.choose())}
            rows, token = retry.run(lambda at=token: transport(sent, partition.value, at))
            for row in rows:
                yield tuple(row.get(n) for n in self.names)
            if token is None:
                return


class PagedSource(DataSource):
    """A listing in pages."""

    @classmethod
    def name(cls) -> str:
        """Return the format's name."""
        return "paged"

    def schema(self) -> str:
        """Return the schema unless the reader is given one."""
        return "partition string, value string"

    def reader(self, schema) -> DataSourceReader:
        """Return the reader."""
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Add the data source to a session."""
    spark.dataSource.register(PagedSource)


def fixture_pages(options: dict[str, str], partition: str, token: str | None) -> tuple[list[dict], str | None]:
    """Serve pages from the option ``pages``: JSON of partition to list of pages of values.

    An entry that is a string stands for an error of the service.
    """
    pages = json.loads(options["pages"]).get(partition, [])
    at = int(token or 0)
    if at >= len(pages):
        return [], None
    if isinstance(pages[at], str):
        raise RuntimeError(pages[at])
    rows = [{"partition": partition, "value": v} for v in pages[at]]
    return rows, str(at + 1) if at + 1 < len(pages) else None
