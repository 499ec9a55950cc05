"""Fetching pages as a Python data source: a partition for each domain, throttled, with retries."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGAIN = frozenset({429, 500, 502, 503, 504})


class Throttle:
    """At least `pause` seconds between two calls."""

    def __init__(self, pause: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep, self.last = pause, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.last + self.pause - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def get(url: str, *, retries: int = 3, factor: float = 30.0, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep, opener=urllib.request.urlopen) -> tuple[int | None, str | None]:
    """(status, body); body null once the retries are used up or the answer is an error that retrying won't mend."""
    for attempt in range(retries + 1):
        try:
            with opener(url, timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or attempt == retries:
                return e.code, None
        except OSError:
            if attempt == retries:
                return None, None
        sleep(factor * 2**attempt)
    return None, None


class Domain(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options["urls"].split()
        self.pause, self.retries, self.factor = float(options.get("pause", 1)), int(options.get("retries", 3)), float(options.get("factor", 30))

    def partitions(self) -> list[Domain]:
        by_domain = defaultdict(list)
        for url in self.urls:
            by_domain[urlsplit(url).netloc].append(url)
        return [Domain(urls) for urls in by_domain.values()]

    def read(self, partition: Domain) -> Iterator[tuple]:
        throttle = Throttle(self.pause)
        for url in partition.urls:
            throttle.wait()
            status, body = get(url, retries=self.retries, factor=self.factor)
            yield url, status, body


class Pages(DataSource):
    """spark.dataSource.register(Pages); spark.read.format("pages").option("urls", "http://a http://b").load()"""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, status int, html string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)
