"""A Spark data source for paged JSON lists over HTTP, and its replay from recorded files.

``spark.read.format("paged_json").option("url", ...).option("list", "a.b").option("total", n).load()`` reads one page in each task.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, PAGE_SIZE, TIMEOUT = 3, 250, 30


def api_key(env_file: str = ".env") -> str:
    """The key in ``CONGRESS_API_KEY``, of the environment or else of ``env_file``; with a warning the public demonstration key."""
    key = os.environ.get("CONGRESS_API_KEY")
    if not key and os.path.isfile(env_file):
        with open(env_file, encoding="utf-8") as f:
            pairs = [x.strip().removeprefix("export ").partition("=") for x in f if "=" in x and not x.lstrip().startswith("#")]
        key = next((v.strip().strip("'\"") for k, _, v in pairs if k.strip() == "CONGRESS_API_KEY"), None)
    if not key:
        warnings.warn("CONGRESS_API_KEY isn't set; the demonstration key allows few requests", stacklevel=2)
    return key or "DEMO_KEY"


def fetch(url: str, get: Callable[[str], tuple[int, bytes]] | None = None, wait: Callable[[float], None] = time.sleep) -> bytes:
    """Body of a page; too many requests wait a minute, server errors 1, 2, 4 seconds, anything else fails at once."""
    status = 0
    for k in range(ATTEMPTS):
        status, body = (get or _get)(url)
        if status < 400:
            return body
        if status == 429:
            wait(60)
        elif status >= 500:
            wait(2**k)
        else:
            break
    raise RuntimeError(f"{url.partition('?')[0]}: status {status}")  # what follows holds the key


def _get(url: str) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as r:  # noqa: S310
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def page_url(url: str, offset: int, size: int, key: str) -> str:
    mark = "&" if "?" in url else "?"
    return f"{url}{mark}{urllib.parse.urlencode({'limit': size, 'offset': offset, 'api_key': key, 'format': 'json'})}"


def items(body: bytes, path: str) -> list:
    node = json.loads(body)
    for name in path.split("."):
        node = node[name]
    return node


class _Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.path = options["url"], options["list"]
        self.size, self.total = int(options.get("size", PAGE_SIZE)), options.get("total")
        self.replay = options.get("replay")

    def _body(self, offset: int) -> bytes:
        if self.replay:
            with open(f"{self.replay}/{offset}.json", "rb") as f:
                return f.read()
        return fetch(page_url(self.url, offset, self.size, api_key()))

    def partitions(self) -> list[InputPartition]:
        total = int(self.total) if self.total else json.loads(self._body(0))["pagination"]["count"]
        return [_Page(o) for o in range(0, max(total, 1), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, x in enumerate(items(self._body(partition.offset), self.path)):
            yield partition.offset + i, json.dumps(x)


class PagedJson(DataSource):
    """Rows (place, item): each item of the list as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "place long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
