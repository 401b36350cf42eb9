"""HTTP sources as a Python data source: a polite GET of each URL of a list.

The rate limit is kept in each reader, so a source of n partitions reads at rate / n each.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RateLimiter:
    """At least 1 / rate seconds between calls."""

    def __init__(self, rate: float) -> None:
        self.gap, self.last = 1.0 / rate, 0.0

    def wait(self) -> None:
        rest = self.last + self.gap - time.monotonic()
        if rest > 0:
            time.sleep(rest)
        self.last = time.monotonic()


def checked_agent(agent: str | None) -> str:
    """The user agent, which must name a real contact."""
    if not agent or not agent.strip() or "example.com" in agent:
        raise ValueError("set the userAgent option to a real contact")
    return agent.strip()


def normal_base(url: str | None, default: str = "http://127.0.0.1:8000") -> str:
    """A base URL: the default if empty, else trimmed with exactly one slash at its end."""
    cleaned = (url or "").strip()
    return cleaned.rstrip("/") + "/" if cleaned else default


def get(url: str, agent: str, timeout: float) -> str:
    """The body as text; an error for a status of 400 or more."""
    request = urllib.request.Request(url, headers={"User-Agent": agent, "Host": urllib.parse.urlsplit(url).netloc} if url.startswith("http") else {})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode("utf-8", "ignore")


class ServiceError(RuntimeError):
    """What a service's answer lacks: it can't be reached, has a status of 400 or more, or isn't JSON."""


def api_get(base: str | None, route: str, params: dict | None = None, timeout: float = 8.0):
    """The JSON that a route of a service answers."""
    url = urllib.parse.urljoin(normal_base(base).rstrip("/") + "/", route.lstrip("/"))
    given = {k: v for k, v in (params or {}).items() if v is not None}
    if given:
        url += "?" + urllib.parse.urlencode(given)
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return json.loads(answer.read())
    except (OSError, ValueError) as error:
        raise ServiceError(f"{url}: {error}") from error


def json_pages(pages, schema: str):
    """(url, json) of fetched pages: bodies by a schema, null where they aren't JSON."""
    from pyspark.sql import functions as F

    return pages.select("url", F.from_json("body", schema).alias("json"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        agent = setting("HTTP_USER_AGENT", options.get("userAgent"))
        rate = setting("HTTP_REQUESTS_PER_SECOND", options.get("requestsPerSecond"))
        self.agent, self.rate, self.timeout = checked_agent(agent), float(rate or 8), float(options.get("timeout", 30))
        self.count = max(1, min(int(options.get("partitions", 1)), len(self.urls) or 1))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        limiter = RateLimiter(self.rate / self.count)
        for url in self.urls[partition.value :: self.count]:
            limiter.wait()
            yield url, get(url, self.agent, self.timeout)


class HttpText(DataSource):
    """spark.read.format("http_text").option("urls", "\\n".join(urls)).option("userAgent", agent).load(): (url, body)."""

    @classmethod
    def name(cls) -> str:
        return "http_text"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def download(pages, root: str) -> int:
    """Writes (path, body) rows as a partitioned text table under root; returns how many.  Each page is fetched once: the count is observed while rows are written."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    pages.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("path").text(root)
    return int(seen.get["n"])


def setting(name: str, given: str | None = None, environment: dict[str, str] | None = None) -> str | None:
    """An option's value, or else that of the environment variable of the same name."""
    return given if given else (os.environ if environment is None else environment).get(name)
