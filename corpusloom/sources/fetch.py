"""Pages over HTTP, from a cache first, as a plan step: rate limit, retries, and the charset that old servers get wrong."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import code_path

Response = tuple[int, bytes, str | None]


def http_get(url: str, timeout: float = 30.0) -> Response:
    """Status, body and declared charset."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status, r.read(), r.headers.get_content_charset()
    except urllib.error.HTTPError as e:
        return e.code, e.read(), e.headers.get_content_charset()


def text_of(body: bytes, charset: str | None) -> str:
    """Pages declared (or defaulted) as ISO-8859-1 are Greek in fact."""
    name = (charset or "iso-8859-1").lower()
    return body.decode("iso-8859-7" if name in ("iso-8859-1", "latin-1") else name, "replace")


class Fetcher:
    """Fetches with a pause between requests; server errors are tried again after 1, 2, 4 ... seconds, then raised."""

    def __init__(self, get: Callable[[str], Response] = http_get, pause: float = 0.75, tries: int = 3, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.get, self.pause, self.tries, self.sleep, self.clock, self.last = get, pause, tries, sleep, clock, None

    def wait(self) -> None:
        if self.last is not None and (left := self.pause - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()

    def fetch(self, url: str) -> str:
        error = "no try was made"
        for k in range(self.tries):
            if k:
                self.sleep(2.0 ** (k - 1))
            self.wait()
            try:
                status, body, charset = self.get(url)
            except OSError as e:
                error = str(e)
                continue
            if status < 400:
                return text_of(body, charset)
            error = f"status {status}"
            if status < 500:
                break
        raise OSError(f"{url}: {error}")


def fetch_pages(urls: DataFrame, make: Callable[[], Fetcher] = Fetcher, fallback: Callable[[str], str | None] | None = None, url: str = "url", partitions: int = 30) -> DataFrame:
    """url, html, status (ok, fail), error; a fallback names another address to try once. One fetcher a task, so the pause holds within it."""
    code_path(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = make()
        for batch in batches:
            rows = []
            for u in batch["url"]:
                html, error = None, None
                for target in dict.fromkeys(filter(None, [u, fallback(u) if fallback else None])):
                    try:
                        html, error = fetcher.fetch(target), None
                        break
                    except OSError as e:
                        error = str(e)
                rows.append((u, html, "fail" if error else "ok", error))
            yield pd.DataFrame(rows, columns=["url", "html", "status", "error"])

    return urls.select(F.col(url).alias("url")).repartition(partitions).mapInPandas(run, "url string, html string, status string, error string")


def with_cache(urls: DataFrame, cached: DataFrame, **options) -> DataFrame:
    """Pages of the cache (url, html), and fetched ones for the urls it doesn't have."""
    held = cached.where("html is not null").select("url", "html", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    missing = urls.join(held.select("url"), "url", "left_anti")
    return held.join(urls.select("url"), "url", "left_semi").unionByName(fetch_pages(missing, **options))
