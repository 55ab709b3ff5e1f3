"""Fetching of pages through an interface: whoever has a network gives the function (SRC-06, 07, 08, 11)."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: (address) -> (status, body); raises on a broken connection.
Fetch = Callable[[str], tuple[int, str]]
#: Statuses after which the second way is tried.
ESCALATE = (403, 429, 503)


class Limiter:
    """At least `least` seconds between two calls of one process."""

    def __init__(self, least: float, clock=time.monotonic, sleep=time.sleep):
        self.least, self.clock, self.sleep, self._lock, self._last = least, clock, sleep, threading.Lock(), None

    def wait(self) -> None:
        with self._lock:
            if self._last is not None and (left := self._last + self.least - self.clock()) > 0:
                self.sleep(left)
            self._last = self.clock()


def fetch_one(url: str, plain: Fetch, browser: Fetch | None = None) -> tuple[str | None, str]:
    """(body, reason): the body of a 200, else null and why; some statuses are tried again by the second way."""
    reason = ""
    for way in (plain, browser):
        if way is None:
            break
        try:
            status, body = way(url)
        except Exception as e:  # noqa: BLE001 - a fetcher may raise anything
            return None, f"error_{type(e).__name__}"
        if status == 200:
            return body, "ok"
        reason = "429_rate_limited" if status == 429 else f"http_{status}"
        if status not in ESCALATE:
            break
    return None, reason


def fetch_pages(urls: DataFrame, column: str, plain: Fetch, browser: Fetch | None = None, least: float = 0.0) -> DataFrame:
    """(url, body, reason) of each distinct address. With a least time between calls one task fetches them all,
    as the limit is the site's and not a process's."""
    rows = urls.select(urls[column].alias("url")).where("url is not null").distinct()

    def run(batches):
        limiter = Limiter(least)
        for pdf in batches:
            got = []
            for u in pdf["url"]:
                if least:
                    limiter.wait()
                got.append(fetch_one(u, plain, browser))
            yield pd.DataFrame({"url": pdf["url"], "body": [g[0] for g in got], "reason": [g[1] for g in got]})

    return (rows.repartition(1) if least else rows).mapInPandas(run, "url string, body string, reason string")
