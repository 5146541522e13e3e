"""Fetching pages: politely over HTTP, or from a page table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.functions.text import host

# Seconds between two requests to a host, and of a request; from this status on a request has failed.
DELAY, TIMEOUT, FAILED_FROM = 1.0, 30, 400


def allowed(url: str, robots: str | None, agent: str = "*") -> bool:
    """What a site's robots.txt says; without one everything is allowed."""
    if robots is None:
        return True
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return rules.can_fetch(agent, url)


def http_get(url: str) -> tuple[int, str]:
    import requests

    got = requests.get(url, timeout=TIMEOUT)
    return got.status_code, got.text


def fetched(urls: DataFrame, get: Callable[[str], tuple[int, str]] = http_get, delay: float = DELAY) -> DataFrame:
    """``urls(url)`` with ``html``, ``error_class`` and ``error``. A host's pages lie in one partition, where requests wait for each other.

    A failed request is that row's alone. robots.txt is asked once a host and task.
    """
    schema = "url string, html string, error_class string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        robots: dict[str, str | None] = {}
        last: dict[str, float] = {}

        def ask(url: str) -> tuple[int, str]:
            at = urlsplit(url).netloc
            wait = last.get(at, 0) + delay - time.monotonic()
            if at in last and wait > 0:
                time.sleep(wait)
            try:
                return get(url)
            finally:
                last[at] = time.monotonic()

        def one(url: str) -> tuple:
            site = "{0.scheme}://{0.netloc}".format(urlsplit(url))
            try:
                if site not in robots:
                    try:
                        code, text = ask(site + "/robots.txt")
                        robots[site] = text if code < FAILED_FROM else None
                    except Exception:
                        robots[site] = None
                if not allowed(url, robots[site]):
                    return url, None, "RobotsError", f"robots.txt forbids {url}"
                code, text = ask(url)
            except Exception as e:
                return url, None, "FetchError", f"{type(e).__name__}: {e}"
            return (url, None, "FetchError", f"HTTP {code} for {url}") if code >= FAILED_FROM else (url, text, "", "")

        for b in batches:
            yield pd.DataFrame([one(u) for u in b.url], columns=["url", "html", "error_class", "error"])

    return urls.select("url").distinct().repartition(host("url")).mapInPandas(run, schema)


def from_store(urls: DataFrame, store: DataFrame) -> DataFrame:
    """The same from a page table ``store(url, html)``: a page that is not there is a failed fetch."""
    once = store.groupBy("url").agg(F.max("html").alias("html"))
    got = urls.select("url").distinct().join(once, "url", "left")
    missing = F.col("html").isNull()
    return got.withColumn("error_class", F.when(missing, "FetchError").otherwise("")).withColumn("error", F.when(missing, F.concat(F.lit("no page at "), "url")).otherwise(""))
