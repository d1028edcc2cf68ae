"""Pages by HTTP, as a table operation: each task asks for its rows' addresses."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "tessera/1.0"
ANSWER = "url string, status int, content_type string, html string, etag string, last_modified string, final_url string"


def request(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes, str]:
    """Status, headers in lower case, body and final address (after redirects) of an address; status 599 if there is no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT, **headers}), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(), r.url
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b"", e.url or url
    except (OSError, ValueError):
        return 599, {}, b"", url


def fetched(urls: DataFrame, known: DataFrame | None = None, timeout: float = 20, ask: Callable = request) -> DataFrame:
    """ANSWER of each row of (url). Where rows bring an etag or last_modified, or ``known`` (url, etag, last_modified) does, requests
    are conditional: an unchanged page answers 304.
    """
    if known is not None:
        rows = urls.select("url").join(known.select("url", "etag", "last_modified"), "url", "left")
    else:
        rows = urls.select("url", *((F.col(c) if c in urls.columns else F.lit(None)).cast("string").alias(c) for c in ("etag", "last_modified")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, etag, modified in zip(b["url"], b["etag"], b["last_modified"]):
                headers = ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
                status, answer, body, *final = ask(url, headers, timeout)
                out.append((url, status, answer.get("content-type", ""), body.decode("utf-8", "replace"), answer.get("etag", etag), answer.get("last-modified", modified), final[0] if final else url))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return rows.mapInPandas(run, ANSWER)


def reader(service: str, timeout: float = 30, ask: Callable = request) -> Callable[[DataFrame], DataFrame]:
    """A function from (url) to (url, page): what a reader service at ``service``, before the address, makes of each page."""

    def read(urls: DataFrame) -> DataFrame:
        answers = fetched(urls.select(F.concat(F.lit(service), "url").alias("url")), None, timeout, ask)
        return answers.where("status = 200").select(F.substr("url", F.lit(len(service) + 1)).alias("url"), F.col("html").alias("page"))

    return read
