"""Live lookups as rows: requests in, responses with one of three outcomes out.

``ok`` carries a body, ``absent`` is an answer (404), ``error`` is a lookup that could not be made. Transport is a function, so that a job may
bring its own; the defaults use the standard library. Requests run in partitions of their own, so repartition them to set how many run at once.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is asked again, how often, and how long to wait.
AGAIN, TRIES, FIRST_WAIT_S, LONGEST_WAIT_S = (429, 500, 502, 503, 504), 3, 1.0, 60.0
NO_HEAD = (403, 405, 501)
TIMEOUT_S = {"json": 20.0, "probe": 15.0, "query": 30.0, "bytes": 120.0}
CONTACT = "PROBATUM_CONTACT_EMAIL"


@dataclass
class Answer:
    """What a server said: ``status`` is none if it was not reached."""

    status: int | None
    body: bytes = b""
    url: str = ""
    headers: dict = field(default_factory=dict)
    error: str | None = None


def user_agent() -> str:
    contact = os.environ.get(CONTACT, "").strip()
    return "probatum/1" + (f" mailto:{contact}" if contact else "")


def ask(url: str, method: str = "GET", data: bytes | None = None, timeout: float = TIMEOUT_S["json"]) -> Answer:
    headers = {"User-Agent": user_agent(), "Accept": "application/json"} | ({"Content-Type": "application/json"} if data else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data, method=method, headers=headers), timeout=timeout) as got:
            return Answer(got.status, got.read(), got.geturl(), dict(got.headers))
    except urllib.error.HTTPError as e:
        return Answer(e.code, b"", url, dict(e.headers or {}))
    except (OSError, ValueError) as e:
        return Answer(None, b"", url, {}, f"{type(e).__name__}: {e}")


def wait_before(attempt: int, headers: dict) -> float:
    """Seconds before another try: what the server asks for, up to a minute, else twice as long each time."""
    asked = pd.to_numeric(headers.get("Retry-After"), errors="coerce")
    return min(float(asked), LONGEST_WAIT_S) if pd.notna(asked) and asked >= 0 else FIRST_WAIT_S * 2**attempt


def looked_up(url: str, transport: Callable[..., Answer] = ask, tries: int = TRIES, sleep: Callable[[float], object] = time.sleep, **how) -> tuple[str, str | None, str | None]:
    """``outcome, body, error`` of one request."""
    for attempt in range(max(1, tries)):
        got = transport(url, **how)
        if got.status is not None and 200 <= got.status < 400:
            return "ok", got.body.decode("utf-8", "replace"), None
        if got.status == 404:
            return "absent", None, None
        again = got.status is None or got.status in AGAIN
        if again and attempt < tries - 1:
            sleep(wait_before(attempt, got.headers if got.status is not None else {}))
        elif not again:
            break
    return "error", None, got.error or f"HTTP {got.status}"


def probed(url: str, transport: Callable[..., Answer] = ask) -> tuple[int | None, str, str | None]:
    """``http_status, final_url, error`` of a URL; servers that refuse HEAD are asked with GET."""
    got = transport(url, method="HEAD", timeout=TIMEOUT_S["probe"])
    if got.status in NO_HEAD:
        got = transport(url, method="GET", timeout=TIMEOUT_S["probe"])
    return got.status, got.url or url, got.error


def queried(url: str, query: str, variables: dict | None = None, transport: Callable[..., Answer] = ask) -> dict:
    """The ``data`` of a GraphQL answer; reported errors are raised."""
    got = transport(url, method="POST", data=json.dumps({"query": query, "variables": variables or {}}).encode(), timeout=TIMEOUT_S["query"])
    if got.status is None or got.status >= 400:
        raise OSError(got.error or f"HTTP {got.status}")
    answer = json.loads(got.body)
    if answer.get("errors"):
        raise ValueError(f"GraphQL: {answer['errors']}")
    return answer.get("data") or {}


def responses(requests: DataFrame, transport: Callable[..., Answer] = ask, tries: int = TRIES, sleep: Callable[[float], object] = time.sleep) -> DataFrame:
    """``provider, key, outcome, body, error`` for ``requests (provider, key, url)``, as ``sources.catalog.normalized`` takes them."""

    def run(batches):
        for pdf in batches:
            got = [looked_up(u, transport, tries, sleep) for u in pdf["url"]]
            if got:
                outcome, body, error = zip(*got, strict=True)
                yield pdf[["provider", "key"]].assign(outcome=outcome, body=body, error=error)

    return requests.select("provider", "key", "url").mapInPandas(run, "provider string, key string, outcome string, body string, error string")


def probes(urls: DataFrame, transport: Callable[..., Answer] = ask) -> DataFrame:
    """``url, http_status, final_url, error`` for ``urls (url)``, each different one once."""

    def run(batches):
        for pdf in batches:
            got = [probed(u, transport) for u in pdf["url"]]
            if got:
                status, final, error = zip(*got, strict=True)
                yield pdf[["url"]].assign(http_status=pd.array(status, dtype="Int32"), final_url=final, error=error)

    return urls.select("url").where("url <> ''").distinct().mapInPandas(run, "url string, http_status int, final_url string, error string")


def download(listing: DataFrame, dataset: str, filename: str, transport: Callable[..., Answer] = ask) -> bytes:
    """The bytes of one file of ``listing (dataset, filename, url)``, by its exact name."""
    found = listing.where((F.col("dataset") == dataset) & (F.col("filename") == filename)).select("url").first()
    if found is None:
        raise LookupError(f"{dataset} has no file {filename}")
    if not found["url"]:
        raise LookupError(f"{filename} of {dataset} has no address")
    got = transport(found["url"], timeout=TIMEOUT_S["bytes"])
    if got.status is None or got.status >= 400:
        raise OSError(got.error or f"HTTP {got.status}")
    return got.body


def local_bytes(spark, path: str) -> DataFrame:
    """``path, content`` of files that Spark can reach."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
