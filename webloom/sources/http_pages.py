"""A data source of pages over HTTP, for small sets of URLs: ``spark.read.format("webloom-pages").option("urls", ...)``.

One partition a host, so a host is asked by one task at a time. At most one retry within a shared time budget;
redirects to hosts that aren't public are refused unless ``allow_private`` is set; bodies are cut at 10 MiB.
"""

from __future__ import annotations

import ipaddress
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_BYTES, BUDGET_S, RETRIES, BACKOFF_S = 10 << 20, 30.0, 1, 0.25
SCHEMA = "url string, final_url string, status int, content_type string, html string, raw binary, warning string"


def is_public(url: str) -> bool:
    """http(s) with a host that is neither local nor a private address literal."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith(".localhost") or len(url) > 2048 or "\x00" in url:
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return True


class _Guard(urllib.request.HTTPRedirectHandler):
    def __init__(self, allow_private: bool):
        self.allow_private = allow_private

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not self.allow_private and not is_public(newurl):
            raise urllib.error.URLError("redirect to a host that isn't public")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str, agent: str = "webloom", allow_private: bool = False) -> tuple:
    """A row of SCHEMA; status 0 and a warning where nothing came."""
    if not allow_private and not is_public(url):
        return url, None, 0, None, None, None, "host isn't public"
    opener, end, why = urllib.request.build_opener(_Guard(allow_private)), time.monotonic() + BUDGET_S, ""
    for turn in range(RETRIES + 1):
        if turn:
            time.sleep(max(0.0, min(BACKOFF_S, end - time.monotonic())))
        left = end - time.monotonic()
        if left <= 0:
            break
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=left) as r:
                return _row(url, r.geturl(), r.status, r.headers.get("Content-Type", ""), r.read(MOST_BYTES))
        except urllib.error.HTTPError as e:
            if e.code not in (502, 503, 504) or turn == RETRIES:
                return _row(url, e.geturl(), e.code, e.headers.get("Content-Type", ""), e.read(MOST_BYTES))
        except (urllib.error.URLError, OSError, ValueError) as e:
            why = str(getattr(e, "reason", e))
            if "certificate" in why.lower() or "isn't public" in why:
                break
    return url, None, 0, None, None, None, why or "out of time"


def _row(url: str, final: str, status: int, kind: str, body: bytes) -> tuple:
    ct = kind.split(";", 1)[0].strip().lower()
    pdf = ct == "application/pdf"
    return url, final if final != url else None, status, ct, "" if pdf else body.decode("utf-8", "replace"), body if pdf else None, f"HTTP {status}" if status >= 400 else None


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u.strip() for u in options.get("urls", "").split("\n") if u.strip()]
        self.agent = options.get("agent", "webloom")
        self.allow_private = options.get("allow_private", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(us) for us in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for u in partition.urls:
            yield fetch(u, self.agent, self.allow_private)


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webloom-pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
