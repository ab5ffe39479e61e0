"""A Python data source that fetches pages: one partition a host, so that the
pause between requests to a host holds across the cluster."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers worth another try.  Fixed values.
RETRY = (429, 500, 502, 503, 504)
CHUNK = 64 * 1024
#: Seconds for a connection, at most.
CONNECT = 8.0
#: What a browser sends.  Fixed values.
HEADERS = {"User-Agent": "Mozilla/5.0", "Accept": "text/html,application/xhtml+xml,application/json;q=0.9,*/*;q=0.8", "Accept-Language": "ko-KR,ko;q=0.9,en;q=0.8"}
SCHEMA = "url string, status string, http_status int, charset string, content binary"


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(tuple(urls))


class _Http(http.client.HTTPConnection):
    """Connects within its own time; what is read later has ``timeout``."""

    most = CONNECT

    def connect(self) -> None:
        whole, self.timeout = self.timeout, min(self.timeout, self.most)
        super().connect()
        self.timeout = whole
        self.sock.settimeout(whole)


class _Https(http.client.HTTPSConnection):
    most = CONNECT

    def connect(self) -> None:
        whole, self.timeout = self.timeout, min(self.timeout, self.most)
        super().connect()
        self.timeout = whole
        self.sock.settimeout(whole)


def opener_for(connect: float):
    """An opener that spends at most ``connect`` seconds on a connection."""
    plain, safe = (type(k.__name__, (k,), {"most": connect}) for k in (_Http, _Https))

    class Http(urllib.request.HTTPHandler):
        def http_open(self, req):
            return self.do_open(plain, req)

    class Https(urllib.request.HTTPSHandler):
        def https_open(self, req):
            return self.do_open(safe, req)

    return urllib.request.build_opener(Http, Https).open


def fetch(url: str, *, timeout: float = 30.0, connect: float = CONNECT, tries: int = 3, connect_tries: int = 2, backoff: float = 1.0, max_bytes: int = 15 << 20, opener=None, sleep=time.sleep, data: bytes | None = None, referer: str = "") -> tuple:
    """One row of ``SCHEMA``; with ``data`` the request is a POST.  A body above
    ``max_bytes``, declared or met while reading in chunks, gives ``too_large``;
    errors give ``error`` without the cause, which may hold credentials of the
    URL.  A connection that fails is tried ``connect_tries`` times, of ``tries``
    in all."""
    opener = opener or opener_for(connect)
    request = urllib.request.Request(url, data=data, headers={**HEADERS, **({"Referer": referer} if referer else {})})
    unconnected = 0
    for attempt in range(tries):
        try:
            with opener(request, timeout=timeout) as r:
                declared = int(r.headers.get("Content-Length") or 0)
                body = bytearray()
                while declared <= max_bytes and (chunk := r.read(CHUNK)):
                    body += chunk
                    if len(body) > max_bytes:
                        break
                if declared > max_bytes or len(body) > max_bytes:
                    return url, "too_large", r.status, None, None
                return url, "ok", r.status, r.headers.get_content_charset(), bytes(body)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or attempt == tries - 1:
                return url, "error", e.code, None, None
        except OSError as e:
            unconnected += isinstance(e, urllib.error.URLError)  # raised before there is an answer
            if attempt == tries - 1 or unconnected >= connect_tries:
                return url, "error", None, None, None
        sleep(backoff * 2**attempt)
    return url, "error", None, None, None


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.delay = float(options.get("delay_sec", 1.0))
        self.kwargs = {"timeout": float(options.get("timeout_sec", 30)), "connect": float(options.get("connect_sec", CONNECT)), "max_bytes": int(options.get("max_bytes", 15 << 20)), "referer": options.get("referer", "")}
        if options.get("body") is not None:
            self.kwargs["data"] = options["body"].encode()

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlparse(u).netloc, []).append(u)
        return [HostPartition(v) for v in hosts.values()]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        for i, url in enumerate(partition.value):
            if i:
                time.sleep(self.delay)
            yield fetch(url, **self.kwargs)


class HttpPages(DataSource):
    """``spark.read.format("http_pages").option("urls", "\\n".join(...))``.

    Options: delay_sec, timeout_sec, connect_sec, max_bytes, referer, and body,
    which makes the requests POST.  ``register`` makes the format known.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``http_pages`` known to the session."""
    spark.dataSource.register(HttpPages)
