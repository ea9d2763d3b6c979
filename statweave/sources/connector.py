"""A Python data source for paged JSON services, with a recorded-payload mode.

``spark.read.format("paged_json").options(base=…, path=…, paging=…)`` gives one row for each page:
(url, page, body). ``mode=recorded`` reads pages from a folder of files named by the request, for tests and for runs
without a network. One service is one partition unless several paths are given, so the pause between calls holds.
Parsers in ``payloads`` turn bodies into rows; equality filters on ``path`` choose partitions before anything is read.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, SimpleDataSourceStreamReader

#: Seconds between attempts after a 429, a 5xx or a network error.
WAITS = (2.0, 5.0, 10.0)
LONGEST_WAIT = 60.0
SCHEMA = "url string, path string, page int, body string"


class ServiceError(RuntimeError):
    pass


def build_url(base: str, path: str, params: dict[str, Any]) -> str:
    """The request's URL: null and empty parameters are left out, lists repeat."""
    pairs = [(k, str(x)) for k, v in params.items() for x in (v if isinstance(v, (list, tuple)) else [v]) if x is not None and str(x) != ""]
    return f"{base.rstrip('/')}/{path.lstrip('/')}" + (f"?{urllib.parse.urlencode(pairs)}" if pairs else "")


def decode(body: bytes, encoding: str | None) -> str:
    """The text of a reply: gzip or deflate undone, a byte-order mark dropped."""
    if encoding == "gzip" or body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    elif encoding == "deflate":
        try:
            body = zlib.decompress(body)
        except zlib.error:
            body = zlib.decompress(body, -15)
    return body.decode("utf-8-sig", "replace")


def message(body: str) -> str:
    """What an error reply says: a JSON message, the text of its markup, or its start."""
    import re

    try:
        found = json.loads(body)
        while isinstance(found, list) and found:
            found = found[0]
        for key in ("message", "error", "detail", "title", "errorMessage"):
            if isinstance(found, dict) and found.get(key):
                return str(found[key])[:300]
    except ValueError:
        pass
    return re.sub(r"\s+", " ", re.sub(r"<[^<>]*>", " ", body)).strip()[:300]


def get(url: str, opener=urllib.request.urlopen, sleep=time.sleep, timeout: float = 60, cap: float | None = LONGEST_WAIT) -> str | None:
    """A reply's text, with retries; None where the service has no data (204, 404 with a no-records message)."""
    for wait in (*WAITS, None):
        try:
            request = urllib.request.Request(url, headers={"Accept-Encoding": "gzip, deflate", "User-Agent": "statweave"})
            with opener(request, timeout=timeout) as reply:
                if getattr(reply, "status", 200) == 204:
                    return None
                text = decode(reply.read(), reply.headers.get("Content-Encoding"))
                return text or None
        except urllib.error.HTTPError as e:
            said = message(decode(e.read() or b"", e.headers.get("Content-Encoding") if e.headers else None))
            if e.code == 404 and "norecords" in said.lower().replace(" ", ""):
                return None
            if wait is None or not (e.code == 429 or e.code >= 500):
                raise ServiceError(f"{e.code} from {url}: {said}") from e
            after = e.headers.get("Retry-After", "") if e.headers else ""
            sleep(min(float(after), cap or wait) if after.isdigit() else wait)
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if wait is None:
                raise ServiceError(f"no reply from {url}: {e}") from e
            sleep(wait)
    return None


def _at(reply: Any, path: str) -> Any:
    """The value at a dotted path of a reply, none if a step is missing."""
    for k in path.split("."):
        reply = reply.get(k) if isinstance(reply, dict) else None
    return reply


def pages(fetch, base: str, path: str, params: dict, paging: str, size: int, most: int, at: dict | None = None) -> Iterator[tuple[str, int, str]]:
    """(url, page, body) by page number (``page``/total in the reply), offset, or the link to the next page.

    ``at`` has the service's own names: ``page`` and ``size`` of the parameters, and the paths of ``total``, ``rows`` and
    ``served`` (the page size that the reply names). With paging ``rows`` the offset moves on by the rows that came,
    with ``pages`` (from 0) the size of the first reply holds; the first request of both leaves paging to the service.
    """
    at = at or {}
    url, n, come = build_url(base, path, params), 1, 0
    step: dict[str, Any] = {}
    while url and n <= most:
        if paging == "page":
            step = {at.get("page", "page"): n, at.get("size", "per_page"): size}
        elif paging == "offset":
            step = {at.get("page", "offset"): (n - 1) * size, at.get("size", "limit"): size}
        request = build_url(base, path, params | step) if paging in ("page", "offset", "rows", "pages") else url
        body = fetch(request)
        if body is None:
            return
        yield request, n, body
        try:
            reply = json.loads(body)
        except ValueError:
            return
        head = reply[0] if isinstance(reply, list) and reply and isinstance(reply[0], dict) else reply
        if not isinstance(head, dict):
            return
        if paging == "next":
            url = head.get("@odata.nextLink") or head.get("next")
        elif paging == "page":
            last = -(-int(_at(head, at["total"]) or 0) // size) if at.get("total") else int(head.get("pages") or head.get("totalPages") or head.get("maxPages") or 1)
            url = request if n < last else None
        elif paging == "offset":
            total = _at(head, at["total"]) if at.get("total") else head.get("total") or head.get("num_found")
            url = request if n * size < int(total or 0) else None
        elif paging == "rows":
            got = _at(head, at["rows"]) or {}
            new = len([k for k in got if k != "facets"])
            come += new
            step = {at["size"]: size, at["page"]: come}
            url = request if new and come < int(_at(head, at["total"]) or 0) else None
        elif paging == "pages":
            step = {at["size"]: _at(head, at["served"]) or size, at["page"]: n}
            url = request if _at(head, at["rows"]) and n < int(_at(head, at["total"]) or 0) else None
        else:
            url = None
        n += 1


class PathPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def fetcher(options: dict):
    """How a request is answered: from recorded files, or over the network with a pause between calls."""
    if options.get("mode", "http") == "recorded":
        root = Path(options["folder"])

        def read(url: str) -> str | None:
            f = root / f"{zlib.crc32(url.encode()):08x}.json"
            return f.read_text(encoding="utf-8-sig") if f.exists() else None

        return read
    pause, last = float(options.get("pause", 0.5)), [0.0]

    def call(url: str) -> str | None:
        wait = last[0] + pause - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        last[0] = time.monotonic()
        return get(url)

    return call


class PagedJsonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.paths = [p for p in options["path"].split("|") if p]

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = [p for p in self.paths if p == f.value]
            yield f

    def partitions(self):
        return [PathPartition(p) for p in self.paths] or [PathPartition("")]

    def read(self, partition):
        if not partition.path:
            return
        o = self.options
        params = json.loads(o.get("params", "{}"))
        for url, n, body in pages(fetcher(o), o["base"], partition.path, params, o.get("paging", "page"), int(o.get("pagesize", 100)), int(o.get("maxpages", 1_000_000)), json.loads(o.get("at", "{}"))):
            yield url, partition.path, n, body


class PagedJsonStream(SimpleDataSourceStreamReader):
    """Pages as a stream: an offset is the number of the last page read, so a restart goes on where it stopped."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def _rows(self, start: int, end: int | None):
        o = self.options
        size = int(o.get("pagesize", 100))
        fetch, n = fetcher(o), start + 1
        while end is None or n <= end:
            at = {"page": n, "per_page": size} if o.get("paging", "page") == "page" else {"offset": (n - 1) * size, "limit": size}
            url = build_url(o["base"], o["path"], json.loads(o.get("params", "{}")) | at)
            body = fetch(url)
            if body is None:
                return
            yield url, o["path"], n, body
            n += 1
            if end is None and n > start + int(o.get("pagesperbatch", 10)):
                return

    def read(self, start: dict):
        rows = list(self._rows(start["page"], None))
        return iter(rows), {"page": rows[-1][2] if rows else start["page"]}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return self._rows(start["page"], end["page"])


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PagedJsonReader(dict(self.options))

    def simpleStreamReader(self, schema):  # noqa: N802
        return PagedJsonStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters passed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)


def is_pdf(head: bytes) -> bool:
    return b"%PDF" in head[:1024]
