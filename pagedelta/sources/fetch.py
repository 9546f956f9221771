"""Fetching over HTTP: polite within a host, parallel across hosts.

All urls of a host are in one partition, in order, so the gaps between requests to a host are kept inside one task; responses
are passed on as they come, so a task holds ``HELD_BYTES`` of them and one more. A task that is run again fetches its hosts again;
nothing is retried by Spark below that. A url that cannot be asked for, or whose answer cannot be read, costs itself alone: its
row has an error in place of a response. The transport is a parameter, which is also how tests run without a network.
"""

from __future__ import annotations

import http.client
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import netloc

RETRY_STATUS = (429, 500, 502, 503, 504)
HELD_BYTES = 8 << 20
HELD_ROWS = 256
AGENTS = tuple(
    f"Mozilla/5.0 ({system}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{version}.0.0.0 Safari/537.36"
    for system in ("Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 10_15_7", "X11; Linux x86_64", "Windows NT 11.0; Win64; x64")
    for version in (124, 125)
)
FETCHED = "url string, status_code int, content_type string, x_robots string, final_url string, body binary"
ASKED = FETCHED + ", error string"
STATUS = "url string, status_code int, redirect_to string, noindex boolean, x_robots string"

_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)")


@dataclass
class Response:
    status: int
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""
    first_status: int | None = None


#: What asking for one url may raise: the network, a url that is none, an answer that breaks off or is no HTTP.
FAILURES = (OSError, ValueError, http.client.HTTPException)


def quoted(url: str) -> str:
    """The url as it is sent: blanks and other signs that may not stand in one are escaped, and the host is in ASCII."""
    parts = urllib.parse.urlsplit(url.strip())
    host = parts.netloc if parts.netloc.isascii() else parts.netloc.encode("idna").decode()
    safe = "!#$%&'()*+,/:;=?@[]~"
    return urllib.parse.urlunsplit((parts.scheme, host, *(urllib.parse.quote(x, safe) for x in parts[2:])))


class _First(urllib.request.HTTPRedirectHandler):
    """Follows redirects and remembers the first status."""

    def __init__(self) -> None:
        self.first: int | None = None

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.first = self.first or code
        return super().redirect_request(req, fp, code, msg, headers, quoted(newurl))


def over_network(url: str, agent: str, timeout: float) -> Response:
    first = _First()
    opener = urllib.request.build_opener(first)
    request = urllib.request.Request(quoted(url), headers={"User-Agent": agent, "Accept-Language": "en"})
    try:
        with opener.open(request, timeout=timeout) as got:
            headers = {k.lower(): v for k, v in got.headers.items()}
            return Response(got.status, got.url if first.first else url, headers, got.read(), first.first or got.status)
    except urllib.error.HTTPError as e:
        return Response(e.code, e.url if first.first and e.url else url, {k.lower(): v for k, v in e.headers.items()}, e.read(), first.first or e.code)


@dataclass
class Client:
    """Requests to one host after another, spaced, retried, under rotating agents."""

    transport: Callable[[str, str, float], Response] = over_network
    delay: float = 2.0
    timeout: float = 30.0
    retries: int = 3
    backoff: float = 1.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: dict[str, float] = field(default_factory=dict)

    def wait(self, host: str, delay: float) -> None:
        if host in self.last and (rest := self.last[host] + delay - self.clock()) > 0:
            self.sleep(rest)
        self.last[host] = self.clock()

    def ask(self, url: str, delay: float | None = None) -> Response | str:
        """The answer, whatever its status, or the last attempt's error. The next request is spaced from the last attempt.

        ``delay``: the seconds that this url's host asks for; the client's own delay is the least.
        """
        host = re.sub(r"^\w+://([^/?#]*).*", r"\1", url, flags=re.S)
        error = ""
        self.wait(host, max(self.delay, delay or 0.0))
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(self.backoff * 2 ** (attempt - 1))
                self.last[host] = self.clock()
            try:
                got = self.transport(url, random.choice(AGENTS), self.timeout)
                if got.status not in RETRY_STATUS:
                    return got
                error = f"status {got.status}"
            except FAILURES as e:
                error = f"{type(e).__name__}: {e}"[:500]
                if isinstance(e, (ValueError, http.client.InvalidURL)) and not isinstance(e, OSError):
                    break  # asking again does not make it a url
        return error

    def get(self, url: str, delay: float | None = None) -> Response | None:
        """The answer if it is a success, else None."""
        got = self.ask(url, delay)
        return got if isinstance(got, Response) and got.status < 400 else None


def status_of(url: str, got: Response | str | None) -> tuple:
    """Status of the first hop, where it led, and whether the page asks not to be indexed. A page that is gone has its status too."""
    if not isinstance(got, Response):
        return (url, None, None, False, None)
    robots = got.headers.get("x-robots-tag")
    noindex = "noindex" in (robots or "").lower()
    if got.status == 200 and "text/html" in got.headers.get("content-type", ""):
        head = got.body.decode("utf-8", "replace")[:5000].lower()
        noindex = noindex or 'name="robots"' in head and "noindex" in head
    return (url, got.first_status or got.status, got.url if got.url != url else None, noindex, robots)


def decoded(content_type: Column, body: Column) -> Column:
    """The text of a body: in the charset that the content type names, else UTF-8; what cannot be read becomes U+FFFD."""

    @F.pandas_udf("string")
    def read(types: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for kind, raw in zip(types, bodies, strict=True):
            named = _CHARSET.search(kind or "")
            try:
                out.append(None if raw is None else raw.decode(named[1] if named else "utf-8", "replace"))
            except (LookupError, UnicodeError):  # names no charset, or one that is none of texts
                out.append(raw.decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return read(content_type, body)


def _by_host(urls: DataFrame, one: Callable[[Client, str, float | None], tuple | None], make_client: Callable[[], Client], schema: str) -> DataFrame:
    delay = F.col("delay").cast("double") if "delay" in urls.columns else F.lit(None).cast("double")
    rows = urls.filter(F.col("url").isNotNull()).select("url", F.coalesce(netloc(F.col("url")), F.lit("")).alias("host"), delay.alias("delay"))
    rows = rows.groupBy("host", "url").agg(F.max("delay").alias("delay")).repartition("host").sortWithinPartitions("host", "url")
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, held, size = make_client(), [], 0
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"status_code": "Int64"})
        for batch in batches:
            for url, delay in zip(batch["url"], batch["delay"], strict=True):
                if (got := one(client, url, None if pd.isna(delay) else delay)) is not None:
                    held.append(got)
                    size += sum(len(x) for x in got if isinstance(x, bytes))
                if size > HELD_BYTES or len(held) >= HELD_ROWS:
                    yield frame(held)
                    held, size = [], 0
        yield frame(held)

    return rows.mapInPandas(work, schema)


def ask(urls: DataFrame, make_client: Callable[[], Client] = Client) -> DataFrame:
    """ASKED: a row for each of ``urls`` (url; delay, if there is one), with a successful response or with an error."""

    def one(client: Client, url: str, delay: float | None) -> tuple:
        got = client.ask(url, delay)
        if isinstance(got, str):
            return (url, None, None, None, None, None, got)
        if got.status >= 400:
            return (url, got.status, None, None, got.url, None, f"status {got.status}")
        return (url, got.status, got.headers.get("content-type", ""), got.headers.get("x-robots-tag"), got.url, got.body, None)

    return _by_host(urls, one, make_client, ASKED)


def fetched(asked: DataFrame) -> DataFrame:
    """FETCHED: the responses among rows of ``ask``."""
    return asked.filter("error IS NULL").drop("error")


def fetch(urls: DataFrame, make_client: Callable[[], Client] = Client) -> DataFrame:
    """FETCHED: a row for each of ``urls`` (url; delay, if there is one) that was fetched; urls that failed have none."""
    return fetched(ask(urls, make_client))


def check_status(urls: DataFrame, make_client: Callable[[], Client] = Client) -> DataFrame:
    """Status rows for urls that went missing; those that gave no answer have null statuses."""
    return _by_host(urls, lambda client, url, delay: status_of(url, client.ask(url, delay)), make_client, STATUS)
