"""Fetching of listed pages over HTTP: one host's pages one after the other with a pause, hosts beside one another."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from http.client import HTTPException
from urllib.parse import urlsplit
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The page types that are taken, what is asked for, and the shortest pause between two requests to a host.
TYPES = ("text/html", "text/plain")
ACCEPT = "text/html,text/plain;q=0.9,*/*;q=0.1"
LEAST_DELAY = 1.0
PAGE = "url string, final_url string, content_type string, status string, error string, body binary, html string"

#: What a request may end in that concerns its page alone; URLError is an OSError.
FAILURES = (OSError, ValueError, HTTPException)

#: A response: (body, content type with its parameters, final URL).
Response = tuple[bytes, str, str]


def http_get(url: str, user_agent: str, timeout: float = 60.0) -> Response:
    """A page as it comes: its bytes, Content-Type and the URL it came from in the end."""
    with urlopen(Request(url, headers={"User-Agent": user_agent, "Accept": ACCEPT}), timeout=timeout) as r:  # noqa: S310  only http and https get here
        return r.read(), r.headers.get("Content-Type", ""), r.geturl()


def decoded(body: bytes, content_type: str) -> str:
    """Text by the charset that the response names, else UTF-8; bytes that do not fit are replaced."""
    named = [p.split("=", 1)[1].strip(" \"'") for p in content_type.split(";")[1:] if p.strip().lower().startswith("charset=")]
    try:
        return body.decode(named[0] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


class Politeness:
    """What one worker knows of hosts: their robots rules, read once, and when each was asked last."""

    def __init__(self, get: Callable[[str], Response], user_agent: str, delay: float):
        self.get, self.agent, self.delay = get, user_agent, delay
        self.rules: dict[str, RobotFileParser | None] = {}
        self.asked: dict[str, float] = {}

    def wait(self, host: str) -> None:
        rest = self.asked.get(host, -self.delay) + self.delay - time.monotonic()
        if rest > 0:
            time.sleep(rest)
        self.asked[host] = time.monotonic()

    def allowed(self, url: str) -> bool:
        """Whether a web address may be fetched; rules that cannot be read allow nothing."""
        try:
            parts = urlsplit(url)
        except ValueError:
            return False
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return False
        host = f"{parts.scheme}://{parts.netloc}"
        if host not in self.rules:
            self.wait(host)
            try:
                parser = RobotFileParser()
                parser.parse(self.get(f"{host}/robots.txt")[0].decode("utf-8", "replace").splitlines())
                self.rules[host] = parser
            except FAILURES:
                self.rules[host] = None
        rules = self.rules[host]
        return rules is not None and rules.can_fetch(self.agent, url)

    def page(self, url: str) -> dict:
        out = {"url": url, "final_url": None, "content_type": None, "status": "denied", "error": None, "body": None, "html": None}
        if not self.allowed(url):
            return out
        parts = urlsplit(url)
        self.wait(f"{parts.scheme}://{parts.netloc}")
        try:
            body, kind, final = self.get(url)
        except FAILURES as e:
            return out | {"status": "failed", "error": str(e) or type(e).__name__}
        out |= {"final_url": final, "content_type": kind}
        if kind.split(";")[0].strip().lower() not in TYPES:
            return out | {"status": "wrong type"}
        return out | {"status": "ok", "body": body, "html": decoded(body, kind)}


def fetch_pages(urls: DataFrame, user_agent: str, delay: float = 1.5, timeout: float = 60.0, get: Callable[[str], Response] | None = None) -> DataFrame:
    """PAGE rows of urls (url). All pages of a host go to one task, because its pause holds for the host; different hosts
    go to different tasks. Write the result to a table before using it: every evaluation fetches again."""
    if delay < LEAST_DELAY:
        raise ValueError(f"a host is left alone for {LEAST_DELAY} second between requests at least")
    ask = get or (lambda url: http_get(url, user_agent, timeout))
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polite = Politeness(ask, user_agent, delay)
        schema = pa.schema([pa.field(*(c, pa.binary() if c == "body" else pa.string())) for c in ("url", "final_url", "content_type", "status", "error", "body", "html")])
        for b in batches:
            for url in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([polite.page(url)], schema=schema)

    return urls.where("url is not null").select("url").repartition(host).mapInArrow(run, PAGE)
