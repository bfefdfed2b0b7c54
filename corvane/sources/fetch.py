"""Fetching from the filing archive: rate limit, retries and addresses, with a transport that the caller gives.

A transport is a function (url, headers) -> :class:`Response`; nothing here opens a connection by itself.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: The hosts, the rate that they allow, and the answers after which a request is worth repeating.
WWW, DATA = "https://www.sec.gov", "https://data.sec.gov"
RATE, CEILING = 8.0, 10.0
AGAIN = frozenset({429, 500, 502, 503, 504})


class TransportError(Exception):
    """A connection that failed."""


class FetchError(RuntimeError):
    """An answer that is an error, or the last of several."""


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


Transport = Callable[[str, dict[str, str]], Response]


class TokenBucket:
    """At most ``rate`` calls for each ``interval`` seconds; ``rate`` calls may come at once after a rest."""

    def __init__(self, rate: float, interval: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or interval <= 0:
            raise ValueError("rate and interval must be positive")
        self.rate, self.speed, self.clock, self.sleep = rate, rate / interval, clock, sleep
        self.left, self.at, self.lock = float(rate), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:  # held while it sleeps, so that calls keep their order
            now = self.clock()
            self.left, self.at = min(self.rate, self.left + (now - self.at) * self.speed), now
            if self.left < 1:
                wait = (1 - self.left) / self.speed
                self.sleep(wait)
                self.left, self.at = 1.0, self.at + wait
            self.left -= 1


def retrying(get: Callable[[], Response], attempts: int = 5, least: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Response:
    """Repeats after a failed connection or an answer of ``AGAIN``, after pauses that double; other errors end at once."""
    if attempts <= 0:
        raise ValueError("attempts must be positive")
    for k in range(attempts):
        try:
            found = get()
            if found.status < 400:
                return found
            why: Exception = FetchError(f"status {found.status}")
            if found.status not in AGAIN:
                raise why
        except TransportError as e:
            why = e
        if k + 1 < attempts:
            sleep(min(most, least * 2**k))
    raise FetchError(f"gave up after {attempts} attempts: {why}") from why


def padded(cik: str) -> str:
    return cik.strip().zfill(10)


def document_url(cik: str, accession_number: str, primary_document: str) -> str:
    bare = cik.strip().lstrip("0")
    if not bare:
        raise ValueError(f"no company number: {cik!r}")
    if not accession_number.strip() or not primary_document.strip():
        raise ValueError("accession number and document must not be empty")
    return f"{WWW}/Archives/edgar/data/{bare}/{accession_number.replace('-', '')}/{primary_document}"


class Archive:
    """The three requests of the archive."""

    def __init__(self, transport: Transport, user_agent: str, rate: float = RATE, attempts: int = 5, sleep: Callable[[float], None] = time.sleep):
        if not user_agent.strip():
            raise ValueError("the archive wants a user agent")
        if not 0 < rate <= CEILING:
            raise ValueError(f"rate must be above 0 and at most {CEILING:g}")
        self.transport, self.headers, self.attempts, self.sleep = transport, {"User-Agent": user_agent}, attempts, sleep
        self.bucket = TokenBucket(rate, sleep=sleep)

    def _get(self, url: str) -> Response:
        def once() -> Response:
            self.bucket.take()
            return self.transport(url, self.headers)

        return retrying(once, self.attempts, sleep=self.sleep)

    def company_tickers(self) -> dict:
        return json.loads(self._get(f"{WWW}/files/company_tickers.json").body)

    def submissions(self, cik: str) -> dict:
        return json.loads(self._get(f"{DATA}/submissions/CIK{padded(cik)}.json").body)

    def primary_document(self, cik: str, accession_number: str, primary_document: str) -> tuple[bytes, str, str]:
        """(body, content type, address)."""
        url = document_url(cik, accession_number, primary_document)
        found = self._get(url)
        kinds = {k.lower(): v for k, v in found.headers.items()}
        return found.body, kinds.get("content-type", "application/octet-stream"), url


FETCHED = "filing_id long, cik string, body binary, content_type string, source_url string, error string"


def bodies(filings: DataFrame, make: Callable[[], Archive]) -> DataFrame:
    """(filing_id, cik, body, content_type, source_url, error) of ``filings`` (id, cik, accession_number,
    primary_document).  All go through one task, as one limiter serves the whole archive; an error ends its row only.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = make()
        for part in parts:
            out = []
            for f in part.itertuples(index=False):
                try:
                    out.append((f.id, f.cik, *archive.primary_document(f.cik, f.accession_number, f.primary_document), None))
                except Exception as e:  # any failure is the row's own
                    out.append((f.id, f.cik, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FETCHED.split(", ")])

    return filings.select("id", "cik", "accession_number", "primary_document").coalesce(1).mapInPandas(run, FETCHED)
