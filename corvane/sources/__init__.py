"""Landed filing metadata, fetching, and bytes by content."""

from corvane.sources.blobs import Blobs, LocalBlobs
from corvane.sources.fetch import Archive, Response, TokenBucket
from corvane.sources.filings import archive_url, lookup, resolve, tickers

__all__ = ["Archive", "Blobs", "LocalBlobs", "Response", "TokenBucket", "archive_url", "lookup", "resolve", "tickers"]
