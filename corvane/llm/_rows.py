"""Rules that several queries share: word counts, hold-out remainders and exact batches."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the contracts.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id has the remainder of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``taken`` (of any case) has it."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        out.append(name)
    return out
