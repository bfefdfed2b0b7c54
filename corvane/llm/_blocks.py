"""Strings and their places as packed blocks: what finds repeats moves few large rows in place of many small ones.

A *string* is named by two 64-bit hashes (key, content) and stands at a *place* (did, th, lo, hi): document, hash of
its text, and a span.  Each task folds the strings of a chunk of documents, so that one string has one entry for each
chunk at most, and deals the rest out by key in one block for each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A block's columns, and how they are packed: strings have all, marks no key and content.
PACKED = {"key": np.int64, "content": np.int64, "did": np.int64, "th": np.int64, "lo": np.int32, "hi": np.int32}
BLOCK = "part int, mark boolean, " + ", ".join(f"{c} binary" for c in PACKED)


def _block(part: int, mark: bool, columns: dict[str, np.ndarray]) -> list:
    return [part, mark, *(columns[c].astype(kind).tobytes() if c in columns else b"" for c, kind in PACKED.items())]


def folded(did: np.ndarray, th: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """The marks with those of a document that touch or overlap made one."""
    if not len(did):
        return did, th, start, stop
    order = np.lexsort([start, th, did])
    did, th, start, stop = did[order], th[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    group = np.ones(len(did), bool)
    group[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1])
    lift = np.cumsum(group) * (int(stop.max()) + 1)  # a running maximum that restarts with each document
    reach = np.maximum.accumulate(stop + lift)
    new = group.copy()
    new[1:] |= start[1:] + lift[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    close = np.append(begin[1:], len(did)) - 1
    return did[begin], th[begin], start[begin], reach[close] - lift[close]


def fold(m: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """(the earliest place of each string, the other places, how many strings have the key of each of the first)."""
    order = np.lexsort([m["lo"], m["th"], m["did"], m["content"], m["key"]])
    m = {c: x[order] for c, x in m.items()}
    key = np.ones(len(order), bool)
    key[1:] = m["key"][1:] != m["key"][:-1]
    string = key.copy()
    string[1:] |= m["content"][1:] != m["content"][:-1]
    # places that are equal too are one place: rows of one id and text
    place = string.copy()
    for c in ("did", "th", "lo"):
        place[1:] |= m[c][1:] != m[c][:-1]
    first = np.flatnonzero(string)
    several = np.bincount(np.cumsum(key)[first] - 1)
    other = place & ~string
    return {c: x[first] for c, x in m.items()}, {c: x[other] for c, x in m.items()}, np.repeat(several, several)


def packed(found: list[dict[str, np.ndarray]], chunk: int, parts: int) -> pa.RecordBatch:
    """The blocks of a chunk's strings, and one of the places that the chunk itself folds."""
    kept, others, _ = fold({c: np.concatenate([f[c] for f in found]) for c in PACKED})
    part = (kept["key"].view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    blocks = [_block(p, False, {c: x[order[a:b]] for c, x in kept.items()}) for p, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
    marks = folded(*(others[c] for c in ("did", "th", "lo", "hi")))
    if len(marks[0]):
        blocks.append(_block(chunk % parts, True, dict(zip(("did", "th", "lo", "hi"), marks))))
    types = [pa.int32(), pa.bool_(), *[pa.binary()] * len(PACKED)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), types)], ["part", "mark", *PACKED])


def unpacked(blocks: pa.Table) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...], np.ndarray]:
    """Of one part: (the earliest places, the marks (did, th, lo, hi) of all others, how many strings a key has)."""

    def column(rows: pa.Table, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), PACKED[name])

    marked = blocks.column("mark").to_numpy()
    strings, old = blocks.filter(pa.array(~marked)), blocks.filter(pa.array(marked))
    kept, others, several = fold({c: column(strings, c) for c in PACKED})
    return kept, folded(*(np.concatenate([others[c], column(old, c)]) for c in ("did", "th", "lo", "hi"))), several
