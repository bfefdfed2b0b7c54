"""Removal of repeated text by global digests of its lines, paragraphs or sentences.

A text is cut into units, each with what separates it from the next.  Units are normalised (A-Z lower-cased, words
with one space between) and a run of units that has ``least_words`` words, each unit with words beginning one, is
hashed to 128 bits.  Digests are grouped over all documents; the earliest occurrence in the order of (doc_id, hash of
the text, place) stays, and the units of the others go.  So a passage is found wherever it stands, in a line of its own
or inside a longer one, and a short line that many documents share stays.

Digests travel as packed blocks (:mod:`corvane.llm._blocks`): a task folds those of a chunk of documents first, so that
a line that a third of all documents hold has one entry for each chunk.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _blocks as B
from corvane.llm import _rows as R
from corvane.llm._spark import Tables

#: What separates units, for each kind of unit.  Sentences end lines, or at white space after a stop.
SEPARATORS = {"line": "\n", "paragraph": "\n\n", "sentence": r"(?<=[.!?])[ \t]+|\n"}
_GAP = re.compile("[\\x20\\x09-\\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class LineConfig:
    #: "sentence", "line" (one newline) or "paragraph" (two).
    unit: str = "sentence"
    #: Words of a run of units; shorter ones are never removed by themselves.
    least_words: int = 20
    #: Text bytes of one chunk of documents, and of all text for each part of the digests, about.
    chunk_bytes: int = 8 << 20


def units(text: str, config: LineConfig) -> list[int]:
    """Where each unit begins, and the end of the text; a unit's separator belongs to it."""
    return [0, *(m.end() for m in re.finditer(SEPARATORS[config.unit], text)), len(text)]


def runs(text: str, config: LineConfig) -> list[tuple[bytes, int, int]]:
    """(digest, first unit, one past the last) of each run of units with ``least_words`` words, no longer than needed."""
    edge = units(text, config)
    low = text.translate(_LOWER)
    words = [[w for w in _GAP.split(low[a:b]) if w] for a, b in zip(edge, edge[1:])]
    out, stop, n = [], 0, 0
    for first, own in enumerate(words):
        if stop < first:
            stop, n = first, 0
        while stop < len(words) and n < config.least_words:
            n += len(words[stop])
            stop += 1
        if n < config.least_words:
            break
        if own:
            run = " ".join(w for part in words[first:stop] for w in part)
            out.append((hashlib.blake2b(run.encode("utf-8", "surrogatepass"), digest_size=16).digest(), first, stop))
        n -= len(own)
    return out


def _blocks(config: LineConfig, parts: int):
    """Blocks of the digests of each chunk of documents."""

    def arrays(found: list[tuple]) -> dict[str, np.ndarray]:
        digest, did, th, lo, hi = zip(*found)
        both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        return {"key": both[:, 0].copy(), "content": both[:, 1].copy(), "did": np.array(did, np.int64), "th": np.array(th, np.int64), "lo": np.array(lo, np.int32), "hi": np.array(hi, np.int32)}

    def run(batches):
        held, size, chunk = [], 0, 0
        for batch in batches:
            found, texts = [], batch.column("text")
            for k, (did, th) in enumerate(zip(batch.column("did").to_pylist(), batch.column("th").to_pylist())):
                text = texts[k].as_py()
                size += len(text)
                found += [(digest, did, th, lo, hi) for digest, lo, hi in runs(text, config)]
            if found:
                held.append(arrays(found))
            if size >= config.chunk_bytes and held:
                yield B.packed(held, chunk, parts)
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield B.packed(held, chunk, parts)

    return run


MARK = "did long, th long, lo long, hi long"


def _losers(blocks: pa.Table) -> pa.Table:
    _, marks, _ = B.unpacked(blocks)
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in marks], ["did", "th", "lo", "hi"])


def repeated(docs: DataFrame, tables: Tables, config: LineConfig) -> DataFrame:
    """(did, th, gone): runs of units to remove of each document that has any; ``docs`` has did, th and text."""
    docs = docs.where("text <> ''").select("did", "th", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // config.chunk_bytes))
    marks = docs.mapInArrow(_blocks(config, parts), B.BLOCK).groupBy("part").applyInArrow(_losers, MARK)
    return tables.write(marks.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")))


def _cut(config: LineConfig, names: list[str], gone: str, added: list[str]):
    types = [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), *[pa.int64()] * 3, pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            out, texts, marks = [], batch.column("text"), batch.column(gone)
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                edge, spans, n = units(text, config), [], 0
                for lo, hi in sorted((m["lo"], m["hi"]) for m in marks[k].as_py() or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
                n = sum(hi - lo for lo, hi in spans)
                cuts = [(edge[lo], edge[hi]) for lo, hi in spans]
                ends = [0, *(x for cut in cuts for x in cut), len(text)]
                kept = "".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append(([{"start": a, "stop": b} for a, b in cuts], len(edge) - 1, n, len(text) - len(kept), kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, t) for c, t in zip(zip(*out), types))], [*names, *added])

    return run


def remove_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` with removed (spans of code points in the original), n_units, n_removed, chars_removed, kept, kept_sha256.

    ``docs`` has doc_id and text; its other columns stay, and columns of these six names are replaced.  A null text is
    empty and has one unit.  A document's own repeats go too.  Order is by doc_id, null ids last, then by a hash of the
    text; rows that are equal in both are one document with one result each.  A removed unit takes the separator after
    it with it.  An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "lines")
    added = ["removed", "n_units", "n_removed", "chars_removed", "kept", "kept_sha256"]
    docs = docs.drop(*added)
    did, th, gone = R.fresh(docs.columns, "did", "th", "gone")
    keyed = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(th, F.xxhash64("text"))
    found = repeated(keyed.select(F.col(did).alias("did"), F.col(th).alias("th"), "text"), tables, config)
    found = found.select(F.col("did").alias(did), F.col("th").alias(th), F.col("gone").alias(gone))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    extra = "removed array<struct<start:long,stop:long>>, n_units long, n_removed long, chars_removed long, kept string, kept_sha256 string"
    return keyed.join(found, [did, th], "left").select(*docs.columns, gone).mapInArrow(_cut(config, docs.columns, gone, added), f"{columns}, {extra}")
