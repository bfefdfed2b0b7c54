"""Removal of repeated long substrings over a run-length index.

A byte goes if some ``length``-byte string over it also starts earlier.  Every window of ``length`` bytes has one
anchor, the leftmost smallest of its ``anchor``-byte hashes; windows that are equal have equal anchors, so they meet
under the anchor's hash.  The windows of one anchor in one document form a *member*, an unbroken run of text.

1. Members travel as packed blocks (anchor, content, place), one block for each chunk of documents and part of the
   anchors.  Members that are equal in anchor and content, 128 bits of hash together, are one string of the collection
   with several places: all places but the earliest are marked whole.  A chunk folds its own before they travel.
2. The strings of an anchor that has several are fetched and indexed together
   (:class:`~corvane.llm.runindex.RunLengthIndex`): matching statistics of each against the index give, for each
   window, the earliest text position that shares it.
3. An anchor of more than ``group`` strings would overload one index; its windows meet by anchor and own hash
   instead, 128 bits together.  Nothing is left out: both ways find every shared window.

Only marks (document, start, end) come back; each document's are merged and cut from its whole text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import _blocks as B
from corvane.llm import _kernels as K
from corvane.llm import _rows as R
from corvane.llm._spark import Tables
from corvane.llm.runindex import RunLengthIndex


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 100
    anchor: int = 32
    #: Different strings of one anchor that one index takes.
    group: int = 2000
    #: Text bytes of one index, about.
    index_bytes: int = 1 << 20
    #: Text bytes of one chunk of documents, and of all text for each part of the anchors, about.
    chunk_bytes: int = 8 << 20


def _hash_all(data: np.ndarray, width: int) -> np.ndarray:
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return K.span_hashes(data, at, at + width)


def anchors(data: np.ndarray, offsets: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash) of each member; positions in ``data``."""
    hashes = _hash_all(data, config.anchor)
    windows, choice = len(data) - config.length + 1, config.length - config.anchor + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3 + (hashes[:0],)
    # sliding minimum by doubling; the left one wins ties
    best, span = np.arange(len(hashes)), 1
    while span < choice:
        step = min(span, choice - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[right] < hashes[left], right, left)
        span += step
    best = best[:windows]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    whole = np.arange(windows) + config.length <= offsets[doc + 1]
    edge = np.ones(windows, bool)
    edge[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    first = np.flatnonzero(edge & whole)
    closes = np.ones(windows, bool)
    closes[:-1] = edge[1:] | ~whole[1:]
    last = np.flatnonzero(closes & whole)
    return doc[first], first, last, hashes[best[first]]


def _members(config: RepeatConfig, parts: int):
    """Blocks of the members of each chunk of documents."""

    def run(batches):
        found, size, chunk = [], 0, 0
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
            for i, j in K.chunks(offsets):
                text, rel = data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i]
                doc, first, last, key = anchors(text, rel, config)
                if len(doc):
                    content = K.span_hashes(text, first, last + config.length).view(np.int64)
                    columns = key.view(np.int64), content, did[i + doc], th[i + doc], (first - rel[doc]).astype(np.int32), (last - rel[doc] + config.length).astype(np.int32)
                    found.append(dict(zip(B.PACKED, columns)))
                size += len(text)
                if size >= config.chunk_bytes and found:
                    yield B.packed(found, chunk, parts)
                    found, size, chunk = [], 0, chunk + 1
        if found:
            yield B.packed(found, chunk, parts)

    return run


FOUND = "mark boolean, did long, th long, lo int, hi int, key long, hot boolean"


def _strings(config: RepeatConfig):
    """Of one part: the marks, and the strings of anchors that have several (asked for, in place of marked)."""
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(blocks: pa.Table) -> pa.Table:
        kept, (did, th, lo, hi), several = B.unpacked(blocks)
        asked = np.flatnonzero(several > 1)
        n = len(did), len(asked)
        both = lambda a, c: np.concatenate([a, kept[c][asked]])
        values = [
            np.repeat([True, False], n), both(did, "did"), both(th, "th"), both(lo.astype(np.int32), "lo"), both(hi.astype(np.int32), "hi"),
            np.concatenate([np.zeros(n[0], np.int64), kept["key"][asked]]), np.concatenate([np.zeros(n[0], bool), several[asked] > config.group]),
        ]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    return run


PIECE = "did long, th long, lo long, key long, hot boolean, piece binary"


def _cut(batches):
    """The texts of the members of each document."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        did, th, spans = (batch.column(c).to_pylist() for c in ("did", "th", "spans"))
        out, size = [], 0
        for k in range(batch.num_rows):
            text = data[int(offsets[k]) : int(offsets[k + 1])].tobytes()
            for s in spans[k]:
                out.append((did[k], th[k], s["lo"], s["key"], s["hot"], text[s["lo"] : s["hi"]]))
                size += s["hi"] - s["lo"]
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


MARK = "did long, th long, start long, stop long"


def _marks(did, th, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (did, th, start, stop)], ["did", "th", "start", "stop"])


def _indexed(config: RepeatConfig):
    """Partitions sorted by anchor, document and place; a group of anchors makes an index once it is large enough."""

    def marks(rows):
        did, th, lo = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        pieces = [r[4] for r in rows]
        order = np.lexsort([lo, th, did])
        did, th, lo, pieces = did[order], th[order], lo[order], [pieces[k] for k in order]
        index = RunLengthIndex(pieces, config.length)
        who_all, at_all = [], []
        for who, offset, row, length in index.stream(pieces, np.arange(len(pieces))):
            hit = np.flatnonzero(length >= config.length)
            if not len(hit):
                continue
            who, offset = who[hit], offset[hit]
            first = index.block(row[hit])
            member = np.searchsorted(index.begins, first, "right") - 1
            earlier = (first >= 0) & (member < who)
            who_all.append(who[earlier])
            at_all.append(offset[earlier])
        if not who_all:
            return None
        who, at = np.concatenate(who_all), np.concatenate(at_all)
        return _marks(*B.folded(did[who], th[who], lo[who] + at, lo[who] + at + config.length)) if len(who) else None

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "did", "th", "lo", "piece"))):
                if rows and row[0] != rows[-1][0] and size >= config.index_bytes:
                    found = marks(rows)
                    if found is not None:
                        yield found
                    rows, size = [], 0
                if rows and row[:4] == rows[-1][:4]:
                    continue  # an equal row's member
                rows.append(row)
                size += len(row[4])
        found = marks(rows) if rows else None
        if found is not None:
            yield found

    return run


def _windows(config: RepeatConfig):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("piece"))
            did, th, lo, key = (batch.column(c).to_numpy() for c in ("did", "th", "lo", "key"))
            for i, j in K.chunks(offsets):
                part, rel = data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i]
                n = np.maximum(np.diff(rel) - config.length + 1, 0)
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + rel[which]
                h = K.span_hashes(part, at, at + config.length).view(np.int64)
                columns = did[i + which], th[i + which], lo[i + which] + at - rel[which], key[i + which], h
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["did", "th", "lo", "key", "h"])

    return run


def _fold(batches):
    """Merges each batch's marks of a document before they travel."""
    for batch in batches:
        if batch.num_rows:
            yield _marks(*B.folded(*(batch.column(c).to_numpy() for c in ("did", "th", "start", "stop"))))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def marks(docs: DataFrame, tables: Tables, config: RepeatConfig) -> DataFrame:
    """(did, th, spans): the spans to remove of each document that has any; ``docs`` has did, th and text."""
    length = config.length
    where = F.struct("did", "th", "lo")
    docs = docs.where(F.octet_length("text") >= length).select("did", "th", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // config.chunk_bytes))
    # an anchor's part has one entry at most for each string and chunk
    blocks = docs.mapInArrow(_members(config, parts), B.BLOCK)
    found = tables.write(blocks.groupBy("part").applyInArrow(_strings(config), FOUND))
    copies = found.where("mark").select("did", "th", F.col("lo").cast("long").alias("start"), F.col("hi").cast("long").alias("stop"))
    asked = found.where("not mark").groupBy("did", "th").agg(F.collect_list(F.struct("lo", "hi", "key", "hot")).alias("spans"))  # as long as the document at most
    cut = tables.write(docs.join(asked, ["did", "th"]).mapInArrow(_cut, PIECE))
    size = cut.where("not hot").agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    tasks = max(1, -(-int(size) // (4 * config.index_bytes)))
    indexed = cut.where("not hot").drop("hot").repartition(tasks, "key").sortWithinPartitions("key", "did", "th", "lo").mapInArrow(_indexed(config), MARK)
    windows = cut.where("hot").mapInArrow(_windows(config), "did long, th long, lo long, key long, h long")
    first = windows.groupBy("key", "h").agg(F.min(where).alias("e"), F.count("*").alias("n")).where("n > 1")
    plain = windows.join(first, ["key", "h"]).where(where != F.col("e")).select("did", "th", F.col("lo").alias("start"), (F.col("lo") + length).alias("stop"))
    every = copies.unionByName(indexed).unionByName(plain.mapInArrow(_fold, MARK))
    out = tables.write(every.groupBy("did", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    tables.drop(found, cut)
    return out


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """``docs`` with removed (the spans, in bytes), n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256.

    ``docs`` has doc_id and text; its other columns stay, and columns of these six names are replaced.  A null text
    is empty.  Order is by doc_id, then by a hash of the text where ids are equal, null ids last; rows that are equal
    in both are one document with one result each.  Texts shorter than ``length`` keep all bytes.  An empty table gives
    an empty result.
    """
    tables = Tables(docs.sparkSession, "repeats")
    added = ["removed", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    docs = docs.drop(*added)
    did, th, spans = R.fresh(docs.columns, "did", "th", "spans")
    keyed = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(th, F.xxhash64("text"))
    found = marks(keyed.select(F.col(did).alias("did"), F.col(th).alias("th"), "text"), tables, config)

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            gone_of = batch.column(spans)
            out: list = []
            for k in range(batch.num_rows):
                text = data[int(offsets[k]) : int(offsets[k + 1])].tobytes()
                gone = merged([(s["start"], s["stop"]) for s in gone_of[k].as_py() or []])
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append(([{"start": a, "stop": b} for a, b in gone], len(text), len(text) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            if out:
                types = [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), *[pa.int64()] * 3, pa.binary(), pa.string()]
                rest = [n for n in batch.schema.names if n != spans]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *(pa.array(c, t) for c, t in zip(zip(*out), types))], [*rest, *added])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    extra = "removed array<struct<start:long,stop:long>>, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    found = found.select(F.col("did").alias(did), F.col("th").alias(th), F.col("spans").alias(spans))
    return keyed.join(found, [did, th], "left").select(*docs.columns, spans).mapInArrow(run, f"{columns}, {extra}")


@F.pandas_udf(T.StringType())
def whole_characters(kept: pd.Series) -> pd.Series:
    """The text of UTF-8 bytes, without bytes that are no whole character."""
    return kept.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")
