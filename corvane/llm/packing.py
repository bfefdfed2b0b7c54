"""Best-fit packing by exact complements.

A document's ids are cut from its end, so only the first piece can be shorter than a sequence.  The plan needs no
more than the count of pieces of each length, a table of at most ``length`` rows: the longest piece left opens a
sequence; a single piece, a pair or a triple that fills its gap exactly is consumed under the counts, and where there
is none the best fitting piece narrows the gap.  Steps that repeat are taken for all their counts at once, so the plan
is a short list of (lengths, repeats) whatever the corpus holds.  Pairs and triples can eat the small pieces that later
gaps need, so the plan is made for several reaches and the one with the fewest sequences counts, plain best fit among
them.

Pieces find their places by their rank among pieces of equal length: partition-local ranks plus prefix sums of
(partition, length) counts.  No piece list is gathered anywhere, and a worker remembers no words between texts.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import _rows as R
from corvane.llm._spark import Tables


@dataclass(frozen=True)
class PackingConfig:
    #: Path of a tokenizer file that every executor can read, and the id that ends each document.
    tokenizer: str
    end_id: int = 2
    length: int = 1024
    #: Texts of about this many characters make one batch of rows.
    batch_chars: int = 1 << 20


#: How byte-level BPE vocabularies of this kind split a text before merging, and the characters for
#: which every Unicode version and every pattern dialect agree on that.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_AGREED = re.compile("[\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027\u2030-\u203e]*")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the
    others follow from code point 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as arrays of 32-bit numbers.

    If the tokenizer is a byte-level BPE whose ids follow the order of its merges, its vocabulary also drives a
    faster BPE coder, for texts of the characters ``_AGREED`` without a special token; all others, and other
    tokenizers, are encoded by the tokenizer itself.
    """

    def __init__(self, config: PackingConfig):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(config.tokenizer)
        with open(config.tokenizer, encoding="utf-8") as f:
            made = json.load(f)
        special = [re.escape(x["content"]) for x in made.get("added_tokens") or []]
        self.special = re.compile("|".join(special) or "(?!)")
        self.fast = self._fast(made)

    @staticmethod
    def _fast(made: dict):
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        if (
            split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space")
            or model["type"] != "BPE" or model.get("dropout") or made.get("normalizer") is not None
        ):
            return None
        import tiktoken

        byte, special = _byte_of(), {x["content"] for x in made.get("added_tokens") or []}
        ids = {t: i for t, i in model["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [ids.get(a + b) for a, b in pairs]
        if None in order or order != sorted(set(order)) or not all(c in byte for t in ids for c in t):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in ids.items()}
        if any(bytes([b]) not in ranks for b in range(256)) or max(ranks[bytes([b])] for b in range(256)) > min(order, default=1 << 31):
            return None
        return tiktoken.Encoding("from_file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or not _AGREED.fullmatch(text) or self.special.search(text):
            return self.whole(text)
        return np.frombuffer(self.fast.encode_to_tiktoken_buffer(text, set()), "=u4").astype("<u4", copy=False)


@lru_cache(maxsize=1)
def encoder(config: PackingConfig) -> Encoder:
    """The encoder of a worker, kept from task to task; it holds the vocabulary and nothing of the texts."""
    return Encoder(config)


def _pair(left: np.ndarray, gap: int, most: int, even: bool) -> tuple[int, ...]:
    """Two lengths of ``left`` whose sum is ``gap``, the larger of at most ``most``: the least even two, or the most."""
    x = np.arange(min(most, gap - 1), (gap + 1) // 2 - 1, -1)
    there = np.flatnonzero((left[x] > 0) & (left[gap - x] > (2 * x == gap)))
    if not len(there):
        return ()
    k = x[there[-1 if even else 0]]
    return int(k), int(gap - k)


def _complement(left: np.ndarray, gap: int, reach: int, even: bool) -> tuple[int, ...]:
    """Up to ``reach`` lengths that fill ``gap`` exactly."""
    if left[gap]:
        return (gap,)
    found = _pair(left, gap, gap, even) if reach > 1 else ()
    if found or reach < 3:
        return found
    for x in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if left[x]:
            left[x] -= 1
            found = _pair(left, gap - x, x, even)
            left[x] += 1
            if found:
                return (x, *found)
    return ()


def _fill(counts: dict[int, int], length: int, reach: int, even: bool, floor: int) -> list[tuple[tuple[int, ...], int]]:
    """One plan; below ``floor`` an opening piece takes single complements only."""
    left = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out: list[tuple[tuple[int, ...], int]] = []
    for a in range(length, 0, -1):
        while left[a]:
            free, found, gap = left.copy(), [a], length - a
            free[a] -= 1
            while gap:
                exact = _complement(free, gap, reach if a >= floor else 1, even)
                fits = exact or tuple(np.flatnonzero(free[: gap + 1])[-1:].tolist())
                if not fits:
                    break
                for x in fits:
                    free[x] -= 1
                    found.append(x)
                    gap -= x
            uses = {x: found.count(x) for x in found}
            n = int(min(left[x] // k for x, k in uses.items()))
            for x, k in uses.items():
                left[x] -= k * n
            out.append((tuple(found), n))
    return out


def plan(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """[(piece lengths of a sequence, how many such sequences)] that use up ``counts``, the shortest of several."""
    ways = [(1, False, 0)] + [(reach, even, length * part // 16) for reach in (2, 3) for even in (False, True) for part in (0, 8, 11, 14)]
    return min((_fill(counts, length, *way) for way in ways), key=lambda made: sum(n for _, n in made))


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset, 1), in order of rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return {x: np.array(r, np.int64) for x, r in rows.items()}


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """One row for each piece, with its partition and its place among that partition's pieces of its length."""

    def run(batches):
        encode = encoder(config)
        part, seen, end_id = TaskContext.get().partitionId(), np.zeros(config.length + 1, np.int64), np.array([config.end_id], "<u4")
        names = [x.split()[0] for x in PIECE.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            out, size, texts = [], 0, batch.column("text")
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[k].as_py() or ""  # one text at a time: only its ids are held
                ids = np.concatenate([encode(text), end_id])
                raw, start = ids.tobytes(), 0
                for piece, end in enumerate(range((len(ids) - 1) % config.length + 1, len(ids) + 1, config.length)):
                    n = end - start
                    out.append((doc_id, piece, start, n, R.crc(raw[4 * start : 4 * end]), part, int(seen[n])))
                    seen[n] += 1
                    start = end
                size += len(text)
                if size >= config.batch_chars:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def pack(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    Null texts count as empty and give one piece, the end id.  Repeated rows are packed each; an empty table gives
    no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    cut = tables.write(pieces(docs, config))
    each = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = tables.write(each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    places = spark.sparkContext.broadcast(_places(plan(counts, config.length)))

    def settle(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("place").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                table = places.value[int(x)]
                k = np.searchsorted(table[:, 0], rank[here], "right") - 1
                sequence[here], offset[here] = table[k, 1] + rank[here] - table[k, 0], table[k, 2]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # a partition x length table grows with the input: it is shuffled, never broadcast
    ranked = cut.join(each.drop("n").hint("merge"), ["part", "length"])
    return ranked.mapInArrow(settle, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
