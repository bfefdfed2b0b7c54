"""AND matches and their cover density over Arrow batches of chunks, for a block of queries at a time.

A block holds its queries' distinct sets of lexemes.  A task tokenises its chunks once, stems the words that it has not
met yet, and meets all sets in numpy: which chunks hold all lexemes of a set, how often, and in which minimal covers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.functions import stem

_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Byte by byte, A-Z become a-z and what is no part of a token a blank.
_BLANKED = bytes(x if (x := ord(chr(c).lower()) if c < 128 else c) in _LETTERS else 32 for c in range(256))
#: Distinct tokens, cells of a chunk-by-set table, hits in covers, and scored pairs that a task holds at a time.
TOKENS, CELLS, HITS, PAIRS = 300_000, 1 << 22, 1 << 18, 1 << 17
#: Most chunks of one table, and bytes of text after which no other chunk is tokenised with these.
CHUNKS, TEXT = 128, 1 << 20


def _blanked(text: str) -> bytes:
    """The lower-case text with blanks between its tokens."""
    return (text if text.isascii() else text.lower()).encode().translate(_BLANKED)


def words(text: str) -> list[bytes]:
    """The same as ``functions.text.tokens``: runs of ``[a-z0-9]`` in the lower-case text."""
    return _blanked(text).split()


def tokens(text: str) -> list[str]:
    return [w.decode("ascii") for w in words(text)]


def distinct_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of a task's texts (column text); a token comes again where there are very many."""
    seen: set[str] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                seen.update(tokens(text))
            if len(seen) >= TOKENS:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["token"])
                seen = set()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["token"])


class _Met(dict):
    """The codes of the tokens that a task has met; a new one is stemmed."""

    def __init__(self, block: Block):
        super().__init__()
        self.stop, self.lexemes = block.stop, block.lexemes

    def __missing__(self, token: str) -> int:
        code = self[token] = -1 if token in self.stop else self.lexemes.get(stem.stem(token), -1)
        return code


#: Letters and digits from 1; and three of them as one number, 0 where there is none.
_NUMBER = np.zeros(256, np.int64)
_NUMBER[sorted(_LETTERS)] = np.arange(1, 37)


def _three(words) -> np.ndarray:
    """By the number of three letters, whether ``words`` of at most three have them."""
    out = np.zeros(37**3, bool)
    for w in words:
        a, b, c = (int(_NUMBER[ord(x)]) for x in w) if len(w) == 3 else ([int(_NUMBER[ord(x)]) for x in w] + [0, 0, 0])[:3]
        out[(a * 37 + b) * 37 + c] = True
    return out


_STARTS, _ENDS = _three(stem.CUT_STARTS), _three(stem.CUT_ENDS)
_FACTOR, _SPREAD, _OTHER, _BITS = 1_000_003, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 20
#: The first n bytes of eight, as a number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _slots(number: np.ndarray) -> np.ndarray:
    return (number.astype(np.uint64) * _SPREAD) >> np.uint64(64 - _BITS)


class _Sieve:
    """Leaves out words that no lexeme can come of, by their beginnings (``stem.heads``), which are hashed, and their ends."""

    def __init__(self, lexemes):
        heads = {h for x in lexemes for h in stem.heads(x)} | set(stem.OWN)
        self.longest = max(map(len, heads))
        number = np.zeros(len(heads), np.int64)
        for i, h in enumerate(heads):
            n = 0
            for x in h:
                n = (n * _FACTOR + int(_NUMBER[ord(x)])) & (1 << 63) - 1
            number[i] = n
        self.held = np.zeros(1 << _BITS, bool)
        self.held[_slots(number)] = True

    def passed(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of the words that pass, among those that begin at ``start``."""
        x = np.concatenate([_NUMBER[letters], np.zeros(3, np.int64)])
        out, last = np.zeros(len(start), bool), start + size
        tail = (x[last - 3] * 37 + x[last - 2]) * 37 + x[last - 1]  # of no use, and not used, where a word is shorter
        alive, number = np.arange(len(start)), np.zeros(len(start), np.int64)
        for k in range(1, self.longest + 1):
            more = size[alive] >= k
            alive, number = alive[more], number[more]
            number = (number * _FACTOR + x[start[alive] + k - 1]) & (1 << 63) - 1
            some = alive[self.held[_slots(number)]]
            at, rest = start[some] + k, size[some] - k
            a, b, c = (np.where(rest > j, x[at + j], 0) for j in range(3))
            out[some[_STARTS[(a * 37 + b) * 37 + c] & ((rest < 3) | _ENDS[tail[some]])]] = True
        return np.flatnonzero(out)


class Block:
    """Queries (qid, day, lexemes) by their sets of lexemes."""

    def __init__(self, rows: list[tuple[int, int, tuple[str, ...]]], stop: tuple[str, ...] = ()):
        self.stop = frozenset(stop)
        self.lexemes = {x: i for i, x in enumerate(sorted({x for _, _, t in rows for x in t}))}
        rows = sorted(rows, key=lambda r: r[2])
        sets = sorted({t for _, _, t in rows})
        number = {t: i for i, t in enumerate(sets)}
        self.qid, self.day = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.m = np.array([len(t) for t in sets], np.int64)
        self.count = np.bincount([number[r[2]] for r in rows], minlength=len(sets))  # queries of a set, which stand together
        self.first = np.cumsum(self.count) - self.count
        self.latest = np.maximum.reduceat(self.day, self.first)
        wide = int(self.m.max())
        self.members = np.array([[self.lexemes[t[min(j, len(t) - 1)]] for j in range(wide)] for t in sets], np.int64)
        self.sieve = _Sieve(self.lexemes)
        self.met: dict[str, int] | None = None
        self.kept: tuple[np.ndarray, ...] | None = None

    def coded(self, text: str) -> list[int]:
        """The codes of a text's tokens, in order; -1 for those that stand for no lexeme here."""
        return self.encoded([text])[0].tolist()

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, sizes): those of all texts' tokens, and how many tokens each text has.

        The codes of words of at most 16 letters are kept by these letters as two numbers, one word to a slot; the words
        that are not there are met, each distinct one once.
        """
        if self.met is None or len(self.met) >= TOKENS:
            self.met = _Met(self)
        if self.kept is None:
            self.kept = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.int32)
        raw = [_blanked(text) if text else b"" for text in texts]
        flat = np.frombuffer(b" ".join([b"", *raw, b" " * 16]), np.uint8)
        held = flat != 32
        edges = np.flatnonzero(held[1:] != held[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        sizes = np.diff(np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in raw)])))
        size = end - start
        eights = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))
        low, high = eights[start] & _MASKS[np.minimum(size, 8)], eights[np.minimum(start + 8, len(eights) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]
        slot = ((low ^ high * _OTHER) * _SPREAD) >> np.uint64(64 - _BITS)
        lows, highs, codes = self.kept
        code = codes[slot].astype(np.int64)
        new = np.flatnonzero((lows[slot] != low) | (highs[slot] != high) | (size > 16))
        if len(new):
            code[new] = self._met_now(flat, start[new], size[new])
            short = new[size[new] <= 16]
            at, first = np.unique(slot[short], return_index=True)
            lows[at], highs[at], codes[at] = low[short[first]], high[short[first]], code[short[first]]
        return code, sizes

    def _met_now(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The codes of the words at these places; each distinct word is sieved, and met if it passes."""
        offsets = np.concatenate([[0], np.cumsum(size)])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(flat[_spread(start, size)[1]])).dictionary_encode()
        met = np.full(len(words.dictionary), -1)
        _, offsets, letters = words.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(met) + 1)
        places = self.sieve.passed(np.frombuffer(letters, np.uint8, offsets[-1]), offsets[:-1], np.diff(offsets))
        met[places] = np.fromiter(map(self.met.__getitem__, words.dictionary.take(pa.array(places, pa.int64())).to_numpy(zero_copy_only=False)), np.int64, len(places))
        return met[words.indices.to_numpy()]

    def chunks_at_once(self) -> int:
        return max(1, min(CHUNKS, CELLS // max(len(self.qid), len(self.lexemes))))


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 decimals; halves, as written out, go up, as SQL's round has it."""
    scaled = x * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    close = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    if len(close):
        values, back = np.unique(x[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values])[back]
    return out


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places start, start + 1, .. of each row, as many as its count."""
    return np.repeat(np.arange(len(count)), count), np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


class _Table:
    """The places of a block's lexemes in a few chunks."""

    def __init__(self, block: Block, code: np.ndarray, sizes: np.ndarray, days: np.ndarray):
        self.block, self.n = block, len(sizes)
        held = np.flatnonzero(code >= 0)
        end = np.cumsum(sizes)
        count = np.diff(np.searchsorted(held, end), prepend=0)
        chunk = np.repeat(np.arange(self.n), count)
        self.places, self.key = held + 1 - np.repeat(end - sizes, count), code[held] * self.n + chunk
        self.tally = np.bincount(self.key, minlength=len(block.lexemes) * self.n)
        has = (self.tally > 0).reshape(-1, self.n)
        both = block.latest[:, None] >= days[None, :]
        for j in range(block.members.shape[1]):
            both &= has[block.members[:, j]]
        self.set, self.chunk = np.nonzero(both)

    @cached_property
    def start(self) -> np.ndarray:
        """Where the places of each lexeme in each chunk begin."""
        return np.cumsum(self.tally) - self.tally

    @cached_property
    def pos(self) -> np.ndarray:
        """All places, by lexeme, chunk and place."""
        bits = np.uint64(int(self.places.max(initial=0)).bit_length())
        if int(self.key.max(initial=0)).bit_length() + int(bits) > 63:
            return self.places[np.argsort(self.key, kind="stable")]
        both = self.key.astype(np.uint64) << bits | self.places.astype(np.uint64)  # sorting one number is much faster than two
        both.sort()
        return (both & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)

    def cells(self, rows, j: int) -> np.ndarray:
        return self.block.members[self.set[rows], j] * self.n + self.chunk[rows]

    def hits(self) -> np.ndarray:
        m, out = self.block.m[self.set], np.zeros(len(self.set), np.int64)
        for j in range(self.block.members.shape[1]):
            rows = np.flatnonzero(m > j)
            out[rows] += self.tally[self.cells(rows, j)]
        return out

    def keep(self, least: np.ndarray) -> None:
        """Leaves out the pairs that cannot have their set's least score.

        A cover gives 0.1 at most.  Each ends at another hit, after m - 1 at least; each holds a place of the rarest lexeme,
        and one place is in m minimal covers at most, as a later cover has one lexeme more behind it.
        """
        m = self.block.m[self.set]
        fewest = self.tally[self.cells(slice(None), 0)]
        for j in range(1, self.block.members.shape[1]):
            fewest = np.minimum(fewest, self.tally[self.cells(slice(None), j)])
        most = 0.1 * np.minimum(m * fewest, self.hits() - m + 1)
        rows = np.flatnonzero(most + 2e-6 >= least[self.set])
        self.set, self.chunk = self.set[rows], self.chunk[rows]

    def density(self) -> np.ndarray:
        """Sum over the minimal covers of ``0.1 / (1 + noise)``, in their order."""
        m, hits = self.block.m[self.set], self.hits()
        out = np.zeros(len(m))
        one = m == 1  # each hit is a cover
        if one.any():
            out[one] = np.cumsum(np.full(hits[one].max(), 0.1))[hits[one] - 1]
        for k in np.unique(m[~one]):
            many = np.flatnonzero(m == k)
            group = (np.cumsum(hits[many]) - 1) // HITS
            for rows in np.split(many, np.flatnonzero(np.diff(group)) + 1):
                out[rows] = self._covers(rows, int(k))
        return out

    def _covers(self, rows: np.ndarray, m: int) -> np.ndarray:
        """The sums of pairs whose sets have ``m`` lexemes, two at least."""
        parts, hits = [], np.zeros(len(rows), np.int64)
        for j in range(m):
            cells = self.cells(rows, j)
            pair, place = _spread(self.start[cells], self.tally[cells])
            parts.append((pair, self.pos[place]))
            hits += self.tally[cells]
        wide, high = (m - 1).bit_length(), int(self.pos.max()).bit_length()
        if len(rows).bit_length() + high + wide < 63:  # sorting one number is much faster than two
            key = np.concatenate([(pair << high | pos) << wide | j for j, (pair, pos) in enumerate(parts)])
            key.sort()
            k, pos = key & (1 << wide) - 1, key >> wide & (1 << high) - 1
        else:
            k = np.repeat(np.arange(m), [len(pos) for _, pos in parts])
            pair, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort([pos, pair])
            pos, k = pos[order], k[order]
        first = np.cumsum(hits) - hits  # of the pair's own hits
        if m == 2:  # two hits side by side of different lexemes
            ends = k[1:] != k[:-1]
            ends[first[1:] - 1] = False
            s = np.flatnonzero(ends)
            e = s + 1
        else:
            i = np.arange(len(k))
            low = np.maximum.accumulate(np.where(k == 0, i, -1))
            for j in range(1, m):
                np.minimum(low, np.maximum.accumulate(np.where(k == j, i, -1)), out=low)
            ends = low >= np.repeat(first, hits)  # and the earliest of the last places moves here
            ends[1:] &= low[1:] > low[:-1]
            e = np.flatnonzero(ends)
            s = low[e]
        return np.bincount(np.searchsorted(first, e, "right") - 1, weights=0.1 / (1 + pos[e] - pos[s] - (e - s)), minlength=len(rows))


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about TEXT bytes of text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _tables(block: Block, batches: Iterator[pa.RecordBatch]):
    """(table, chunk ids, days) of a few chunks at a time."""
    n = block.chunks_at_once()
    for batch in batches:
        for part in _together(batch):
            code, sizes = block.encoded(part.column("text").to_pylist())
            end = np.cumsum(sizes)
            ids, days = part.column("chunk_id").to_numpy(), part.column("day").to_numpy()
            for at in range(0, part.num_rows, n):
                some = slice(at, at + n)
                yield _Table(block, code[end[at] - sizes[at] : end[some][-1]], sizes[some], days[some]), ids[some], days[some]


def _queries(block: Block, table: _Table, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, query) for the queries of a pair's set that are not dated before its chunk."""
    pair, q = _spread(block.first[table.set], block.count[table.set])
    fits = block.day[q] >= days[table.chunk[pair]]
    return pair[fits], q[fits]


def counted(shared) -> Callable:
    """(qid, chunk_id, m, n_hits) of the matches of a broadcast block."""

    def run(batches):
        block = shared.value
        for table, ids, days in _tables(block, batches):
            hits = table.hits()
            pair, q = _queries(block, table, days)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.qid[q], ids[table.chunk[pair]], block.m[table.set[pair]], hits[pair])], ["qid", "chunk_id", "m", "n_hits"])

    return run


def ranked(shared, limit: int) -> Callable:
    """(qid, chunk_id, score): a task's best ``limit`` chunks for each query of a broadcast block, by cover density."""

    def run(batches):
        block = shared.value
        least = np.full(len(block.qid), -np.inf)  # the score that a query's best rows have at least
        kept, new, most = [], 0, PAIRS

        def best():
            q, ids, score = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort([ids, -score, q])
            q, ids, score = q[order], ids[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            full = place == limit - 1
            least[q[full]] = score[full]
            top = place < limit
            return q[top], ids[top], score[top]

        for table, ids, days in _tables(block, batches):
            table.keep(np.minimum.reduceat(least, block.first))
            score = rounded(table.density())
            pair, q = _queries(block, table, days)
            good = score[pair] >= least[q]
            pair, q = pair[good], q[good]
            kept.append((q, ids[table.chunk[pair]], score[pair]))
            new += len(q)
            if new >= most:
                kept = [best()]
                new, most = 0, max(PAIRS, len(kept[0][0]))
        if kept:
            q, ids, score = best()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.qid[q], ids, score)], ["qid", "chunk_id", "score"])

    return run
