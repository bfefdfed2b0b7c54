"""A run-length index: the Burrows-Wheeler transform of a text collection, held as runs, with suffix-array samples
at both ends of each run, and matching statistics streamed over it for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_ranks(text: np.ndarray, alive: np.ndarray, depths: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix ranks by prefix doubling, and the ranks by the first ``d`` symbols for each of ``depths``.

    ``text`` has symbols 1..255 and ends each member with 0; comparisons stop at a 0.  ``alive`` is the number of
    symbols before a suffix's 0.  Suffixes that are equal up to their 0 share a rank.
    """
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= np.where(alive >= k, wide[k : k + n], np.uint64(0)) << np.uint64(8 * (7 - k))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    most, h = int(alive.max(initial=0)) + 1, 8
    kept = {d: np.unique(key >> np.uint64(8 * (8 - d)), return_inverse=True)[1].astype(np.int64) for d in depths if 0 < d < 8}

    def pair(first: np.ndarray, ahead: int) -> np.ndarray:
        second = np.zeros(n, np.int64)
        if ahead < n:
            second[: n - ahead] = np.where(alive[: n - ahead] >= ahead, first[ahead:] + 1, 0)
        return np.unique(first * (n + 2) + second, return_inverse=True)[1].astype(np.int64)

    while True:
        for d in depths:
            if h <= d < 2 * h:
                kept[d] = rank if d == h else pair(rank, d - h)
        if h >= most and all(d in kept for d in depths):
            return rank, kept
        rank = pair(rank, h)
        h *= 2


class RunLengthIndex:
    """Index of byte strings, in the order given.

    ``block`` queries need ``depth``: suffixes that share their first ``depth`` bytes form a block, of which the
    smallest text position is kept.
    """

    def __init__(self, members: list[bytes], depth: int):
        self.depth = depth
        joined = np.frombuffer(b"\xff".join([*members, b""]), np.uint8)
        self.text = joined + np.uint8(1)  # 0xff, which UTF-8 never has, becomes the end symbol 0
        n = len(self.text)
        ends = np.flatnonzero(self.text == 0)
        self.begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        self.ends = ends
        alive = np.repeat(ends, ends - self.begins + 1) - np.arange(n)
        rank, by = suffix_ranks(self.text, alive, (depth,))
        sa = np.argsort(rank, kind="stable")  # equal suffixes in text order, as if each end symbol were its own
        before = self.text[sa - 1]  # text[-1] is the last end symbol
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        head |= before == 0  # end symbols are distinct: each is a run of its own
        self.run_start = np.flatnonzero(head)
        self.run_symbol = before[self.run_start]
        self.run_length = np.diff(np.append(self.run_start, n))
        self.sample_first = sa[self.run_start]
        self.sample_last = sa[self.run_start + self.run_length - 1]
        # runs by symbol, and how many of the symbol stand before each
        order = np.argsort(self.run_symbol, kind="stable")
        self.by_symbol = order
        count = np.bincount(self.run_symbol, self.run_length, 256).astype(np.int64)
        self.first_row = np.concatenate([[0], np.cumsum(count)[:-1]])
        total = np.cumsum(self.run_length[order]) - self.run_length[order]
        self.rank_before = np.zeros(len(order), np.int64)
        self.rank_before[order] = total - self.first_row[self.run_symbol[order]]
        self.symbol_at = np.searchsorted(self.run_symbol[order], np.arange(257))
        self.rows = n
        self.run_keys = self.run_symbol[order].astype(np.int64) * (len(self.run_start) + 1) + order
        # blocks: rows whose first ``depth`` symbols are equal and whole
        whole = alive[sa] >= depth
        d = by[depth][sa]
        edge = np.ones(n, bool)
        edge[1:] = d[1:] != d[:-1]
        edge |= ~whole
        self.block_start = np.flatnonzero(edge)
        self.block_first = np.where(whole[self.block_start], np.minimum.reduceat(sa, self.block_start) if n else sa, -1)

    def block(self, row: np.ndarray) -> np.ndarray:
        """The smallest text position that shares ``depth`` bytes with the suffix at each row; -1 if it is shorter."""
        return self.block_first[np.searchsorted(self.block_start, row, "right") - 1]

    def _lce(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at a and b, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(out < most)
        while len(live):
            x, y = self.text[np.minimum(a[live] + out[live], self.rows - 1)], self.text[np.minimum(b[live] + out[live], self.rows - 1)]
            live = live[(x == y) & (x != 0)]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def stream(self, patterns: list[bytes], own: np.ndarray | None = None):
        """Matching statistics from right to left, all patterns abreast.

        Yields (pattern numbers, offset, row, length): the longest match of pattern[offset:] with the index, up to
        the longest member, and a row whose suffix has it.  ``own`` tells which member each pattern is, if it is one;
        its stream then starts from that member's end and never leaves it.
        """
        size = np.array([len(p) for p in patterns], np.int64)
        order = np.argsort(-size, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size)])
        joined = np.frombuffer(b"".join(patterns), np.uint8) + np.uint8(1)
        row = np.zeros(len(patterns), np.int64) if own is None else np.asarray(own, np.int64).copy()
        length = np.zeros(len(patterns), np.int64)
        at = self.ends[row].copy()  # row k is the suffix of the k-th end symbol
        active = len(order)
        for step in range(int(size.max(initial=0))):
            while active and size[order[active - 1]] <= step:
                active -= 1
            who = order[:active]
            c = joined[begin[who] + size[who] - 1 - step]
            r, ln, pos = row[who], length[who], at[who]
            run = np.searchsorted(self.run_start, r, "right") - 1
            inside = r - self.run_start[run]
            miss = np.flatnonzero(self.run_symbol[run] != c)
            if len(miss):
                cm, rm = c[miss].astype(np.int64), run[miss]
                lo, hi = self.symbol_at[cm], self.symbol_at[cm + 1]
                # runs of the wanted symbol: the last before this run and the first after it
                nxt = np.searchsorted(self.run_keys, cm * (len(self.run_start) + 1) + rm)
                has_up, has_down = nxt > lo, nxt < hi
                up = self.by_symbol[np.maximum(nxt - 1, 0)]
                down = self.by_symbol[np.minimum(nxt, len(self.by_symbol) - 1)]
                l_up = np.where(has_up, self._lce(pos[miss], self.sample_last[up], np.where(has_up, ln[miss], 0)), -1)
                l_down = np.where(has_down, self._lce(pos[miss], self.sample_first[down], np.where(has_down, ln[miss], 0)), -1)
                take_up = l_up >= l_down
                none = ~has_up & ~has_down
                run[miss] = np.where(take_up, up, down)
                inside[miss] = np.where(take_up, self.run_length[up] - 1, 0)
                pos[miss] = np.where(take_up, self.sample_last[up], self.sample_first[down])
                ln[miss] = np.maximum(l_up, l_down)
                gone = miss[none]
                run[gone], inside[gone] = 0, 0
            symbol = self.run_symbol[run]
            r = self.first_row[symbol] + self.rank_before[run] + inside
            pos, ln = pos - 1, ln + 1
            if len(miss) and len(gone):  # a symbol that the index lacks
                r[gone], ln[gone], pos[gone] = 0, 0, self.ends[0] if len(self.ends) else 0
            row[who], length[who], at[who] = r, ln, pos
            yield who, size[who] - 1 - step, r, ln
