"""Baseline JPEG: the luminance samples of one frame, for any quantisers, Huffman tables, components and sampling.

Plain and slow beside :mod:`corvane.llm.media`'s reader of its own frames, which works on whole files as arrays.
"""

from __future__ import annotations

import struct

import numpy as np

#: The order in which a block's coefficients are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

_k, _x = np.arange(8)[:, None], np.arange(8)[None, :]
#: The cosine transform: rows are frequencies.
BASIS = np.where(_k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _x + 1) * _k * np.pi / 16)


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("a scan ends early")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _parts(scan: bytes) -> list[bytes]:
    """The scan's bytes between restart markers, without stuffing."""
    out, at, begin = [], 0, 0
    while True:
        at = scan.find(b"\xff", at)
        if at < 0 or at + 1 >= len(scan):
            out.append(scan[begin:])
            break
        after = scan[at + 1]
        if after == 0:
            at += 2
        elif 0xD0 <= after <= 0xD7:
            out.append(scan[begin:at])
            at = begin = at + 2
        else:
            out.append(scan[begin:at])
            break
    return [p.replace(b"\xff\0", b"\xff") for p in out]


def luminance(frame: bytes) -> np.ndarray:
    """(height, width) of 8-bit samples of the first component; ValueError for what is no baseline JPEG."""
    try:
        return _luminance(frame)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"a broken frame: {e}") from e


def _luminance(frame: bytes) -> np.ndarray:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    quant, tables, at, restart, size, parts = {}, {}, 2, 0, None, []
    while True:
        if frame[at] != 0xFF:
            raise ValueError("no marker")
        marker = frame[at + 1]
        n = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                length = 128 if wide else 64
                quant[k] = np.frombuffer(body[1 : 1 + length], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + length :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            size = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("no baseline frame")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if size is None or {p[0] for p in parts} != set(chosen):
        raise ValueError("no frame of one scan")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]  # one component alone is not interleaved
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-size[1] // (8 * wide)), -(-size[0] // (8 * high))
    plane = np.zeros((down * parts[0][2] * 8, across * parts[0][1] * 8))
    scans, bits, last = iter(_parts(frame[at:])), None, {}
    for unit in range(across * down):
        if bits is None or restart and unit % restart == 0:
            bits, last = _Bits(next(scans, b"")), dict.fromkeys(chosen, 0)
        for i, (c, h, v, q) in enumerate(parts):
            dc, ac = tables[chosen[c] >> 4], tables[0x10 | chosen[c] & 15]
            for block in range(h * v):
                found = np.zeros(64)
                last[c] += bits.signed(bits.symbol(dc))
                found[0], k = last[c], 1
                while k < 64:
                    run, n = divmod(bits.symbol(ac), 16)
                    if not n:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    found[k] = bits.signed(n)
                    k += 1
                if i == 0:
                    f = np.zeros(64)
                    f[ZIGZAG] = found * quant[q]
                    y, x = (unit // across * v + block // h) * 8, (unit % across * h + block % h) * 8
                    plane[y : y + 8, x : x + 8] = BASIS.T @ f.reshape(8, 8) @ BASIS + 128
    # the first component is sampled in full wherever it has the largest factors
    own = (-(-size[0] * parts[0][2] // high), -(-size[1] * parts[0][1] // wide))
    return np.clip(np.rint(plane[: own[0], : own[1]]), 0, 255).astype(np.uint8)
