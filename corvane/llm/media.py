"""Media columns: AVI files of motion-JPEG frames.

Writing: bytes become grey samples, 192 to a frame (16 x 12), each drawn as one constant 8 x 8 block.  With a DC
quantiser of 8 such a block's only coefficient is ``sample - 128``, so baseline JPEG keeps it exactly and any player
shows it.  The DC code gives category ``s`` a code of ``10 - s`` bits and the end of block one bit, so every block
takes 11 bits and frames decode as arrays.

Reading parses the RIFF tree and ``idx1`` (or the chunks themselves, where a file has no index), takes the tables from
the frame's own markers, decodes every intra frame, and finds shots where the histogram difference exceeds the running
mean by a multiple of the running deviation.  Frames of this writer decode as arrays, all other baseline frames by
:mod:`corvane.llm.jpeg`; a file that holds neither gives a row with its error.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _rows as R
from corvane.llm import jpeg
from corvane.llm._spark import small_batches

COLS, ROWS = 16, 12
SAMPLES = COLS * ROWS
FPS = 25
_BITS = 11  # of one block
_LENGTHS = {s: 10 - s for s in range(9)}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length), shorter ones first."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind]) + bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order)


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8]) * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLS * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _table(0x00, _LENGTHS))
    + _segment(0xC4, _table(0x10, {0: 1}))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _units() -> np.ndarray:
    """For each difference -255..255 its 11 bits."""
    codes, out = _codes(_LENGTHS), np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, _ = codes[s]
        out[d + 255] = ((code << s) | (d if d > 0 else d + (1 << s) - 1 if d else 0)) << 1
    return out


_UNIT = _units()


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of 192."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES).astype(np.int16) - 128
    n = len(samples)
    unit = _UNIT[np.diff(samples, axis=1, prepend=np.int16(0)) + 255]
    bits = (unit[:, :, None] >> np.arange(_BITS - 1, -1, -1, dtype=np.uint16)) & 1
    scan = np.packbits(bits.reshape(n, -1).astype(np.uint8), axis=1)  # 264 whole bytes
    full = scan == 0xFF
    head = np.frombuffer(HEADER, np.uint8)
    rows = np.concatenate([np.broadcast_to(head, (n, len(head))), scan, np.broadcast_to(np.array([0xFF, 0xD9], np.uint8), (n, 2))], axis=1)
    repeat = np.ones(rows.shape, np.int64)
    repeat[:, len(head) : -2] += full
    size = repeat.sum(axis=1)
    pad = size & 1
    repeat[:, -1] += pad
    at = np.cumsum(repeat.ravel())
    flat = np.repeat(rows.ravel(), repeat.ravel())
    stuffed = np.flatnonzero(repeat[:, len(head) : -2] > 1)
    flat[at[stuffed // scan.shape[1] * rows.shape[1] + len(head) + stuffed % scan.shape[1]] - 1] = 0
    ends = at.reshape(n, -1)[:, -1]
    flat[ends[pad == 1] - 1] = 0
    # chunk headers in front of each frame
    begin = np.concatenate([[0], ends[:-1]])
    body = np.insert(flat, np.repeat(begin, 8), np.frombuffer(b"".join(b"00dc" + struct.pack("<I", s) for s in size.tolist()), np.uint8))
    index = np.zeros(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")]))
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, size
    index["offset"] = 4 + begin + 8 * np.arange(n)

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    top = int(size.max())
    avih = struct.pack("<14I", 1_000_000 // FPS, top * FPS, 0, 0x10, n, 0, 1, top, COLS * 8, ROWS * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, top, 0, 0, 0, 0, COLS * 8, ROWS * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, COLS * 8, ROWS * 8, 1, 24, b"MJPG", COLS * ROWS * 192, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"movi" + body.tobytes()) + chunk(b"idx1", index.tobytes()))


def _inside(avi: bytes, at: int, end: int) -> list[bytes]:
    """The frames among the chunks of a movi list, in their order."""
    out = []
    while at + 8 <= end:
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST":
            out += _inside(avi, at + 12, min(end, at + 8 + size))
        elif name[2:] in (b"dc", b"db"):
            out.append(avi[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


def frames(avi: bytes) -> list[bytes]:
    """The frames that ``idx1`` names, or all of the movi list if there is no index; empty ones repeat the last."""
    movi, stop, index, at = None, 0, None, 12
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    while at + 8 <= len(avi):
        size = struct.unpack_from("<I", avi, at + 4)[0]
        if avi[at : at + 4] == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi, stop = at + 8, at + 8 + size
        elif avi[at : at + 4] == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        found = _inside(avi, movi + 4, min(stop, len(avi)))
    else:
        named = [(o, n) for kind, _, o, n in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if kind[2:] in (b"dc", b"db")]
        # offsets count from the list's name or from the file's begin
        base = 0 if named and named[0][0] >= movi and avi[named[0][0] + 2 : named[0][0] + 4] in (b"dc", b"db") else movi
        found = [avi[base + o + 8 : base + o + 8 + n] for o, n in named]
    out: list[bytes] = []
    for frame in found:
        if frame or out:
            out.append(frame or out[-1])
    return out


def _read_header(frame: bytes) -> tuple[int, int, int, np.ndarray]:
    """(where the scan begins, blocks, bits of a block, difference of each unit) from a frame's markers."""
    at, quant, blocks, dc = 2, 0, 0, {}
    if frame[: len(HEADER)] != HEADER:
        raise ValueError("frames of another coder")
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant = body[1]
        elif marker == 0xC0:
            h, w = struct.unpack_from(">HH", body, 1)
            blocks = (h // 8) * (w // 8)
        elif marker == 0xC4 and body[0] == 0:
            symbols, k = body[17:], 0
            for n in range(1, 17):
                for _ in range(body[n]):
                    dc[symbols[k]], k = n, k + 1
        elif marker == 0xDA:
            break
    if {n + s for s, n in dc.items()} != {_BITS - 1} or quant != 8:
        raise ValueError("frames of another coder")
    value = np.zeros(1 << _BITS, np.int16)
    for s, (code, _) in _codes(dc).items():
        for extra in range(1 << s):
            d = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            value[((code << s) | extra) << 1] = d
    return at, blocks, _BITS, value


@lru_cache(maxsize=1)
def _own() -> tuple[int, int, int, np.ndarray]:
    return _read_header(HEADER)


def decode(avi: bytes) -> np.ndarray:
    """(frames, samples) of 8-bit samples: those that :func:`encode` stored, else the luminance of each frame's pixels."""
    found = frames(avi)
    if not found:
        return np.zeros((0, SAMPLES), np.uint8)
    if any(f[: len(HEADER)] != HEADER for f in found):
        planes = [jpeg.luminance(f) for f in found]
        if len({p.shape for p in planes}) > 1:
            raise ValueError("frames of several sizes")
        return np.stack([p.ravel() for p in planes])
    begin, blocks, bits, value = _own()
    try:
        scan = np.frombuffer(b"".join(f[begin : f.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff") for f in found), np.uint8).reshape(len(found), -1)
        unit = np.unpackbits(scan, axis=1)[:, : blocks * bits].reshape(len(found), blocks, bits).astype(np.uint16)
    except ValueError as e:
        raise ValueError(f"a broken frame: {e}") from e
    unit = (unit << np.arange(bits - 1, -1, -1, dtype=np.uint16)).sum(axis=2, dtype=np.uint16)
    return (np.cumsum(value[unit], axis=1, dtype=np.int16) + 128).astype(np.uint8)


@dataclass(frozen=True)
class ShotConfig:
    bins: int = 16
    #: A cut needs a difference of mean + ``deviations`` * deviation over the last ``memory`` frames, and ``least``.
    deviations: float = 3.0
    memory: int = 25
    least: float = 0.25


def shots(samples: np.ndarray, config: ShotConfig = ShotConfig()) -> list[tuple[int, int]]:
    """[(first frame, one past the last)] of the shots."""
    n = len(samples)
    if n < 2:
        return [(0, n)] if n else []
    bins = samples.astype(np.int64) * config.bins // 256 + np.arange(n)[:, None] * config.bins
    hist = np.bincount(bins.ravel(), minlength=n * config.bins).reshape(n, -1)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * samples.shape[1])
    s1, s2 = np.concatenate([[0.0], np.cumsum(d)]), np.concatenate([[0.0], np.cumsum(d * d)])
    i = np.arange(len(d))
    j = np.maximum(i - config.memory, 0)
    m = np.maximum(i - j, 1)
    mean = (s1[i] - s1[j]) / m
    deviation = np.sqrt(np.maximum((s2[i] - s2[j]) / m - mean * mean, 0.0))
    cut = np.flatnonzero((d > mean + config.deviations * deviation) & (d > config.least)) + 1
    edges = [0, *cut.tolist(), n]
    return list(zip(edges[:-1], edges[1:]))


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(SAMPLES, -(-len(raw) // SAMPLES) * SAMPLES)
    return raw.ljust(size, b" "), len(raw)


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text): each whole text as an AVI file; a null text is empty."""

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts, begin, size, out = batch.column("doc_id"), batch.column("text"), 0, 0, []
            for k in range(batch.num_rows):
                data, n = payload(texts[k].as_py() or "")
                out.append((n, encode(data)))
                size += len(out[-1][1])
                if size >= 4 << 20 or k + 1 == batch.num_rows:
                    numbers, files = zip(*out)
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, len(out)), pa.array(numbers, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                    begin, size, out = k + 1, 0, []

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame, config: ShotConfig = ShotConfig()) -> DataFrame:
    """One row for each file of ``media`` (doc_id, n_bytes, media): digests, and its clips with their times in ms.

    A null file, or one that can't be read, has its reason in ``error``, its media columns as far as there is a file,
    and nulls for what would come from its frames.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,start_ms:long,end_ms:long>>, error string"

    def read(avi: bytes | None) -> tuple:
        if avi is None:
            return None, None, None, None, None, None, None, "no file"
        stored = len(avi), hashlib.sha256(avi).hexdigest()
        try:
            samples = decode(avi)
        except ValueError as e:
            return None, None, None, *stored, None, None, str(e)
        back, found = samples.tobytes(), shots(samples, config)
        hist = np.bincount(samples.ravel() >> 4, minlength=16)
        feature = f"{len(samples)};{'.'.join(str(b) for _, b in found)};{'.'.join(map(str, hist.tolist()))}"
        timed = [{"clip": i, "start_ms": a * 1000 // FPS, "end_ms": b * 1000 // FPS} for i, (a, b) in enumerate(found)]
        return len(back), hashlib.sha256(back).hexdigest(), R.crc(back[-16:]), *stored, feature, timed, None

    def run(batches):
        for batch in batches:
            files = batch.column("media")
            out = [(doc_id, n, *read(files[k].as_py())) for k, (doc_id, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes"))))]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
