"""Telephony audio in media columns: G.711 mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks.

A payload of bytes is stored losslessly in a WAV file whose samples (G.711) or blocks (ADPCM) the bytes are; decoding gives
16-bit PCM at 8 kHz, resampled to 16 kHz by a half-band filter that keeps every original sample at its even place.

Null and empty texts give one payload of padding; equal payloads give equal files and features, so that ties don't arise. Blocks are
decoded many at a time, MAX_BLOCKS at most, and rows in groups of up to GROUP_BYTES: a task holds the sound of one group or of one
text (eight bytes a byte), whichever is more. Only the keys and the column are read; keys named like a column of the result clash and
are the caller's to name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, PAD, RATE = 576, 255, 8000
MAX_BLOCKS = 2048
#: Bytes of payload that are decoded together, and rows.
GROUP_BYTES, GROUP_ROWS = 1 << 20, 64
#: WAV format tags.
ALAW, MULAW, IMA = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA: "ima_adpcm"}
#: IMA ADPCM index steps, by the low three bits of a code.
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: IMA ADPCM step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
#: The half-band filter's taps between two samples, in 1/32 (from the middle outwards, mirrored).
TAPS = (19, -3)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    value = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 85
    low, exponent = (code & 15) << 4, code >> 4 & 7
    value = np.where(exponent == 0, low + 8, (low + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, bytes) blocks to (n, samples) PCM: each step of the recursion runs over all blocks at once.

    A block starts with its first sample (16 bits, little-endian), the step index (limited to 88) and a byte that is ignored.
    """
    n, width = blocks.shape
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(width - 4):
        for half, code in enumerate((codes[i] & 15, codes[i] >> 4)):
            step = STEPS[index]
            change = step >> 3
            change += np.where(code & 4, step, 0)
            change += np.where(code & 2, step >> 1, 0)
            change += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX[code & 7], 0, 88)
            out[2 * i + half + 1] = value
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples themselves, and between them a half-band filter's values."""
    padded = np.pad(pcm.astype(np.int32), 2, mode="edge")
    n = len(pcm)
    between = TAPS[0] * (padded[2 : n + 2] + padded[3 : n + 3]) + TAPS[1] * (padded[1 : n + 1] + padded[4 : n + 4])
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((between + 16) >> 5, -32768, 32767)
    return out


def wav(tag: int, data: bytes, rate: int = RATE, bits: int = 8) -> bytes:
    """A WAV file, mono. For IMA ADPCM the data are blocks of BLOCK bytes."""
    samples = len(data) // BLOCK * (2 * (BLOCK - 4) + 1) if tag == IMA else len(data) * 8 // bits
    if tag == IMA:
        per_block = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(stored: bytes) -> tuple[int, bytes]:
    """Its format tag and its data, found by walking the chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack("<I", stored[at + 4 : at + 8])[0]
        if name == b"fmt ":
            tag = struct.unpack("<H", stored[at + 8 : at + 10])[0]
        elif name == b"data":
            return tag, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * ((-len(data)) % BLOCK if data else BLOCK)


def decode(tag: int, data: bytes) -> np.ndarray:
    if tag in TABLES:
        return TABLES[tag][np.frombuffer(data, np.uint8)]
    blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK)
    return np.concatenate([decode_ima(blocks[i : i + MAX_BLOCKS]).ravel() for i in range(0, len(blocks), MAX_BLOCKS)])


def decode_many(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """PCM of each file; the ADPCM blocks of all files are decoded together."""
    out: list[np.ndarray | None] = [None if tag == IMA else decode(tag, data) for tag, data in files]
    ima = [i for i, (tag, _) in enumerate(files) if tag == IMA]
    if ima:
        pcm = decode(IMA, b"".join(files[i][1] for i in ima)).reshape(-1, 2 * (BLOCK - 4) + 1)
        at = 0
        for i in ima:
            n = len(files[i][1]) // BLOCK
            out[i] = pcm[at : at + n].ravel()
            at += n
    return out


def grouped(batch: pa.RecordBatch, data: pa.Array):
    """Slices of the batch, by the bytes of its data."""
    sizes = [x or 0 for x in pc.binary_length(data).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > GROUP_BYTES or i - at >= GROUP_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def features(name: str, pcm: np.ndarray) -> str:
    """Integers only, so that they are the same everywhere: peak, mean size, sign changes, energy in eight equal parts."""
    size = np.abs(pcm.astype(np.int32))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    parts = ".".join(str(int(p.sum(dtype=np.int64)) // max(1, len(p))) for p in np.array_split(size, 8))
    return f"{name};n={len(pcm)};peak={int(size.max(initial=0))};mean={int(size.sum(dtype=np.int64)) // max(1, len(pcm))};zc={crossings};parts={parts}"


def store_telephony(rows: DataFrame, column: str, keys=("doc_id",), codec: int | None = None) -> DataFrame:
    """The keys, n_bytes, codec, media (a WAV file of the column's bytes), pcm (resampled PCM as a WAV file) of every row.

    codec: a format tag; None takes one of the three by the payload's CRC-32.
    """
    keys = list(keys)

    def stored(batches):
        for batch in batches:
            for part in grouped(batch, batch.column("data_")):
                data = [x.as_py() or b"" for x in part.column("data_")]
                payloads = [pad(x) for x in data]
                tags = [codec or (MULAW, ALAW, IMA)[zlib.crc32(x) % 3] for x in payloads]
                files = [wav(t, x) for t, x in zip(tags, payloads, strict=True)]
                pcm = [wav(1, resample(x).astype("<i2").tobytes(), 2 * RATE, 16) for x in decode_many([read_wav(f) for f in files])]
                columns = [part.column(k) for k in keys]
                columns += [pa.array([len(x) for x in data], pa.int64()), pa.array([NAMES[t] for t in tags]), pa.array(files, pa.binary()), pa.array(pcm, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "n_bytes", "codec", "media", "pcm"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.col(column).cast("binary").alias("data_")).mapInArrow(stored, f"{kinds}, n_bytes long, codec string, media binary, pcm binary")


def describe(media: DataFrame, keys=("doc_id",)) -> DataFrame:
    """What a table of store_telephony holds, by reading its stored bytes back."""
    keys = list(keys)
    names = [*keys, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_sha256"]

    def described(batches):
        for batch in batches:
            for part in grouped(batch, batch.column("media")):
                files = [x.as_py() for x in part.column("media")]
                read = [read_wav(f) for f in files]
                sounds = [read_wav(x.as_py())[1] for x in part.column("pcm")]
                own = [
                    (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(f), hashlib.sha256(f).hexdigest(), features(NAMES[t], np.frombuffer(s, "<i2")[::2]), hashlib.sha256(s).hexdigest())
                    for f, (t, p), s in zip(files, read, sounds, strict=True)
                ]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = [part.column(k) for k in [*keys, "n_bytes"]] + [pa.array([o[i] for o in own], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{k}` {media.schema[k].dataType.simpleString()}" for k in keys)
    return media.mapInArrow(described, f"{kinds}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_sha256 string")
