"""Telephony audio columns: mu-law and A-law by lookup tables, ADPCM blocks side by side, resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import written
from .textkit import batches, text_buffers

#: WAVE format tags (fixed values of the public file format).
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
CODECS = {"mulaw": MULAW, "alaw": ALAW, "adpcm": IMA_ADPCM}

#: Step sizes and index moves of IMA ADPCM (fixed values of the public standard).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

BLOCK_ALIGN = 64
RATE = 8000


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte, by the rule: inverted bits are sign, 3 of exponent, 4 of mantissa, biased by 132."""
    x = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((x & 15) << 3) + 132) << (x >> 4 & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte, by the rule: even bits inverted, sign set for positive, linear lowest segment."""
    x = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = x >> 4 & 7, (x & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


_MULAW, _ALAW = mulaw_table(), alaw_table()


def _adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """For every step index and 4-bit code: the change of the sample, and the next index."""
    step, code = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -change, change)
    following = np.clip(np.arange(len(STEPS), dtype=np.int32)[:, None] + MOVES[code & 7], 0, len(STEPS) - 1)
    return change.astype(np.int32).ravel(), following.astype(np.int32).ravel()


_CHANGE, _NEXT = _adpcm_moves()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks, one row a block: the header's sample, then two of each byte, low half first.

    A sample needs the one before it, but blocks are independent: each step handles one sample of all blocks.
    An index beyond the table, which a damaged header can hold, counts as the last.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = (index << 4) + code
            value += _CHANGE[at]
            np.clip(value, -32768, 32767, out=value)
            index = _NEXT[at]
            out[1 + 2 * k + half] = value
    return out.T


def wave(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """A WAVE file around coded bytes: 8-bit samples, or ADPCM blocks of BLOCK_ALIGN bytes."""
    if tag == IMA_ADPCM:
        each = 1 + 2 * (BLOCK_ALIGN - 4)
        samples = len(payload) // BLOCK_ALIGN * each
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK_ALIGN // each, BLOCK_ALIGN, 4, 2, each)
    else:
        samples = len(payload)
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    parts = [(b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)]
    body = b"".join([name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in parts])
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wave(data: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, sample rate, block size and coded bytes of a WAVE file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate, align = 12, 0, 0, 1
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, align = struct.unpack_from("<HHIIH", data, at + 8)
        elif name == b"data":
            return tag, rate, align, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _filter(up: int, down: int, half: int = 4) -> np.ndarray:
    """A windowed-sinc low-pass for resampling by up / down: one row of 2 * half weights a phase, in units of 2**-15."""
    cut = min(1.0, up / down)
    t = np.arange(up)[:, None] / up - np.arange(-half + 1, half + 1)[None, :]
    taps = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / (half + 1), -1, 1)))
    return np.rint(taps / taps.sum(1, keepdims=True) * (1 << 15)).astype(np.int32)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """PCM at another rate, in whole numbers throughout, so that every machine gives the same samples."""
    if rate == to or not len(pcm):
        return pcm
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    taps = _filter(up, down)
    half = taps.shape[1] // 2
    padded = np.concatenate([np.full(half - 1, pcm[0], np.int32), pcm.astype(np.int32), np.full(half + 1, pcm[-1], np.int32)])
    n = len(pcm) * up // down
    out = np.empty(n, np.int16)
    for phase in range(up):  # outputs whose position has this phase read the same weights
        k = np.arange(phase * pow(down, -1, up) % up if up > 1 else 0, n, up)
        base = k * down // up
        total = np.full(len(k), 1 << 14, np.int32)
        contiguous = down == 1 and len(k)
        for j, weight in enumerate(taps[phase]):
            if weight:
                total += weight * (padded[base[0] + j : base[0] + j + len(k)] if contiguous else padded[base + j])
        out[k] = np.clip(total >> 15, -32768, 32767)
    return out


def media_table(documents: DataFrame, codec: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as a telephony WAVE file in a table of the shared folder: doc_id, n_bytes, media.

    The payload is the UTF-8 text (null: empty) with bytes 0 up to a positive multiple of 64; it becomes
    mu-law or A-law samples, or IMA ADPCM blocks of 64 bytes, unchanged. Unless `codec` names one, the
    payload's checksum picks it, so equal texts are stored alike. A row for each row, null ids and repeated rows
    included, no shuffle; an empty table gives an empty one; other columns may have any names and are ignored.
    """

    def store(it) -> Iterator[pa.RecordBatch]:
        tags = list(CODECS.values())
        for ids, texts in batches(it, ["doc_id", "text"]):
            data, offsets = text_buffers(texts)
            for i in range(0, len(ids), 500):
                files = []
                for a, b in zip(offsets[i : i + 500].tolist(), offsets[i + 1 : i + 501].tolist()):
                    payload = data[a:b].tobytes().ljust(max(64, -(-(b - a) // 64) * 64), b"\0")
                    files.append(wave(payload, CODECS[codec] if codec else tags[zlib.crc32(payload) % 3]))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(files)), pa.array(np.diff(offsets[i : i + len(files) + 1])), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    frame = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(frame.mapInArrow(store, "doc_id long, n_bytes long, media binary"), "media")


def decode_media(media: DataFrame, to_rate: int = 16000, with_pcm: bool = False) -> DataFrame:
    """Reads stored WAVE files back, expands them to 16-bit PCM, resamples, and describes each.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 64 payload bytes), media_bytes,
    media_sha256, feature, and `pcm` (little-endian 16-bit samples at `to_rate`) if `with_pcm`. The feature is
    codec:samples:peak:rms:sign changes:crc32 of the resampled PCM, all in whole numbers. Null ids and repeated rows
    are rows like any other, equal files give equal values, and an empty table gives no rows. What is not a WAVE
    file is an error.
    """

    def decode(it) -> Iterator[pa.RecordBatch]:
        for ids, sizes, files in batches(it, ["doc_id", "n_bytes", "media"]):
            data, offsets = text_buffers(files)
            at = 0
            while at < len(ids):
                end = min(len(ids), max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1))
                stored = [data[a:b].tobytes() for a, b in zip(offsets[at:end].tolist(), offsets[at + 1 : end + 1].tolist())]
                rows = describe(stored, to_rate, with_pcm)
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), sizes.slice(at, end - at), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS[: 6 + with_pcm])]], names=_NAMES[: 8 + with_pcm])
                at = end

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, _SCHEMA + ", pcm binary" * with_pcm)


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")] + ["pcm"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def describe(stored: list[bytes], to_rate: int, with_pcm: bool) -> list[tuple]:
    parsed = [parse_wave(x) for x in stored]
    coded = [i for i, p in enumerate(parsed) if p[0] == IMA_ADPCM]
    expanded: dict[int, np.ndarray] = {}
    for align in {parsed[i][2] for i in coded}:
        own = [i for i in coded if parsed[i][2] == align]
        raw = np.frombuffer(b"".join([parsed[i][3] for i in own]), np.uint8).reshape(-1, align)
        pcm, upto = decode_adpcm(raw), np.cumsum([0, *[len(parsed[i][3]) // align for i in own]])
        expanded.update({i: pcm[a:b].ravel() for i, a, b in zip(own, upto, upto[1:])})
    out = []
    for i, (tag, rate, _, payload) in enumerate(parsed):
        if tag in (MULAW, ALAW):
            pcm = (_MULAW if tag == MULAW else _ALAW)[np.frombuffer(payload, np.uint8)]
        elif tag == IMA_ADPCM:
            pcm = expanded[i]
        else:
            pcm = np.frombuffer(payload, "<i2")
        wide = pcm.astype(np.int64)
        peak, power = int(np.abs(wide).max()), int(np.dot(wide, wide))
        turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
        sound = resample(pcm, rate, to_rate).astype("<i2").tobytes()
        name = {v: k for k, v in CODECS.items()}.get(tag, "pcm")
        rms = round((power // len(pcm)) ** 0.5)
        feature = f"{name}:{len(pcm)}:{peak}:{rms}:{turns}:{zlib.crc32(sound)}"
        row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored[i]), hashlib.sha256(stored[i]).hexdigest(), feature)
        out.append((*row, sound) if with_pcm else row)
    return out
