"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak fingerprints.

A payload is a text's UTF-8 bytes, padded with spaces to a positive multiple of ``PAD``. It is
stored without loss as 8-bit mono samples of a WAV file, written and read by the wave module.
The samples that were read back are cut to overlapping frames centred on their ``HOP`` samples, with
spaces (a payload's silence) before the first and after the last, so every sample has a weight in
some frame and the smallest payload has one; the strongest bin of each band
of a frame is a peak where it stands out from its neighbours in time; each peak is paired with
the next peaks of the same and the following frames. A pair is a time code and (low bin, high bin, distance).

Null and empty texts are a payload of ``PAD`` spaces; they have no pairs. Equal payloads give
equal media and fingerprints; every row is handled by itself. Long payloads are transformed some
frames at a time. An input column with the
name of a new one gives way to it.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import batches as B
from .bpe import room

PAD, RATE = 192, 8000
#: Samples of a frame and between frames; frames transformed at a time.
FRAME, HOP, BLOCK = 256, 192, 2048
#: Bands of bins in which peaks are sought.
BANDS = ((1, 8), (8, 20), (20, 48), (48, 128))
#: Peaks stand out over so many frames to either side; they are paired with so many following ones, so many frames away at most.
AROUND, FAN, REACH = 2, 3, 32


def payload(text: str) -> bytes:
    """UTF-8 bytes with spaces up to a positive multiple of PAD."""
    data = text.encode()
    return data + b" " * ((-len(data)) % PAD if data else PAD)


def store(data: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def load(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """(frame, bin) of the spectral peaks, in order of time, then of bin."""
    n, edge = -(-len(samples) // HOP), (FRAME - HOP) // 2
    samples = np.pad(samples, (edge, n * HOP - len(samples) + FRAME - HOP - edge), constant_values=ord(" "))
    window = np.hanning(FRAME).astype(np.float32)
    best, power = np.zeros((n, len(BANDS)), np.int32), np.zeros((n, len(BANDS)), np.float32)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        part = samples[a * HOP : (b - 1) * HOP + FRAME].astype(np.float32) - 96
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(frames, axis=1)
        energy = spectrum.real**2 + spectrum.imag**2
        for k, (low, high) in enumerate(BANDS):
            at = energy[:, low:high].argmax(1)
            best[a:b, k], power[a:b, k] = at + low, energy[np.arange(b - a), at + low]
    if not n:
        return np.zeros((0, 2), np.int64)
    # a constant signal leaves rounding noise only
    top = power > 1.0
    for away in range(1, AROUND + 1):
        top[away:] &= power[away:] > power[:-away]
        top[:-away] &= power[:-away] >= power[away:]
    frame, band = np.nonzero(top)
    return np.column_stack([frame, best[frame, band]]).astype(np.int64)


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (frames) and codes of the peak pairs, in order of time."""
    times, codes = [], []
    for ahead in range(1, FAN + 1):
        a, b = found[:-ahead], found[ahead:]
        gap = b[:, 0] - a[:, 0]
        near = (gap >= 0) & (gap <= REACH)
        times.append(a[near, 0])
        codes.append((a[near, 1] << 14) | (b[near, 1] << 6) | gap[near])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def media_columns(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) with n_bytes, media (the WAV file), payload (read back) and fingerprint (array of time and code)."""
    new = ["n_bytes", "media", "payload", "fingerprint"]
    keep = room(df.columns if keep is None else keep, *new)
    pair = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("code", T.IntegerType())])
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("fingerprint", T.ArrayType(pair))])
    kept = [f.name for f in schema][: -len(new)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.cut(it, text):
            sizes, files, reads, times, codes = [], [], [], [], []
            for value in B.texts(batch, text):
                media = store(payload(value))
                data = load(media)
                time, code = pairs(peaks(np.frombuffer(data, np.uint8)))
                sizes.append(len(value.encode()))
                files.append(media)
                reads.append(data)
                times.append(time)
                codes.append(code)
            ends = np.r_[0, np.cumsum([len(t) for t in times])].astype(np.int32)
            both = pa.StructArray.from_arrays([pa.array(np.concatenate(times)), pa.array(np.concatenate(codes))], fields=[pa.field("t", pa.int32()), pa.field("code", pa.int32())])
            columns = [pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(reads, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), both)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *new])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def fingerprint_text(column: str = "fingerprint") -> Column:
    """A fingerprint as a short string: pairs, last time code, and a digest of all time codes and codes."""
    c = F.col(column)
    last = F.coalesce(F.array_max(F.transform(c, lambda x: x["t"])), F.lit(-1))
    return F.concat_ws(":", F.size(c).cast("string"), last.cast("string"), F.lower(F.hex(F.xxhash64(c))))
