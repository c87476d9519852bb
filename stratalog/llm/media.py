"""Texts as media: WAV storage, short-time Fourier transforms and fingerprints of spectral-peak pairs.

The bytes of a text, padded with zeros to a positive multiple of 64, become 8-bit samples of a WAV file written by the wave
module. The stored file is read back; features come from what was read. Frames of 512 samples that begin every 256 samples
are windowed and transformed. A bin is a peak if it is the strongest of its band in its frame, stronger than both bins beside it
and no weaker than the same bin in the frames before and after. Each peak is paired with the first peaks that follow it,
of any band, 1 to 3 frames later. A fingerprint is an array of codes: time of the first peak, both bins, and their distance
in frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common

RATE, FRAME, STRIDE, BANDS, UNIT = 8000, 512, 256, ((2, 32), (32, 96), (96, 257)), 64
#: Peaks that a peak is paired with, at most, and how many frames later they are at most.
FAN, REACH = 3, 3
#: Frames transformed at once.
_AT_ONCE = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded to a positive multiple of 64."""
    data = text.encode("utf-8")
    return len(data), data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def spectra(samples: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Magnitudes of the frames, some at a time with the number of the first; the last frame is filled up with silence."""
    signal = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(len(signal) - FRAME) // STRIDE) + 1)
    for first in range(0, frames, _AT_ONCE):
        n = min(_AT_ONCE, frames - first)
        part = signal[first * STRIDE : (first + n - 1) * STRIDE + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * STRIDE + FRAME - len(part)))
        yield first, np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::STRIDE] * _WINDOW, axis=1)).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of all peaks, by frame, then bin."""
    at, bins = [], []
    before = np.zeros((1, FRAME // 2 + 1), np.float32)
    held: tuple[int, np.ndarray] | None = None

    def found(first: int, mag: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        all_rows = np.concatenate([before, mag, after])
        rows = np.arange(len(mag))
        for low, high in BANDS:
            k = low + mag[:, low:high].argmax(axis=1)
            top = mag[rows, k]
            ok = (top > mag[rows, k - 1]) & (top > np.where(k + 1 < mag.shape[1], mag[rows, np.minimum(k + 1, mag.shape[1] - 1)], -1))
            ok &= (top >= all_rows[rows, k]) & (top >= all_rows[rows + 2, k])
            at.append(first + rows[ok])
            bins.append(k[ok])

    for first, mag in spectra(samples):
        if held is not None:
            found(*held, before, mag[:1])
            before = held[1][-1:]
        held = first, mag
    found(*held, before, np.zeros_like(before))
    times, places = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((places, times))
    return times[order].astype(np.int64), places[order].astype(np.int64)


def fingerprint(samples: bytes) -> np.ndarray:
    """Codes frame << 32 | bin << 20 | later bin << 8 | frames between, by frame, bin and order of the later peaks.

    Each peak is paired with the first ``FAN`` peaks in the ``REACH`` frames after its own. Where no two peaks can be paired, as
    in a single frame, each is paired with itself, 0 frames apart.
    """
    times, bins = peaks(samples)
    first = np.searchsorted(times, times, side="right")
    last = np.minimum(first + FAN, np.searchsorted(times, times + REACH, side="right"))
    counts = last - first
    if not counts.any():
        return (times << 32) | (bins << 20) | (bins << 8)
    i = np.repeat(np.arange(len(times)), counts)
    j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return (times[i] << 32) | (bins[i] << 20) | (bins[j] << 8) | (times[j] - times[i])


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """One row per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, fingerprint.

    ``media`` adds the stored WAV bytes. Null text counts as empty: its payload is 64 zero bytes. Equal texts give equal
    values; ids are not used, so null or repeated ids are kept as they are. Very long texts are transformed part by part. A text without
    a peak has an empty fingerprint. An empty table gives no row.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in common.texts_of(batch, "text"):
            n, data = payload(text)
            stored = to_wav(data)
            back = from_wav(stored)
            codes = fingerprint(back)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), common.crc(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), ",".join(map("{:x}".format, codes.tolist())), codes, *[stored] * media))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), *[pa.binary()] * media), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint", *["media"] * media])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_text(rows, "text", kernel, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>" + ", media binary" * media)
