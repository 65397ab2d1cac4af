"""Media columns: 8-bit WAV blobs, and spectral-peak pair fingerprints of them as time-coded arrays."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, text_bytes

RATE = 8000
ALIGN = 64
WINDOW, HOP = 256, 128
#: Edges of the frequency bands that each give one peak a frame at most.
BANDS = (1, 6, 14, 32, 64, 129)
#: A peak is the largest of its band over so many frames before and after it.
REACH = 4
#: Pairs a peak makes with later peaks, and the frames between them at most.
FAN, SPAN = 3, 31
#: Frames that are transformed at once.
BLOCK = 4096


def pad(body: bytes) -> bytes:
    """``body`` with bytes 0 up to a positive multiple of 64."""
    return body.ljust(max(ALIGN, -(-len(body) // ALIGN) * ALIGN), b"\0")


def write_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(blob: bytes) -> bytes:
    with wave.open(io.BytesIO(blob), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest magnitude and its bin for each frame and band, by short-time Fourier transforms in blocks of frames."""
    x = samples.astype(np.float32) - 128.0
    frames = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    x = np.pad(x, (0, (frames - 1) * HOP + WINDOW - len(x)))
    windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    taper = np.hanning(WINDOW).astype(np.float32)
    top = np.empty((frames, len(BANDS) - 1), np.float32)
    at = np.empty((frames, len(BANDS) - 1), np.int64)
    for s in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(windows[s : s + BLOCK] * taper, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            where = power[:, lo:hi].argmax(axis=1)
            at[s : s + BLOCK, b] = where + lo
            top[s : s + BLOCK, b] = power[np.arange(len(power)), where + lo]
    return top, at


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, frames): pairs of spectral peaks as ``bin << 16 | later bin << 8 | frames between``, coded by the first's frame."""
    top, at = band_peaks(np.frombuffer(samples, np.uint8))
    n = len(top)
    around = np.pad(top, ((REACH, REACH), (0, 0)), constant_values=-1)
    largest = np.lib.stride_tricks.sliding_window_view(around, 2 * REACH + 1, axis=0).max(axis=2)
    t, band = np.nonzero((top >= largest) & (top > 1e-3))
    f = at[t, band]
    hashes, times = [], []
    for later in range(1, FAN + 1):
        gap = t[later:] - t[:-later]
        ok = (gap >= 0) & (gap <= SPAN)
        hashes.append(((f[:-later] << 16) | (f[later:] << 8) | gap)[ok])
        times.append(t[:-later][ok])
    h, when = np.concatenate(hashes), np.concatenate(times)
    order = np.lexsort((h, when))
    return h[order].astype(np.int32), when[order].astype(np.int32) if n else when.astype(np.int32)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("hashes", pa.list_(pa.int32())), ("frames", pa.list_(pa.int32()))]
)
#: Bytes of text after which a batch of results is passed on.
RESULT_BYTES = 2 << 20


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, payload (read back), media (WAV), hashes and frames (the time-coded pairs).

    Null text counts as empty, and the empty text becomes 64 samples of 0. Texts have no length limit: transforms run
    over blocks of frames. Equal texts give equal values; repeated rows and null doc_ids pass through. An empty table
    gives an empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        for b in batches:
            for doc, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                media = write_wav(pad(body))
                back = read_wav(media)
                held.append((doc, len(body), back, media, *fingerprints(back)))
                size += len(back)
                if size >= RESULT_BYTES:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    bounded_batches(docs.sparkSession, 256)
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("body")).mapInArrow(run, "doc_id long, n_bytes long, payload binary, media binary, hashes array<int>, frames array<int>")


def media_digest(docs: DataFrame) -> DataFrame:
    """``media_columns`` with digests of its columns instead of the payload: sizes, checksums, and the feature.

    feature is the SHA-256 of the pairs as text: hashes, a space, frames, each with commas between. Rows, nulls and
    repeats are as in ``media_columns``.
    """
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    payload = F.col("payload")
    return media_columns(docs).select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substr(payload, F.octet_length(payload) - ALIGN + 1, F.lit(ALIGN))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.sha2(F.concat_ws(" ", joined("hashes"), joined("frames")).cast("binary"), 256).alias("feature"),
        F.size("hashes").cast("long").alias("n_pairs"),
        "hashes",
        "frames",
        "media",
    )
