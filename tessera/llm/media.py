"""Media columns: texts kept as 8-bit WAV clips, and spectral-peak pair fingerprints of them.

``store_wav`` writes every payload (UTF-8 bytes, zero-padded to a positive multiple of 64) as
the samples of an unsigned 8-bit mono clip. ``wav_features`` reads the stored clips with the
wave module, takes a short-time Fourier transform in blocks of frames, keeps the bins that
top their neighbourhood in time and frequency, and pairs each peak with the next ones of later frames.
A pair is one integer, (anchor frame << 24) | (anchor bin << 16) | (target bin << 8) | frames
between them, so the array is ordered by time and equal passages share the lower 24 bits.

Behaviour: null and empty texts are 64 zero bytes (silence, no peaks). Texts of any length
are read in blocks. Equal texts give equal clips and features, rows that repeat are answered
each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import table, text_or_empty

RATE, UNIT = 8000, 64
#: Samples in a frame, and from one frame to the next.
FRAME, HOP = 64, 32
#: A peak tops all bins this near in time and frequency, and its frame's mean by this factor.
NEAR_T, NEAR_F, OVER_MEAN = 3, 4, 2.0
#: A peak is paired with as many peaks of later frames, at most so many frames later.
FAN, REACH = 3, 31
BLOCK = 1 << 14
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of every spectral peak, by frame."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    found_t, found_f = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, n, BLOCK):
        lo, hi = max(0, first - NEAR_T), min(n, first + BLOCK + NEAR_T)
        part = samples[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float32) - 128.0
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        size = np.abs(np.fft.rfft(frames * WINDOW, axis=1))[:, 1:]
        top = size
        for axis, near in ((0, NEAR_T), (1, NEAR_F)):
            pad = [(near, near) if k == axis else (0, 0) for k in (0, 1)]
            wide, reach = np.pad(top, pad), top.shape[axis]
            top = np.maximum.reduce([wide[k : k + reach] if axis == 0 else wide[:, k : k + reach] for k in range(2 * near + 1)])
        t, f = np.nonzero((size == top) & (size > OVER_MEAN * size.mean(axis=1, keepdims=True)) & (size > 1e-3))
        own = (t + lo >= first) & (t + lo < first + BLOCK)
        found_t.append(t[own] + lo)
        found_f.append(f[own] + 1)
    return np.concatenate(found_t), np.concatenate(found_f)


def pair_fingerprints(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    made = [np.zeros(0, np.int64)]
    later = np.searchsorted(t, t, side="right")
    for k in range(FAN):
        anchor = np.flatnonzero(later + k < len(t))
        target = later[anchor] + k
        gap = t[target] - t[anchor]
        anchor, target, gap = anchor[gap <= REACH], target[gap <= REACH], gap[gap <= REACH]
        made.append((t[anchor] << 24) | (f[anchor] << 16) | (f[target] << 8) | gap)
    return np.sort(np.concatenate(made))


def store_wav(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the clip of every text."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                texts = [t.as_py().encode() for t in part.column("text")]
                clips = [to_wav(t.ljust(-(-max(len(t), 1) // UNIT) * UNIT, b"\0")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(clips, pa.binary())], names=schema.names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(task, schema)


def wav_features(media: DataFrame) -> DataFrame:
    """What the stored clips hold: payload figures, and fingerprints as an array ordered by time."""
    kind = media.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("n_frames", T.LongType()), ("n_peaks", T.LongType()), ("fingerprints", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = pa.schema([(n, to_arrow_type(t)) for n, t in fields])

    def row(doc_id, n_bytes: int, clip: bytes) -> tuple:
        with wave.open(io.BytesIO(clip)) as w:
            payload = w.readframes(w.getnframes())
        t, f = peaks(np.frombuffer(payload, np.uint8))
        frames = max(0, (len(payload) - FRAME) // HOP + 1)
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(clip), hashlib.sha256(clip).hexdigest(), frames, len(t), pair_fingerprints(t, f)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                rows = [row(i.as_py(), n.as_py(), m.as_py()) for i, n, m in zip(part.column("doc_id"), part.column("n_bytes"), part.column("media"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), arrow)], schema=arrow)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, schema)


def op1_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint array, and the features as one string: frames, peaks, pairs, and a digest of the array."""
    found = wav_features(store_wav(table(spark, sf_dir, "documents")))
    return found.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "concat_ws('-', n_frames, n_peaks, size(fingerprints), lower(hex(xxhash64(fingerprints)))) AS feature", "fingerprints",
    )
