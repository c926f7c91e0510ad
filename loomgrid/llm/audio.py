"""Audio features of 8-bit samples: polyphase resampling, log-mel frames, energy segments.

A media value is a mono WAV file of unsigned 8-bit PCM samples at 24 kHz.  Its features are made alone,
so equal bytes give equal features, in blocks of frames, so that besides the bytes and the tensors memory doesn't
grow with the length: resampling by 2/3 to 16 kHz with a windowed-sinc filter split into its two phases; frames of
400 samples every 160; 40 log-mel bands from a 512-point FFT; segments by two thresholds on the frame energy
(a segment opens at the upper one and closes below the lower one, both relative to the unit's range).
Tensors have the fixed shape (FRAMES, MELS) of float16, padded with the floor value, with their time span; they are
stored as Arrow streams of fixed-shape tensors, and read back for the digests.

Edge cases: a null or empty text becomes one padded unit; a unit of even energy is one segment; non-finite values
can't arise; an empty table gives no rows; rows that repeat get equal rows; very long texts are whole, and taken in
slices of bounded rows and bytes; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

UNIT, PAD = 192, b" "
RATE, UP, DOWN = 24_000, 2, 3
OUT_RATE = RATE * UP // DOWN
TAPS = 24  # a phase
WINDOW, HOP, FFT, MELS = 400, 160, 512, 40
FRAMES = 64
FLOOR = np.float32(-10.0)
OPEN, CLOSE, MIN_FRAMES = 0.6, 0.4, 3


def to_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono PCM in a WAV container."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of ``to_wav``'s file."""
    f = io.BytesIO(media)
    riff, _, wave = struct.unpack("<4sI4s", f.read(12))
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAV file")
    while head := f.read(8):
        kind, size = struct.unpack("<4sI", head)
        body = f.read(size)
        if kind == b"fmt " and struct.unpack_from("<HHIIHH", body)[:3] + struct.unpack_from("<HHIIHH", body)[5:] != (1, 1, RATE, 8):
            raise ValueError("not 8-bit mono PCM at the expected rate")
        if kind == b"data":
            return body
    raise ValueError("no samples")


def pad(raw: bytes) -> bytes:
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


@cache
def _phases() -> np.ndarray:
    """The filter's taps for each of the UP phases, over TAPS input samples: (TAPS, UP)."""
    n = TAPS * UP
    t = (np.arange(n) - n / 2) / UP
    cut = UP / DOWN
    h = cut * np.sinc(cut * t) * (0.54 + 0.46 * np.cos(2 * np.pi * t / TAPS))
    h /= h.sum() / UP
    return h.reshape(TAPS, UP)[::-1].astype(np.float32).copy()


def resample(x: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Output samples start..stop (start a multiple of UP) of ``x`` (8-bit, or floats) resampled by UP/DOWN, zeros beyond its ends."""
    groups = -(-(stop - start) // UP)
    first = start // UP * DOWN - TAPS // 2 + 1
    need = DOWN * (groups - 1) + TAPS + 1
    lo, hi = max(first, 0), min(first + need, len(x))
    seg = np.zeros(need, np.float32)
    if hi > lo:
        seg[lo - first : hi - first] = (x[lo:hi].astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else x[lo:hi]
    h = _phases()
    strided = np.lib.stride_tricks.sliding_window_view(seg, TAPS)
    y = np.empty((groups, UP), np.float32)
    for p in range(UP):  # output UP*g+p lies at input DOWN*g + p*DOWN/UP
        at = p * DOWN
        y[:, p] = np.ascontiguousarray(strided[at // UP :: DOWN][:groups]) @ h[:, at % UP]
    return y.reshape(-1)[: stop - start]


@cache
def _mel() -> np.ndarray:
    """Triangular mel bands over the FFT's bins: (FFT // 2 + 1, MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * OUT_RATE / FFT
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def _hann() -> np.ndarray:
    return np.hanning(WINDOW).astype(np.float32)


def n_frames(n_samples: int) -> int:
    out = n_samples * UP // DOWN
    return max(1, -(-max(out - WINDOW, 0) // HOP) + 1)


def blocks(payload: bytes, per_block: int = FRAMES * 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first frame, log-mel frames, frame energies in dB), a bounded number of frames at a time."""
    x = np.frombuffer(payload, np.uint8)
    total, out = n_frames(len(x)), len(x) * UP // DOWN
    for first in range(0, total, per_block):
        n = min(per_block, total - first)
        start, need = first * HOP, (n - 1) * HOP + WINDOW
        y = np.zeros(need, np.float32)
        have = min(out, start + need) - start
        y[:have] = resample(x, start, start + have)
        frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * _hann()
        spectrum = np.fft.rfft(frames, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        yield first, np.maximum(np.log10(np.maximum(power @ _mel(), 1e-10)), FLOOR).astype(np.float32), 10 * np.log10(np.maximum(power.sum(1), 1e-10))


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame spans by hysteresis between the 5th and 95th percentile of the energies."""
    lo, hi = np.percentile(energy, (5, 95))
    if hi - lo < 1e-6:
        return [(0, len(energy))]
    upper, lower = lo + OPEN * (hi - lo), lo + CLOSE * (hi - lo)
    state = np.where(energy >= upper, 1, np.where(energy < lower, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(at >= 0, state[np.maximum(at, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= MIN_FRAMES]


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n, FRAMES, MELS) with their time spans, and the segments' time spans, in seconds."""
    frames = n_frames(len(payload))
    n = -(-frames // FRAMES)
    tensor, energy = np.full((n * FRAMES, MELS), FLOOR, np.float16), np.empty(frames, np.float32)
    for first, mel, power in blocks(payload):
        tensor[first : first + len(mel)], energy[first : first + len(mel)] = mel, power
    second = lambda frame: frame * HOP / OUT_RATE
    spans = [(second(k * FRAMES), second(min((k + 1) * FRAMES, frames))) for k in range(n)]
    return tensor.reshape(n, FRAMES, MELS), spans, [(second(a), second(b)) for a, b in segments(energy)]


TENSOR = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS))


def tensor_stream(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of rows (log_mel, start_s, end_s): fixed-shape tensors with their time spans."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), FRAMES * MELS)
    a, b = zip(*spans, strict=True)
    rows = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, flat), pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["log_mel", "start_s", "end_s"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors (n, FRAMES, MELS), and the starts and ends of their spans, of ``tensor_stream``'s bytes."""
    rows = pa.ipc.open_stream(stream).read_all().combine_chunks()
    if rows.schema.field("log_mel").type != TENSOR:
        raise ValueError("not a stream of log-mel tensors")
    tensors = rows.column("log_mel").combine_chunks()
    tensors = tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors
    return tensors.to_numpy_ndarray(), rows.column("start_s").to_numpy(), rows.column("end_s").to_numpy()


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column (doc_id, n_bytes, media) written to the shared folder and read back."""
    return scratch.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary"))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))


_FACTS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
_TENSORS = _FACTS | {"tensors": pa.binary(), "segment_start_s": pa.list_(pa.float64()), "segment_end_s": pa.list_(pa.float64())}
_DIGEST = _FACTS | {"feature": pa.string(), "n_tensors": pa.int64(), "n_segments": pa.int64()}
FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def _tensors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 256):
        out: list[tuple] = []
        for doc_id, n, media in zip(*(batch.column(k) for k in ("doc_id", "n_bytes", "media")), strict=True):
            stored = media.as_py()
            payload = from_wav(stored)
            tensors, spans, found = features(payload)
            facts = (doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
            out.append((*facts, tensor_stream(tensors, spans), [a for a, _ in found], [b for _, b in found]))
        yield _batch(out, _TENSORS)


def audio_tensors(media: DataFrame) -> DataFrame:
    """The stored media's ids, sizes and digests, with (tensors, segment_start_s, segment_end_s); ``tensors`` is
    ``tensor_stream``'s."""
    return media.mapInArrow(_tensors, FACTS + ", tensors binary, segment_start_s array<double>, segment_end_s array<double>")


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    facts = list(_FACTS)
    for batch in slices(batches, "tensors", 256):
        out: list[tuple] = []
        for *kept, stream, begins, ends in zip(*(batch.column(k).to_pylist() for k in (*facts, "tensors", "segment_start_s", "segment_end_s")), strict=True):
            tensors, a, b = read_tensors(stream)
            h = hashlib.sha256(np.ascontiguousarray(tensors, "<f2").tobytes())
            h.update(np.round(np.concatenate([a, b, begins, ends]) * 1000).astype("<i4").tobytes())
            out.append((*kept, h.hexdigest(), len(tensors), len(begins)))
        yield _batch(out, _DIGEST)


def digest(tensors: DataFrame) -> DataFrame:
    """The facts of ``audio_tensors``' rows, a digest of each one's tensors and spans, and how many there are."""
    return tensors.mapInArrow(_digest, FACTS + ", feature string, n_tensors long, n_segments long")


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "audio")
    return digest(scratch.save(audio_tensors(store_media(table(spark, sf_dir, "documents"), scratch))))
