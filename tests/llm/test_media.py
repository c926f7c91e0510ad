"""Audio features and WARC archives."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from loomgrid.llm import audio as A
from loomgrid.llm import warc as W
from loomgrid.llm.common import Scratch
from tests.llm.data import SCHEMA, documents


def test_payloads_come_back():
    for raw in (b"", b"x", bytes(range(256)) * 3, b" " * 192):
        p = A.pad(raw)
        assert len(p) % 192 == 0 and len(p) > 0 and p.startswith(raw)
        assert A.from_wav(A.to_wav(p)) == p


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 1000 * np.arange(48_000) / A.RATE).astype(np.float32)
    want = np.sin(2 * np.pi * 1000 * np.arange(32_000) / A.OUT_RATE)
    whole = A.resample(x, 0, 32_000)
    assert np.abs(whole - want)[200:-200].max() < 0.01
    assert np.array_equal(A.resample(x, 640, 2000), whole[640:2000])


def test_blocks_don_t_change_features():
    raw = A.pad(np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8).tobytes())
    a = np.concatenate([m for _, m, _ in A.blocks(raw)])
    b = np.concatenate([m for _, m, _ in A.blocks(raw, 100)])
    assert a.shape == b.shape and np.abs(a - b).max() < 1e-3


def test_a_loud_part_is_a_segment_and_a_tone_its_band():
    t = np.arange(A.RATE * 3)
    wave = np.where((t > A.RATE) & (t < 2 * A.RATE), np.sin(2 * np.pi * 2000 * t / A.RATE), 0.001 * np.sin(t))
    tensors, spans, found = A.features(A.pad((wave * 127 + 128).astype(np.uint8).tobytes()))
    assert tensors.shape[1:] == (A.FRAMES, A.MELS) and len(spans) == len(tensors)
    assert len(found) == 1 and abs(found[0][0] - 1) < 0.05 and abs(found[0][1] - 2) < 0.05
    band = tensors.reshape(-1, A.MELS)[150].argmax()
    assert A._mel()[:, band].argmax() * A.OUT_RATE / A.FFT == pytest_approx(2000, 200)


def pytest_approx(value, tolerance):
    import pytest

    return pytest.approx(value, abs=tolerance)


def plain_features(payload):
    """Log-mel frames and segments from their definitions, sample by sample."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n, half = A.TAPS * A.UP, A.TAPS * A.UP / 2
    t = (np.arange(n) - half) / A.UP
    h = A.UP / A.DOWN * np.sinc(A.UP / A.DOWN * t) * (0.54 + 0.46 * np.cos(2 * np.pi * t / A.TAPS))
    h /= h.sum() / A.UP
    wide = np.zeros(len(x) * A.UP + 2 * n)
    wide[n : n + len(x) * A.UP : A.UP] = x  # zeros between the samples, filtered, and every third kept
    y = np.convolve(wide, h)[n + int(half) :][: len(x) * A.UP : A.DOWN][: len(x) * A.UP // A.DOWN]
    frames = []
    for k in range(A.n_frames(len(x))):
        part = np.zeros(A.WINDOW)
        got = y[k * A.HOP : k * A.HOP + A.WINDOW]
        part[: len(got)] = got
        frames.append(np.abs(np.fft.rfft(part * np.hanning(A.WINDOW), A.FFT)) ** 2)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20), mel(A.OUT_RATE / 2), A.MELS + 2)]
    bands = np.array([[max(0, min((f - a) / (b - a), (c - f) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)] for f in np.arange(A.FFT // 2 + 1) * A.OUT_RATE / A.FFT])
    power = np.array(frames)
    return np.log10(np.maximum(power @ bands, 1e-10)), 10 * np.log10(np.maximum(power.sum(1), 1e-10))


def plain_segments(energy):
    lo, hi = np.percentile(energy, (5, 95))
    if hi - lo < 1e-6:
        return [(0, len(energy))]
    spans, start = [], None
    for k, e in enumerate([*energy, -np.inf]):
        if start is None and e >= lo + A.OPEN * (hi - lo):
            start = k
        elif start is not None and e < lo + A.CLOSE * (hi - lo):
            spans += [(start, k)] * (k - start >= A.MIN_FRAMES)
            start = None
    return spans


def test_features_by_definition():
    r = np.random.default_rng(3)
    for n in (192, 192 * 30, 192 * 101):
        loud = np.repeat(r.random(n // 192), 192)
        raw = (128 + 127 * loud * np.sin(np.arange(n) * 0.3) * r.random(n)).astype(np.uint8).tobytes()
        mel, energy = plain_features(raw)
        tensors, spans, found = A.features(raw)
        assert np.abs(tensors.reshape(-1, A.MELS)[: len(mel)] - mel).max() < 0.01
        assert (tensors.reshape(-1, A.MELS)[len(mel) :] == A.FLOOR).all() and spans[-1][1] == len(mel) * A.HOP / A.OUT_RATE
        got = np.concatenate([e for _, _, e in A.blocks(raw)])
        assert np.abs(got - energy).max() < 0.01
        assert A.segments(got) == plain_segments(got) and len(found) == len(plain_segments(got))


def test_audio_tables(spark):
    docs = spark.createDataFrame([(*x, "m") for x in documents()], SCHEMA + ", media string")
    scratch = Scratch(spark, "t")
    stored = scratch.save(A.audio_tensors(A.store_media(docs, scratch)))
    rows = A.digest(stored).collect()
    texts = {i: (t or "").encode() for i, t, *_ in documents()}
    for r in rows:
        p = A.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_sha256, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(p) + 44, hashlib.sha256(A.to_wav(p)).hexdigest())
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in by.values()) and len({r.feature for r in rows}) > 100
    one = stored.where("doc_id = 7").first()
    read = pa.ipc.open_stream(io.BytesIO(one.tensors)).read_all()
    assert read.schema.field("log_mel").type == A.TENSOR
    tensors, begins, _ = A.read_tensors(one.tensors)
    want, spans, found = A.features(A.pad(texts[7]))
    assert np.array_equal(tensors, want) and list(begins) == [a for a, _ in spans] and one.segment_start_s == [a for a, _ in found]
    assert A.store_media(docs.limit(0), scratch).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, rows):
    return W.read_archives(W.write_archives(pages(spark, rows), Scratch(spark, "t")))


def plain_warc(rows):
    """(page_id, bytes, digest, type, refers_to) of each page from the definition."""
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, url, html in rows:
        raw = (html or "").encode()
        to = first[html or ""] if i is not None and first[html or ""] < i else None
        out.append((i, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    body = "<html>" + "some text that repeats " * 50
    rows = [(k, f"http://h/{k}", body + str(k % 40)) for k in range(200)] + [(500, None, None), (501, "http://e", ""), (None, "http://n", "alone"), (600, "http://l", "x" * (3 << 20))]
    rows += [(3, "http://h/3", body + "3"), (3, "http://other", body + "3"), (3, "http://h/3", "another body"), (700, "http://a\r\nb%0D", "ü \r\n\r\n x"), (None, None, body + "1")]
    assert sorted(map(tuple, round_trip(spark, rows).collect()), key=repr) == plain_warc(rows)
    extra = pages(spark, rows).withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit("x")).withColumn("payload", F.lit(2))
    assert W.read_archives(W.write_archives(extra, Scratch(spark, "t"))).count() == len(rows)
    assert round_trip(spark, []).count() == 0


def test_query_is_the_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    want = [(i, *x) for i, _, *x in plain_warc(rows)]
    assert sorted(map(tuple, W.op8_warc(spark, folder).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n, size", [(1, 0), (1, 100), (1, 3 << 20), (3, 50), (6, 2_500_000), (50, 330_000), (300, 250)])
def test_every_archive_has_its_dictionary(n, size):
    r = random.Random(n)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(max(1, size // 7)))[:size].encode()
    records = [W.build_record(k, "u", text[k % 7 :] + str(k).encode(), place=str(k)) for k in range(n)]
    packed = W.pack(records)
    at = int.from_bytes(packed[4:8], "little")
    assert int.from_bytes(packed[:4], "little") == 0x184D2A5D and at > 0
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed[8 : 8 + at]))
    with d.stream_reader(io.BytesIO(packed), read_across_frames=True) as f:  # skippable frames are skipped
        assert f.read() == b"".join(records)
    assert list(W.unpack(packed)) == records


def test_records_are_warc():
    fields, payload = W.parse_record(W.build_record(7, "http://h/", b"<p>"))
    assert payload == b"<p>" and set(fields) >= {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type", "Content-Length", "WARC-Payload-Digest"}
    again, nothing = W.parse_record(W.build_record(8, "http://h/8", b"<p>", 7, "http://h/"))
    assert nothing == b"" and again["Content-Length"] == "0" and again["WARC-Refers-To-Target-URI"] == "http://h/"
    assert len({W.parse_record(W.build_record(7, "http://h/", b"<p>", place=str(k)))[0]["WARC-Record-ID"] for k in range(9)}) == 9
