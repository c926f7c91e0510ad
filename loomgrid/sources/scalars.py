"""Scalar series of a training run in the event-file format that TensorBoard reads.

A file is a sequence of records: length, its masked checksum, an event message, its masked checksum.  The messages are
small, so they are written field by field.
"""

from __future__ import annotations

import struct
from functools import cache

from pyspark.sql import DataFrame, SparkSession

POLYNOMIAL = 0x82F63B78  # of CRC-32C, reflected


@cache
def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


def masked_crc(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, _table()
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) if kind == 2 else b"") + body


def record(message: bytes) -> bytes:
    size = struct.pack("<Q", len(message))
    return size + struct.pack("<I", masked_crc(size)) + message + struct.pack("<I", masked_crc(message))


def event(wall: float, step: int, tag: str, value: float) -> bytes:
    summary = _field(1, 2, _field(1, 2, tag.encode()) + _field(2, 5, struct.pack("<f", value)))
    return _field(1, 1, struct.pack("<d", wall)) + _field(2, 0, _varint(step)) + _field(5, 2, summary)


def write_scalars(spark: SparkSession, path: str, rows: list[tuple[int, str, float]], wall: float = 0.0) -> None:
    """An event file of (step, tag, value) rows, through Spark's file systems."""
    head = _field(1, 1, struct.pack("<d", wall)) + _field(3, 2, b"brain.Event:2")
    data = b"".join(map(record, [head, *(event(wall, *r) for r in rows)]))
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _fields(data: bytes):
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        size = {0: None, 1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if kind == 0:
            yield key >> 3, varint()
        else:
            yield key >> 3, data[at : at + size]
            at += size


def parse_scalars(data: bytes) -> list[tuple[int, str, float]]:
    """The (step, tag, value) rows of an event file; a wrong checksum is an error."""
    out, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<Q", data, at)[0]
        message = data[at + 12 : at + 12 + size]
        if struct.unpack_from("<I", data, at + 8)[0] != masked_crc(data[at : at + 8]) or struct.unpack_from("<I", data, at + 12 + size)[0] != masked_crc(message):
            raise ValueError("a record's checksum is wrong")
        step = 0
        for number, value in _fields(message):
            if number == 2:
                step = value
            if number == 5:
                for _, one in _fields(value):
                    tag, x = "", 0.0
                    for k, v in _fields(one):
                        tag = v.decode() if k == 1 else tag
                        x = struct.unpack("<f", v)[0] if k == 2 else x
                    out.append((step, tag, x))
        at += 16 + size
    return out


def read_scalars(spark: SparkSession, path: str) -> DataFrame:
    """(path, step, tag, value) of all event files of a folder, or of one."""

    def run(batches):
        import pandas as pd

        for part in batches:
            rows = [(p, *r) for p, c in zip(part["path"], part["content"], strict=True) for r in parse_scalars(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "step", "tag", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, step long, tag string, value double")
