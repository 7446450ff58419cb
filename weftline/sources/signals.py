"""Biosignals (EDF, BDF) and the headers of image volumes (MHD, DICOM)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.sources.readers import reader


@dataclass(frozen=True)
class Channel:
    label: str
    unit: str
    physical_min: float
    physical_max: float
    digital_min: int
    digital_max: int
    samples: int
    rate: float


@dataclass(frozen=True)
class Recording:
    start: str
    records: int
    record_seconds: float
    header_bytes: int
    width: int
    channels: list[Channel]


def edf_header(data: bytes) -> Recording:
    """The header of an EDF (16-bit) or BDF (24-bit) file; repeated labels get a number."""
    if len(data) < 256:
        raise ValueError("not an EDF file: shorter than its header")
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    n = int(text(252, 4))
    at, cols = 256, []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        cols.append([text(at + k * width, width) for k in range(n)])
        at += n * width
    seconds = float(text(244, 8) or 1)
    channels, seen = [], {}
    for k in range(n):
        label = cols[0][k]
        seen[label] = seen.get(label, -1) + 1
        name = label if not seen[label] else f"{label}_{seen[label]}"
        samples = int(cols[8][k])
        channels.append(Channel(name, cols[2][k], float(cols[3][k] or 0), float(cols[4][k] or 0), int(cols[5][k] or 0), int(cols[6][k] or 0), samples, samples / seconds if seconds else float(samples)))
    return Recording(f"{text(168, 8)} {text(176, 8)}", int(text(236, 8)), seconds, int(text(184, 8)), 3 if data[0] == 255 else 2, channels)


def edf_samples(data: bytes) -> Iterator[tuple[Channel, np.ndarray]]:
    """(channel, physical values) of all channels but annotations."""
    h = edf_header(data)
    per = sum(c.samples for c in h.channels)
    raw = np.frombuffer(data, np.uint8, offset=h.header_bytes)
    records = len(raw) // (per * h.width)
    raw = raw[: records * per * h.width].reshape(records, per, h.width)
    if h.width == 2:
        digits = raw.copy().view("<i2")[:, :, 0].astype(np.int64)
    else:
        digits = raw[:, :, 0].astype(np.int64) | raw[:, :, 1].astype(np.int64) << 8 | raw[:, :, 2].astype(np.int8).astype(np.int64) << 16
    at = 0
    for c in h.channels:
        part = digits[:, at : at + c.samples].ravel()
        at += c.samples
        if "Annotations" in c.label:
            continue
        span = c.digital_max - c.digital_min
        scale = (c.physical_max - c.physical_min) / span if span else 1.0
        yield c, (part - c.digital_min) * scale + c.physical_min


@reader("EDF", "BDF")
def read_edf(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """``file_name, channel, sample_idx, t, value``: one row per sample, t in seconds from the start."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for c, values in edf_samples(content):
                    for at in range(0, len(values), 100_000):
                        v = values[at : at + 100_000]
                        k = np.arange(at, at + len(v))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(v), pa.string()), pa.array([c.label] * len(v), pa.string()), pa.array(k, pa.int64()), pa.array(k / c.rate, pa.float64()), pa.array(v, pa.float64())], names=["file_name", "channel", "sample_idx", "t", "value"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(rows, "file_name string, channel string, sample_idx bigint, t double, value double")


def mhd_header(text: str) -> dict[str, str]:
    """The key = value lines of a MetaImage header."""
    return {k.strip(): v.strip() for k, sep, v in (x.partition("=") for x in text.splitlines()) if sep}


_LONG = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN")
# The tags that are read.
TAGS = {(0x28, 0x10): "rows", (0x28, 0x11): "columns", (0x28, 0x08): "frames", (0x28, 0x30): "spacing", (0x18, 0x50): "thickness", (0x08, 0x60): "modality", (0x28, 0x100): "bits"}


def dicom_header(data: bytes) -> dict[str, object]:
    """Size, spacing and kind of a DICOM image of explicit little-endian syntax."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, out = 132, {}
    while at + 8 <= len(data):
        tag = struct.unpack_from("<HH", data, at)
        vr = data[at + 4 : at + 6]
        size, at = (struct.unpack_from("<I", data, at + 8)[0], at + 12) if vr in _LONG else (struct.unpack_from("<H", data, at + 6)[0], at + 8)
        if tag == (0x7FE0, 0x10) or size == 0xFFFFFFFF:
            break
        if tag in TAGS:
            raw = data[at : at + size]
            out[TAGS[tag]] = struct.unpack("<H", raw[:2])[0] if vr == b"US" else raw.decode("latin-1").strip(" \0")
        at += size
    return out
