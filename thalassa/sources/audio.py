"""Hydrophone recordings as rows of samples: WAV, recorders that name files by their start, and raw recorder files.

A file is decoded by one task; long recordings are kept as many files by recorders. Files of any store that Spark reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, rate int, bits int, i long, volt double"


def full_scale(bits: int) -> int:
    """The count of the peak voltage; 12 and 24 bits stand in the upper bits of 16 and 32."""
    if bits not in (12, 16, 24, 32):
        raise ValueError(f"samples of {bits} bits are not read")
    return {12: 2**15 - 2**4, 24: 2**31 - 2**8}.get(bits, 2 ** (bits - 1))


def decode_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, bits and counts of the first channel of a WAV file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data":
            data = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    _, channels, rate, _, width, bits = fmt
    size = width // channels
    n = len(data) // width * channels
    if size == 3:
        raw = np.frombuffer(data[: n * 3], np.uint8).reshape(-1, 3)
        counts = np.zeros((len(raw), 4), np.uint8)
        counts[:, 1:] = raw
        counts = counts.view("<i4")[:, 0]
    else:
        counts = np.frombuffer(data[: n * size], {1: np.uint8, 2: "<i2", 4: "<i4"}[size])
    return rate, bits, counts[::channels].astype(np.int64)


def _read(spark: SparkSession, path: str, decode) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rate, bits, volt = decode(bytes(content))
                for lo in range(0, len(volt), 1 << 18):
                    part = volt[lo : lo + (1 << 18)]
                    yield pd.DataFrame({"path": name, "rate": rate, "bits": bits, "i": np.arange(lo, lo + len(part)), "volt": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_hydrophone(spark: SparkSession, path: str, peak_voltage: float) -> DataFrame:
    """path, rate, bits, i, volt of WAV files."""

    def decode(content: bytes):
        rate, bits, counts = decode_wav(content)
        return rate, bits, counts / full_scale(bits) * peak_voltage

    return _read(spark, path, decode)


def sample_time(start: Column) -> Column:
    """The time of a sample, from the start of its file."""
    return F.timestamp_micros(F.unix_micros(start) + F.round(F.col("i") * 1_000_000 / F.col("rate")).cast("long"))


def start_in_name(path: Column) -> Column:
    """The start that a recorder puts before the ending of a file name, as .yymmddhhmmss.wav."""
    return F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(path, r"\.(\d{12})\.[^.]*$", 1)), F.lit("yyyyMMddHHmmss"))


def header_fields(content: bytes) -> dict[str, str]:
    """The `key = value;` lines of a raw recorder file."""
    out = {}
    for line in content[:512].split(b"\n"):
        try:
            key, _, value = line.decode().partition("=")
        except UnicodeDecodeError:
            break
        if value:
            out[key.strip()] = value.strip().rstrip(";").strip("'")
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, bits, i, volt of raw recorder files: 512 bytes of text, then samples of 16 or 24 bits."""

    def decode(content: bytes):
        head = header_fields(content)
        bits = int(float(head["sample_size"]) * 8)
        body = content[512:]
        if bits == 24:
            raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, 1:] = raw
            counts = wide.view("<i4")[:, 0] >> 8
        else:
            counts = np.frombuffer(body[: len(body) // 2 * 2], "<i2")
        return int(float(head["sampling_rate"])), bits, counts / 2 ** (bits - 1) * float(head["adc_vref"])

    return _read(spark, path, decode)


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of one channel of 16 bits, of samples in -1 to 1."""
    body = np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def wav_files(samples: DataFrame, by: list[str], order: str, x: str, rate: int, gain: float = 1, peak: float = 1) -> DataFrame:
    """by, content: the samples of each group as a WAV file; a group has to fit in one task."""
    held = samples.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(x).cast("double").alias("_v")))).alias("_s"))

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return pd.Series([encode_wav(np.asarray(s, float) * gain / peak, rate) for s in v])

    return held.select(*by, encode(F.transform("_s", lambda s: s["_v"])).alias("content"))
