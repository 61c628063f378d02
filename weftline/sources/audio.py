"""PCM audio in RIFF/WAVE containers and raw float files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Wave:
    rate: int
    channels: int
    bits: int
    samples: np.ndarray  # (frames, channels), integers

    def as_float(self) -> np.ndarray:
        """Samples in -1..1; 8-bit ones are unsigned in the file."""
        return (self.samples - 128) / 128 if self.bits == 8 else self.samples / float(1 << self.bits - 1)


def parse_wave(data: bytes) -> Wave:
    """Uncompressed PCM of 8, 16, 24 or 32 bits; other chunks are passed over, odd ones with their pad byte."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if code != 1:
                raise ValueError(f"compression code {code}")
            if not channels or align != channels * ((bits + 7) // 8) or bits not in (8, 16, 24, 32):
                raise ValueError("inconsistent format chunk")
            form = channels, rate, bits
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            channels, rate, bits = form
            width = bits // 8
            raw = np.frombuffer(body[: len(body) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
            if bits == 8:
                values = raw[:, 0].astype(np.int64)
            else:
                values = sum(raw[:, k].astype(np.int64) << 8 * k for k in range(width))
                values = np.where(values >= 1 << bits - 1, values - (1 << bits), values)
            return Wave(rate, channels, bits, values.reshape(-1, channels))
        at += 8 + size + size % 2
    raise ValueError("no data")


def render_wave(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A file of samples in -1..1, (frames,) or (frames, channels); values beyond are clipped, an odd chunk is padded."""
    x = np.atleast_2d(np.asarray(samples, float).T).T
    most = (1 << bits - 1) - 1
    ints = np.clip(np.trunc(x * most), -most - 1, most).astype(np.int64) + (128 if bits == 8 else 0)
    width = bits // 8
    body = np.stack([(ints >> 8 * k) & 0xFF for k in range(width)], -1).astype(np.uint8).tobytes()
    form = struct.pack("<HHIIHH", 1, x.shape[1], rate, rate * x.shape[1] * width, x.shape[1] * width, bits)
    chunks = b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, channels, valid_bits, n_frames, samples (interleaved); a file that isn't PCM has nulls and an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    w = parse_wave(bytes(content))
                    rows.append((name, w.rate, w.channels, w.bits, len(w.samples), w.samples.reshape(-1).tolist(), None))
                except (ValueError, struct.error) as error:
                    rows.append((name, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "valid_bits", "n_frames", "samples", "error"]).astype({c: "Int64" for c in ("sample_rate", "channels", "valid_bits", "n_frames")})

    return files.mapInPandas(parse, "path string, sample_rate int, channels int, valid_bits int, n_frames long, samples array<int>, error string")


def channel(samples: Column, channels: Column, number: int) -> Column:
    """One channel of interleaved samples."""
    return F.filter(samples, lambda _, i: i % channels == number)


def frames_between(samples: Column, channels: Column, first: int, n: int) -> Column:
    return F.slice(samples, F.lit(first) * channels + 1, F.lit(n) * channels)


def as_floats(samples: Column, bits: Column) -> Column:
    return F.transform(samples, lambda x: x / F.pow(F.lit(2.0), bits - 1))


def sample_rows(waves: DataFrame) -> DataFrame:
    """path, i, sample."""
    return waves.select("path", F.posexplode("samples").alias("i", "sample"))


def wave_bytes(samples: Column, rate: int) -> Column:
    """Binary column: a mono 16-bit file of an array of samples in -1..1."""

    @F.pandas_udf("binary")
    def render(col: pd.Series) -> pd.Series:
        return pd.Series([render_wave(np.array(x, float), rate) if x is not None else None for x in col])

    return render(samples)


def float_bytes(values: Column, little: bool = True) -> Column:
    """Binary column: raw 32-bit floats."""

    @F.pandas_udf("binary")
    def dump(col: pd.Series) -> pd.Series:
        return pd.Series([np.array(x, "<f4" if little else ">f4").tobytes() if x is not None else None for x in col])

    return dump(values)


def parse_densities(data: bytes, states: list[int], order: int, weighted: bool) -> list[tuple[int, int, list[float], list[float], float | None]]:
    """(state, leaf, mean, var, weight) of big-endian floats: leaves per state, then for each its means and variances
    (interleaved), and after them a voicing weight if weighted."""
    values = np.frombuffer(data, ">f4")
    rows, at = [], 0
    for state, leaves in enumerate(states):
        for leaf in range(1, leaves + 1):
            block = values[at : at + 2 * order]
            at += 2 * order
            weight = None
            if weighted:
                weight, at = float(values[at]), at + 1
            rows.append((state, leaf, block[::2].astype(float).tolist(), block[1::2].astype(float).tolist(), weight))
    return rows


def resampled(samples: Column, rate: int, to: int) -> Column:
    """Array column on another sample rate, linearly."""
    from weftline.functions.signal import resample

    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([resample(np.array(x, float), rate, to).tolist() if x is not None else None for x in col])

    return run(samples)


def within_seconds(samples: Column, rate: Column | int, seconds: float = 10.0) -> Column:
    """Filter for utterances that are not longer."""
    return F.size(samples) <= rate * seconds


def code_pair(samples: Column) -> tuple[Column, Column]:
    """Discrete and continuous companded values of an array of samples in -1..1."""
    from weftline.functions.signal import mulaw, mulaw_code_unsigned

    return F.transform(samples, mulaw_code_unsigned), F.transform(samples, mulaw)


def write_binary(df: DataFrame, name: str, content: str, folder: str) -> int:
    """Write each row's bytes to a file of its name under a folder that executors share; a file appears whole or not at all.

    A task that runs again writes the same files again. Returns how many were written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace(":/", ":///", 1))
        store.create_dir(base, recursive=True)
        for batch in batches:
            for file, data in zip(batch[name], batch[content], strict=True):
                temporary = f"{base}/.{file}.{attempt}"
                with store.open_output_stream(temporary, compression=None) as out:
                    out.write(bytes(data))
                store.move(temporary, f"{base}/{file}")
            yield pd.DataFrame({"n": [len(batch)]})

    return df.select(name, content).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
