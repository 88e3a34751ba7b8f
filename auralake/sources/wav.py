"""WAV files as rows: discovery and PCM decoding."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.watch import supported

SAMPLES = pa.list_(pa.list_(pa.float32()))
AUDIO = "path string, sample_rate int, channels int, bit_depth int, samples array<array<float>>, error string"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of supported audio files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(supported(F.col("path"))).select("path", "modificationTime", "length")


def decode(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, bits and float samples (channels, frames) of an uncompressed WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    elif width in (2, 4):
        x = np.frombuffer(data, f"<i{width}") / 2.0 ** (8 * width - 1)
    else:
        raise ValueError(f"samples of {width} bytes")
    return rate, 8 * width, x[: len(x) // channels * channels].reshape(-1, channels).T.astype(np.float32)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of float samples (channels, frames)."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[0])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(samples.T * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def samples_of(x: np.ndarray) -> pa.ListArray:
    """One row of samples by channel, on numpy's own buffer."""
    channels, n = x.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(channels + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float32()))
    return pa.ListArray.from_arrays(pa.array([0, channels], pa.int32()), inner)


def decoded(files: DataFrame) -> DataFrame:
    """Audio rows of (path, content); a file that can't be read has an error and no samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one file a batch: samples are large
                path, content = b.column("path")[i].as_py(), b.column("content")[i].as_py()
                try:
                    rate, bits, x = decode(content)
                    row = (path, rate, x.shape[0], bits, samples_of(x), None)
                except Exception as e:  # noqa: BLE001  any broken file is a row with an error
                    row = (path, None, None, None, None, f"{type(e).__name__}: {e}")
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), SAMPLES, pa.string()]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["path", "sample_rate", "channels", "bit_depth", "samples", "error"])

    return files.select("path", "content").mapInArrow(run, AUDIO)


def read_wav(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return decoded(files.where(supported(F.col("path"))))
