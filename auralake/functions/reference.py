"""Measures against a reference recording: segments, the reference's slice of each, and distances between the two.

Segments are cut and their slices found by column expressions. A reference of up to `BROADCAST_SAMPLES` is broadcast as one
row; a longer one is cut into pieces, and each segment joins the pieces that its span touches, so no task holds it whole.

A recording without samples has no segment; a segment beyond the reference's end has an empty slice and no measure. The
reference's channels are averaged, and another rate is resampled to the recording's. A reference without samples is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import voice
from .frames import cepstra, magnitudes, resample
from .groups import METRIC, Metric
from .signal import mean, segment_bounds

#: Samples of all channels of a reference that is broadcast (4 bytes each).
BROADCAST_SAMPLES = 1 << 24
#: Samples in a piece of a longer one.
PIECE = 1 << 20


def segments(audio: DataFrame, seconds: float | None = None) -> DataFrame:
    """path, segment_index, start, end (samples), sample_rate, samples by channel: parts of `seconds`, the last maybe shorter; without `seconds` whole recordings."""
    rows = audio.where("samples is not null and sample_rate > 0").select("path", "sample_rate", "samples", F.coalesce(F.size(F.get("samples", F.lit(0))), F.lit(0)).alias("_n")).where("_n > 0")
    whole = F.array(F.struct(F.lit(1).alias("index"), F.lit(0).alias("start"), F.col("_n").alias("end")))
    each = rows.select("*", F.explode(whole if seconds is None else segment_bounds(F.col("_n"), F.col("sample_rate"), seconds)).alias("_s"))
    part = F.transform("samples", lambda c: F.slice(c, F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")))
    return each.select("path", F.col("_s.index").alias("segment_index"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "sample_rate", part.alias("samples"))


def averaged(samples: Column) -> Column:
    """The mean of the channels."""
    first = F.get(samples, F.lit(0))
    return F.when(F.size(samples) == 1, first.cast("array<double>")).otherwise(F.transform(first, lambda _, i: mean(F.transform(samples, lambda c: F.get(c, i).cast("double")))))


def with_reference(parts: DataFrame, reference: DataFrame) -> DataFrame:
    """parts with ref_rate, ref_start, ref_end and ref_samples: the reference's (one row: sample_rate, samples) over each segment's span of time."""
    spark = parts.sparkSession
    own = reference.where("samples is not null and sample_rate > 0").select(F.col("sample_rate").alias("ref_rate"), "samples")
    sizes = own.select("ref_rate", F.size(F.get("samples", F.lit(0))).alias("n"), F.size("samples").alias("channels")).take(2)
    if len(sizes) != 1 or not sizes[0].n or sizes[0].n < 1:
        raise ValueError("the reference must be one recording with samples")
    rate, n, channels = sizes[0]
    mono = own.select(averaged(F.col("samples")).alias("ref"))
    at = lambda c: F.least(F.rint(F.col(c) * F.lit(float(rate)) / F.col("sample_rate")), F.lit(float(n))).cast("int")
    spans = parts.withColumns({"ref_rate": F.lit(rate), "ref_start": at("start"), "ref_end": at("end")})
    if n * channels <= BROADCAST_SAMPLES:
        joined = spans.crossJoin(F.broadcast(mono))  # one row
        return joined.withColumn("ref_samples", F.slice("ref", F.col("ref_start") + 1, F.col("ref_end") - F.col("ref_start"))).drop("ref")
    starts = spark.range(0, -(-n // PIECE)).select(F.col("id").cast("int").alias("_piece"))
    pieces = mono.crossJoin(starts).select("_piece", F.slice("ref", F.col("_piece") * PIECE + 1, F.lit(PIECE)).alias("_ref"))
    last = F.floor((F.greatest(F.col("ref_end"), F.col("ref_start") + 1) - 1) / PIECE).cast("int")
    key = ["path", "segment_index"]
    touched = spans.select(*key, "ref_start", "ref_end", F.explode(F.sequence(F.floor(F.col("ref_start") / PIECE).cast("int"), last)).alias("_piece")).join(pieces, "_piece")
    low, high = F.greatest(F.col("ref_start") - F.col("_piece") * PIECE, F.lit(0)), F.least(F.col("ref_end") - F.col("_piece") * PIECE, F.lit(PIECE))
    cut = touched.select(*key, "_piece", F.slice("_ref", low + 1, F.greatest(high - low, F.lit(0))).alias("_ref"))
    whole = cut.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_ref"))), lambda p: p["_ref"])).alias("ref_samples"))
    return spans.join(whole, key, "left").withColumn("ref_samples", F.coalesce("ref_samples", F.array().cast("array<double>")))


def distances(y: np.ndarray, r: np.ndarray, rate: int) -> dict:
    """Distortion ratios of two equally long signals in dB, and frame by frame their spectra's distance in dB, their cosine, and their cepstra's distance."""
    eps = np.finfo(np.float64).eps
    ratio = lambda a, b: float(10 * np.log10((a @ a + eps) / (b @ b + eps)))
    y0, r0 = y - y.mean(), r - r.mean()
    target = (y0 @ r0) / (r0 @ r0 + eps) * r0
    out = {"si_sdr": ratio(target, y0 - target), "sdr": ratio(r, y - r), "spectral": [], "cosine": []}
    for a, b in zip(magnitudes(y, 512, 256), magnitudes(r, 512, 256), strict=True):
        out["spectral"].append(np.sqrt(((10 * np.log10((a**2 + eps) / (b**2 + eps))) ** 2).mean(axis=1)))
        out["cosine"].append((a * b).sum(axis=1) / ((np.linalg.norm(a, axis=1) + eps) * (np.linalg.norm(b, axis=1) + eps)))
    return out | {k: np.concatenate(out[k]) if out[k] else np.zeros(0) for k in ("spectral", "cosine")} | {"cepstral": np.sqrt(((cepstra(y, rate, True) - cepstra(r, rate, True)) ** 2).sum(axis=1))}


MEASURES = "path string, segment_index int, start int, end int, si_sdr double, sdr double, spectral array<double>, cosine array<double>, cepstral array<double>"


def compared(parts: DataFrame) -> DataFrame:
    """The measures of `distances` for rows of `with_reference`, over the length that both have; rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                channels, ref = b.column("samples")[i].values, b.column("ref_samples")[i].values
                if channels is None or not len(channels) or ref is None or not len(ref):
                    continue
                rate, ref_rate = b.column("sample_rate")[i].as_py(), b.column("ref_rate")[i].as_py()
                y = channels.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(channels), -1).mean(axis=0)
                r = resample(ref.to_numpy(zero_copy_only=False).astype(np.float64), ref_rate, rate)
                n = min(len(y), len(r))
                if n:
                    d = distances(y[:n], r[:n], rate)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(d[k])], pa.int32()), pa.array(d[k], pa.float64())) for k in ("spectral", "cosine", "cepstral")]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("path", "segment_index", "start", "end")), pa.array([d["si_sdr"]]), pa.array([d["sdr"]]), *lists], names=[f.split()[0] for f in MEASURES.split(", ")])

    return parts.select("path", "segment_index", "start", "end", "sample_rate", "samples", "ref_rate", "ref_samples").mapInArrow(run, MEASURES)


def intrusive() -> list[Metric]:
    spectral, cosine = F.col("spectral_mean"), F.col("cosine_mean")
    return [
        Metric("PESQ proxy", voice.pesq_proxy(spectral), "MOS (approx)", higher=True),
        Metric("STOI proxy", F.round(cosine, 4), "0–1 (approx)", higher=True),
        Metric("SI-SDR", F.col("si_sdr"), "dB", higher=True, bounds=(15.0, 30.0)),
        Metric("SDR (Signal-to-Distortion Ratio)", F.col("sdr"), "dB", higher=True),
        Metric("Log-Spectral Distance", spectral, "dB", higher=False, bounds=(0.0, 4.0)),
        Metric("Spectral Correlation", cosine, higher=True, bounds=(0.9, 1.0)),
        Metric("Cepstral Distance", mean(F.col("cepstral")), "dB", higher=False),
    ]


def intrusive_facts(audio: DataFrame, reference: DataFrame, seconds: float | None = None) -> DataFrame:
    """Metrics of recordings, or of their segments, against a reference: path, segment_index, pos, grp, name, value, unit, higher_is_better, ref_lo, ref_hi, warning."""
    m = compared(with_reference(segments(audio, seconds), reference))
    m = m.withColumns({"spectral_mean": mean(F.col("spectral")), "cosine_mean": mean(F.col("cosine"))})
    own = intrusive()
    values = m.select("path", "segment_index", *(one.value.cast("double").alias(f"v{k}") for k, one in enumerate(own)))
    rows = F.array_compact(F.array(*(one.row("perceptual", F.col(f"v{k}")) for k, one in enumerate(own)))).cast(f"array<{METRIC}>")
    return values.select("path", "segment_index", F.posexplode(rows).alias("pos", "m")).select("path", "segment_index", "pos", "m.*")
