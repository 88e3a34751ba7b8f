"""Custom metric groups beside the built-in ones: as groups by name, and as table functions of SQL.

A group is a function of samples (channels, frames) and rate that gives metrics as dictionaries or tuples (name, value, unit,
higher_is_better, (low, high), warning), of which only the name is needed. It runs in the tasks, a recording at a time. A
group that fails for a recording gives one row there with the failure as its warning; the other groups and recordings go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import groups
from .frames import recordings

Group = Callable[[np.ndarray, int], Iterable[dict | tuple]]

ALL = "all"
FACTS = "path string, pos int, grp string, name string, value double, unit string, higher_is_better boolean, ref_lo double, ref_hi double, warning string"
KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.string()]

_custom: dict[str, Group] = {}


def available() -> list[str]:
    """Names of the built-in groups and of the registered ones."""
    return [*groups.GROUPS, *_custom]


def register(name: str, group: Group, overwrite: bool = False) -> None:
    """Add a group; names are trimmed and in lower case. Built-in names can't be taken, other known ones with `overwrite` only."""
    own = name.strip().lower()
    if not own or own == ALL:
        raise ValueError(f"a metric group can't be named {name!r}")
    if own in groups.GROUPS:
        raise ValueError(f"{own!r} is a built-in metric group")
    if own in _custom and not overwrite:
        raise ValueError(f"a metric group {own!r} is there already")
    _custom[own] = group


def unregister(name: str) -> None:
    own = name.strip().lower()
    if own in groups.GROUPS:
        raise ValueError(f"{own!r} is a built-in metric group")
    del _custom[own]


def chosen(names: Iterable[str]) -> list[str]:
    """Known groups by name, without repeats; `all` stands for each of them."""
    out: list[str] = []
    for name in names:
        own = name.strip().lower()
        if own != ALL and own not in available():
            raise ValueError(f"unknown group {name!r}; choose from {available()}")
        out += available() if own == ALL else [own]
    return list(dict.fromkeys(out))


def _row(metric: dict | tuple) -> tuple:
    m = metric if isinstance(metric, dict) else dict(zip(("name", "value", "unit", "higher_is_better", "bounds", "warning"), metric))
    value = m.get("value")
    value = None if value is None or not math.isfinite(float(value)) else float(value)
    low, high = m.get("bounds") or (None, None)
    return str(m["name"]), value, m.get("unit") or "", m.get("higher_is_better"), low, high, m.get("warning")


def _computed(name: str, group: Group, x: np.ndarray, rate: int) -> list[tuple]:
    try:
        return [(name, *_row(m)) for m in group(x, rate)]
    except Exception as e:  # noqa: BLE001  whatever a custom group raises stays with its own rows
        return [(name, name, None, "", None, None, None, f"{type(e).__name__}: {e}")]


def custom_facts(audio: DataFrame, names: Iterable[str]) -> DataFrame:
    """A row a metric of registered groups for audio rows (path, sample_rate, samples by channel)."""
    own = {n: _custom[n] for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rate, x in recordings(batches):
            rows = [(path, pos, *r) for pos, r in enumerate(r for n, g in own.items() for r in _computed(n, g, x, rate))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=[f.split()[0] for f in FACTS.split(", ")])

    return audio.where("samples is not null and sample_rate > 0").select("path", "sample_rate", "samples").mapInArrow(run, FACTS)


def facts(audio: DataFrame, names: Iterable[str] = (ALL,)) -> DataFrame:
    """A row a metric of built-in and registered groups."""
    wanted = chosen(names)
    built_in, custom = [n for n in wanted if n in groups.GROUPS], [n for n in wanted if n in _custom]
    parts = ([groups.metric_facts(audio, built_in)] if built_in else []) + ([custom_facts(audio, custom)] if custom else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def as_table_function(spark: SparkSession, name: str) -> str:
    """Register a custom group as a table function of SQL, metric_group_NAME(samples, sample_rate); its name is returned."""
    own, group = name.strip().lower(), _custom[name.strip().lower()]

    @udtf(returnType="name string, value double, unit string, higher_is_better boolean, ref_lo double, ref_hi double, warning string")
    class Metrics:
        def eval(self, samples, rate):
            if samples and samples[0]:
                for row in _computed(own, group, np.array(samples, np.float64), int(rate)):
                    yield row[1:]

    spark.udtf.register(f"metric_group_{own}", Metrics)
    return f"metric_group_{own}"


def failures(rows: DataFrame) -> DataFrame:
    """path, grp and message of the custom groups that failed."""
    return rows.where(F.col("value").isNull() & (F.col("name") == F.col("grp")) & F.col("warning").isNotNull()).select("path", "grp", F.col("warning").alias("message"))
