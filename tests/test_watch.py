"""Watching real folders: settling, rewritten, growing, failing, dropped and vanishing files."""

import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from auralake.streaming import folder


def own():
    return dict.fromkeys(folder.NAMES) | {"since": 0.0, "stable": 0, "age": 0, "attempts": 0, "dropped": False}


def story(events, baseline=False, debounce_s=0.0, most_rounds=120, retries=2, backoff_s=2.0):
    """Statuses of one path's events (kind, signature, at)."""
    state, out = own(), []
    for kind, signature, at in events:
        row = SimpleNamespace(kind=kind, signature=signature, at=at, first=at == 0)
        status = folder._seen(state, row, baseline, debounce_s, most_rounds) if kind == "seen" else folder._outcome(state, row, retries, backoff_s)
        out.append(status)
    return out


def seen(*signatures):
    return [("seen", s, float(t)) for t, s in enumerate(signatures)]


@pytest.mark.parametrize(
    "events,settings,want",
    [
        (seen("a", "a", "a"), {}, [None, "ready", None]),
        (seen("a", "b", "b", "b"), {}, [None, None, "ready", None]),
        (seen("a", "a", "a", "b", "b"), {"baseline": True}, [None, None, None, None, "ready"]),
        (seen("a", "a", "a", "a"), {"debounce_s": 3.0}, [None, None, None, "ready"]),
        (seen("a", "a", "b", "b", "b", "b"), {"debounce_s": 3.0}, [None, None, None, None, None, "ready"]),
        (seen("a", "b", "c", "d", "e", "e"), {"most_rounds": 3}, [None, None, None, None, "unstable", None]),
        ([*seen("a", "a"), ("done", "a", 1.5), ("seen", "a", 2.0), ("seen", "b", 3.0), ("seen", "b", 4.0)], {}, [None, "ready", None, None, None, "ready"]),
        ([*seen("a", "a"), ("failed", "a", 1.5), ("seen", "a", 2.0), ("seen", "a", 3.6), ("seen", "a", 4.0)], {}, [None, "ready", "retry", None, None, "ready"]),
        ([*seen("a", "a"), ("failed", "a", 1.0), ("failed", "a", 2.0), ("failed", "a", 3.0), ("seen", "b", 9.0), ("seen", "b", 10.0)], {}, [None, "ready", "retry", "retry", "dropped", None, None]),
        ([*seen("a", "a"), ("seen", "b", 2.0), ("done", "a", 2.5), ("seen", "b", 3.0)], {}, [None, "ready", None, None, "ready"]),
    ],
)
def test_states(events, settings, want):
    assert story(events, **settings) == want


def test_backoff_doubles():
    state = own()
    waits = []
    for k in range(3):
        folder._outcome(state, SimpleNamespace(kind="failed", signature="a", at=100.0), 5, 2.0)
        waits.append(state["retry_at"] - 100)
    assert waits == [2, 4, 8]


def test_listing_shows_every_file_each_round(tmp_path):
    (tmp_path / "below" / "deeper").mkdir(parents=True)
    for name in ("a.wav", "b.txt", "below/c.WAV", "below/deeper/d.flac"):
        (tmp_path / name).write_bytes(b"x")
    reader = folder.ListingReader([str(tmp_path), f"file://{tmp_path}/below"], (".wav", ".flac"))
    first, later = reader.partitions({"round": 0}, {"round": 10**9}), reader.partitions({"round": 10**9}, {"round": 2 * 10**9})
    rows = [r for p in first for r in reader.read(p)]
    assert sorted(r[0].removeprefix("file://").removeprefix(str(tmp_path)) for r in rows) == ["/a.wav", "/below/c.WAV", "/below/c.WAV", "/below/deeper/d.flac", "/below/deeper/d.flac"]
    assert {r[2:] for r in rows} == {(1.0, True)} and {r[2:] for p in later for r in reader.read(p)} == {(2.0, False)}
    assert any(r[0].startswith("file://") for r in rows)


def test_watch_real_folder(spark, tmp_path):
    """Old, new, rewritten, growing, failing and vanishing files, a round at a time and across restarts."""
    place, work, results = tmp_path / "in", str(tmp_path / "work"), str(tmp_path / "out")
    place.mkdir()
    (place / "old.wav").write_bytes(b"old")
    statuses = []

    def analyse(files):
        return files.select("path", F.length("content").cast("long").alias("size"), F.when(F.col("path").contains("bad") | F.col("content").isNull(), "broken").alias("error"))

    def round_():
        states = lambda df, n: statuses.extend((os.path.basename(r.path), r.status, r.attempt) for r in df.collect())
        folder.watch(spark, [str(place)], analyse, results, work, every=None, on_state=states, retries=1, backoff_s=0.0).awaitTermination()
        out, statuses[:] = sorted(statuses), []
        return out

    assert round_() == []  # what is there counts as done
    (place / "new.wav").write_bytes(b"12")
    (place / "bad.wav").write_bytes(b"bad")
    (place / "grows.wav").write_bytes(b"1")
    (place / "gone.wav").write_bytes(b"1")
    assert round_() == []
    (place / "grows.wav").write_bytes(b"1234")
    (place / "gone.wav").unlink()
    assert round_() == [("bad.wav", "ready", 0), ("new.wav", "ready", 0)]
    (place / "old.wav").write_bytes(b"written anew")
    assert round_() == [("bad.wav", "retry", 1), ("grows.wav", "ready", 0)]
    assert round_() == [("bad.wav", "ready", 1), ("old.wav", "ready", 0)]
    assert round_() == [("bad.wav", "dropped", 2)]
    (place / "bad.wav").write_bytes(b"still bad")
    assert round_() == [] and round_() == []
    got = sorted((os.path.basename(r.path), r.size, r.error) for r in spark.read.parquet(results).collect())
    assert got == [("bad.wav", 3, "broken"), ("bad.wav", 3, "broken"), ("grows.wav", 4, None), ("new.wav", 2, None), ("old.wav", 12, None)]


def test_watch_stops_after_so_many_files(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    (place / "a.wav").write_bytes(b"a")
    query = folder.watch(spark, [str(place)], lambda f: f.select("path", F.lit(None).cast("string").alias("error")), str(tmp_path / "out"), str(tmp_path / "work"), every="1 second", most_files=1, baseline=False)
    end = time.time() + 60
    while query.isActive and time.time() < end:
        time.sleep(0.5)
    assert not query.isActive and spark.read.parquet(str(tmp_path / "out")).count() == 1
