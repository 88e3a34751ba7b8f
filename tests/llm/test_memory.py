"""Memory of a task, without Spark's own."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import prose

from auralake.llm import text, toxicity


def test_scoring_toxicity_holds_small_steps(spark, monkeypatch):
    """Scoring 4 MB of texts in one batch takes less than 100 MB of numpy and Python."""
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    held = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: held.append(f) or self)
    toxicity.score_rows(df, toxicity.Lexicon(["abusive"], []), np.zeros(4))
    body = prose(random.Random(3), 2000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(320)), pa.array([body] * 320)], names=["c0", "c1"])
    assert batch.nbytes > 4 << 20
    text._power(1)
    tracemalloc.start()
    rows = sum(b.num_rows for b in held[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 320 and peak < 100 << 20, peak
