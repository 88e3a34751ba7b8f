"""Line templates against brute force, however the lines are dealt; near copies against all pairs."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auralake.llm import copies, lines, text


def ambiguous(seed, n=260):
    """Unrelated texts whose notices share leaves, with constants and fields in all proportions."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    heads = [[word(5) for _ in range(8)] for _ in range(3)]
    pool = [word(4) for _ in range(30)]
    texts = []
    for _ in range(n):
        own = [" ".join(word(7) for _ in range(rng.randint(9, 14))) for _ in range(6)]
        for _ in range(rng.randint(0, 3)):
            line = list(rng.choice(heads))
            for p in range(3, 8):
                if rng.random() < 0.3:
                    line[p] = rng.choice(pool) if rng.random() < 0.7 else str(rng.randint(1, 99))
            own.insert(rng.randint(0, len(own)), " ".join(line))
        texts.append("\n".join(own))
    return [*texts, None, "", "Home"]


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_templates_match_brute_force(spark, monkeypatch, parts, broadcast):
    monkeypatch.setattr(lines, "BROADCAST", broadcast)
    texts = ambiguous(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    gone = brute.template_lines(texts)
    want = {i: (len(g), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(g))) for i, (t, g) in enumerate(zip(texts, gone, strict=True))}
    got = {r.doc_id: (r.n_dropped, r.text) for r in lines.drop_templates(df).collect()}
    assert got == want and 50 < sum(map(len, gone)) < sum(len((t or "").split("\n")) for t in texts) / 2


def test_templates_do_not_depend_on_order(spark):
    texts = ambiguous(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [sorted(map(tuple, lines.drop_templates(d).select("doc_id", "n_dropped", "text").collect()), key=repr) for d in (df.orderBy("doc_id").coalesce(1), df.orderBy(F.desc("text")).repartition(5))]
    assert rows[0] == rows[1]


def test_long_lines(spark):
    """A line of 200,000 words and a text of 100,000 lines."""
    texts = ["word " * 200_000, "\n".join(f"line {'abcdefgh'[i % 8]} {'ijklmnop'[i % 7]} end" for i in range(100_000)), "short"]
    got = {r.doc_id: r.n_dropped for r in lines.drop_templates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0}


def test_near_copies_are_found(spark):
    """At least nine of ten pairs of texts that share 0.7 of their word triples are in one group; unrelated ones aren't."""
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(pool) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 18))):
                own[rng.randrange(len(own))] = rng.choice(pool)
            texts.append(" ".join(own))
    sets = [brute.triples(t) for t in texts]
    near, far = [], []
    for i in range(len(texts)):
        for j in range(i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            (near if share >= 0.7 else far if share < 0.2 else []).append((i, j))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    body = {t: r.body for t, r in zip(texts, spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("body")).collect(), strict=True)}
    group = {r.body: r.origin for r in copies.copy_groups(lines.sketch_table(df), 0.55).collect()}
    of = [group.get(body[t], body[t]) for t in texts]
    assert len(near) > 500 and sum(of[i] == of[j] for i, j in near) >= 0.9 * len(near)
    assert not any(of[i] == of[j] for i, j in far)


def test_only_wanted_lines_are_hashed(monkeypatch):
    """Leaves need the first tokens of a line only; the hashes of some lines are those that all lines get."""
    worked = []

    def spy(data, start, end, whole=text.span_hashes):
        worked.append(len(data))
        return whole(data, start, end)

    monkeypatch.setattr(text, "span_hashes", spy)
    monkeypatch.setattr(lines, "span_hashes", spy, raising=False)
    texts = pa.array([f"{t}\n{'more words ' * 20}\n\n {i} x@y\n" if t else t for i, t in enumerate(ambiguous(7))])
    t = lines.Lines(texts)
    assert sum(worked) < len(text.raw(texts)[0]) / 3
    line, token, start = t.hashes()
    at = np.arange(0, len(line), 3)
    some, own, begin = t.hashes(at)
    assert (some == line[at]).all()
    assert all((own[b : b + n] == token[s : s + n]).all() for b, s, n in zip(begin, start[at], t.count[at], strict=True))
