"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the relative entropy to one copy each under one token constraint for each source and
0 <= r <= limit. The dual is convex with one multiplier a source, and its optimum tilts exponentially:
r = min(limit, exp(multiplier * size / mean size)). Newton steps (kept inside a bracket) solve it over a table of
(source, size, documents), which Spark aggregates again in each step; only one row a source comes to the driver.
Rates become whole copies along sizes in falling order, where each size makes up for the words that larger ones are
over or short, so a source misses its target by little more than half its smallest documents where it has small ones.

Null text has size 0 and null source is a source of its own (last). Documents of size 0 are not taken. Equal documents
share a rate; which of them get the odd copy follows from a hash of the id, so reruns agree. Rows that repeat an id or a
text count as often as they occur; an empty table gives an empty one; a text may have any length. Other columns are
carried along in a struct, so their names can't clash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Documents a part, and the fewest parts, of the documents of one source and size: no window holds all of a hot size.
PART_DOCS, PARTS = 20_000, 64
#: Sources whose targets are broadcast, at most; beyond it they are joined.
BROADCAST = 1 << 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0) -> dict[str | None, float]:
    """Share all tokens out by weight (repeating over sources by code point, null last); what exceeds `limit` times a source's size is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > limit * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = limit * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def exact(x: Column) -> Column:
    """A sum of doubles as decimals, which doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def multipliers(table: DataFrame, stats: dict[str, tuple[float, float]], limit: float, steps: int = 60, tolerance: float = 1e-9) -> dict[str, float]:
    """Newton on the dual. table: key, size, n; stats: mean size and target of each key. Infinity where the target is limit times the size."""
    spark = table.sparkSession
    state = {k: [0.0, -math.inf, math.inf, t] for k, (_, t) in stats.items()}
    done: dict[str, float] = {}
    for _ in range(steps):
        todo = {k: v for k, v in state.items() if k not in done}
        if not todo:
            break
        now = spark.createDataFrame([(k, v[0], stats[k][0]) for k, v in todo.items()], "key string, at double, mean double")
        tilt = F.exp(F.least(F.col("at") * F.col("size") / F.col("mean"), F.lit(700.0)))
        got = (
            table.join(F.broadcast(now), "key")
            .select("key", "size", "n", "mean", tilt.alias("tilt"))
            .groupBy("key")
            .agg(
                exact(F.col("n") * F.col("size") * F.least("tilt", F.lit(float(limit)))).alias("value"),
                exact(F.when(F.col("tilt") < limit, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * F.col("tilt")).otherwise(0.0)).alias("slope"),
                F.sum(F.col("n") * F.col("size")).alias("tokens"),
            )
            .collect()
        )
        for r in got:
            s = state[r["key"]]
            lam, low, high, target = s
            if target >= limit * r["tokens"] * (1 - 1e-12):
                done[r["key"]] = math.inf
            elif target <= 0:
                done[r["key"]] = -math.inf
            elif abs(r["value"] - target) <= tolerance * target:
                done[r["key"]] = lam
            else:
                s[1], s[2] = (lam, high) if r["value"] < target else (low, lam)
                step = lam + (target - r["value"]) / r["slope"] if r["slope"] > 0 else math.nan
                step = min(max(step, lam - 8 - abs(lam)), lam + 8 + abs(lam)) if step == step else (lam + 8 + abs(lam)) * (1 if r["value"] < target else -1)
                if not s[1] < step < s[2]:
                    step = (s[1] + s[2]) / 2 if math.isfinite(s[1]) and math.isfinite(s[2]) else step
                s[0] = step
    return {k: done.get(k, s[0]) for k, s in state.items()}


def whole_copies(table: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Copies of each size of one source (size, n, rate), larger sizes first; what is over or short goes to the next size."""
    table = table.sort_values("size", ascending=False)
    carried, copies = 0.0, []
    for size, n, rate in zip(table["size"].tolist(), table["n"].tolist(), table["rate"].tolist(), strict=True):
        wanted = carried + rate * n * size
        copies.append(min(limit * n, max(0, math.floor(wanted / size + 0.5))) if size else 0)
        carried = wanted - copies[-1] * size
    out = table.rename(columns={"n": "all"}).assign(copies_all=copies)
    return out[["key", "size", "all", "copies_all", "rate", "source_size", "target"]]


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: int = 3, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of every document; `columns` of docs are carried along in a struct `row`."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("body"), *([F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")] if columns else []))
    n_parts = max(PARTS, docs.count() // PART_DOCS)
    base = base.withColumn("key", key).withColumn("part", F.pmod(F.xxhash64("doc_id", "body"), F.lit(n_parts)))
    parts = checkpointed(base.groupBy("key", "source", "size", "part").agg(F.count("*").alias("n")))
    table = checkpointed(parts.groupBy("key", "size").agg(F.sum("n").alias("n")))
    whole = parts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n")).collect()  # a row a source
    target = source_targets({r["source"]: r["tokens"] for r in whole}, weights, limit)
    stats = {r["key"]: (r["tokens"] / r["n"], target[r["source"]]) for r in whole if r["tokens"]}
    lam = multipliers(table, stats, limit)
    known = [(r["key"], r["tokens"], float(target[r["source"]]), max(r["tokens"] / max(r["n"], 1), 1.0), float(min(max(lam.get(r["key"], 0.0), -1e6), 1e6))) for r in whole]
    few = len(known) <= BROADCAST
    known = spark.createDataFrame(known, "key string, source_size long, target double, mean double, lam double")
    known = F.broadcast(known) if few else known

    rate = F.when(F.col("size") > 0, F.least(F.lit(float(limit)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))))).otherwise(0.0)
    fixed = table.join(known, "key").withColumn("rate", rate)
    cut = fixed.groupBy("key").applyInPandas(lambda t: whole_copies(t, limit), "key string, size long, all long, copies_all long, rate double, source_size long, target double")

    # the copies of one source and size go to its parts in turn, then to documents within a part
    along = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    shared = parts.drop("source").join(cut, ["key", "size"]).withColumn("upto", F.sum("n").over(along))
    own = F.expr("((upto * copies_all) div all) - (((upto - n) * copies_all) div all)")
    shared = shared.select("key", "size", "part", F.col("n").alias("part_n"), own.alias("own"), "rate", "source_size", "target")

    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("doc_id", "body"))
    placed = base.withColumn("rank", rank).join(shared, ["key", "size", "part"])
    n_copies = F.expr("(own div part_n) + cast(rank <= own % part_n as long)")
    out = placed.withColumn("copies", n_copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", *(["row"] if columns else []), "size", "source_size", "target", "taken", "copies", "rate")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    copies = mix_sources(docs, columns=tuple(docs.columns), **options).where("copies > 0")
    each = copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
