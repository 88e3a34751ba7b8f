"""Quality rules by weak supervision.

Each rule votes bad (0), good (1) or abstains (-1). Expectation-maximisation over the counts of vote patterns
(at most 3 ** rules of them, whatever the corpus) estimates the rules' accuracies and the share of good documents,
and the posterior probability of "good" replaces an all-must-pass filter.

Null and empty texts have no words, fail the base rule and are not kept; a null doc_id stays null. Repeated rows
are votes of their own and get equal verdicts; an empty table gives an empty one; a text of any length is counted whole, in time in
proportion. Ties can't matter, as nothing is ranked. Columns but doc_id and text are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, checkpointed, gram_hashes, mix, pieces

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: name: (measure, votes bad above, votes good at or below); otherwise the rule abstains.
RULES = {
    "symbols": ("symbols", 0.3, None),
    "marked_words": ("marked", 0.3, None),
    "no_letters": ("bare", 0.3, None),
    "capitals": ("capitals", 0.5, None),
    "shouts": ("shouts", 0.3, None),
    "same_as_before": ("same", 0.25, None),
    "repeats": ("repeats", 0.5, None),
    "dup_lines": ("dup_lines", 0.5, None),
    "plain_words": ("not_plain", 0.5, 0.3),
    "long_words": ("mean_chars", 15.0, 10.0),
}
#: Rates of the votes bad, good and abstains that estimation starts from, in bad and in good documents.
START = np.array([[0.3, 0.1, 0.6], [0.02, 0.3, 0.68]])

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern string"


def repeat_words(words: Words, word: np.ndarray, k: int = 3) -> np.ndarray:
    """For each row the words inside k-word windows that occur twice or more in the row."""
    gram = gram_hashes(word, k)
    n = len(gram)
    inside = words.row[:n] == words.row[k - 1 : k - 1 + n]
    with np.errstate(over="ignore"):
        key = mix(gram + words.row[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    value = key[order]
    twin = np.zeros(len(order), bool)
    if len(order) > 1:
        same = value[1:] == value[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    covered = np.zeros(len(word) + 1, np.int32)
    np.add.at(covered, order[twin], 1)
    np.add.at(covered, order[twin] + k, -1)
    return np.bincount(words.row[np.cumsum(covered[:-1]) > 0], minlength=len(words.count))


def dup_lines(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: lines with a word that equal an earlier line of the row, and lines with a word."""
    from .text import span_hashes

    n = len(data)
    rows = len(off) - 1
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((off[:-1], cut + 1)))
    start = start[start < n]
    start = start[data[start] != 10]  # a row's end is the next row's start, so ends are looked for after it
    edge = np.unique(np.concatenate((off[1:], cut)))
    end = edge[np.searchsorted(edge, start, "right")] if len(start) else start
    worded = np.concatenate(([0], np.cumsum(~gap)))
    full = worded[end] > worded[start]
    start, end = start[full], end[full]
    row = np.searchsorted(off, start, "right") - 1
    with np.errstate(over="ignore"):
        key = mix(span_hashes(data, start, end) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(row, minlength=rows)
    return lines - np.bincount(row[first], minlength=rows), lines


def measures(text: pa.Array) -> dict[str, np.ndarray]:
    """Counts and ratios of each row, all over its whole text."""
    w = Words(text)
    rows = len(w.count)
    word = w.hashes()
    per = lambda mask: np.bincount(w.row[mask], minlength=rows)
    before = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    inner = lambda flags: (c := before(flags))[w.end] - c[w.start]
    points = before((w.data & 0xC0) != 0x80)
    chars = points[w.end] - points[w.start]
    symbols = before(SYMBOLS[w.data])
    upper = inner((w.data >= 65) & (w.data <= 90))
    lower = inner((w.data >= 97) & (w.data <= 122))
    letters = inner(((w.data | 32) >= 97) & ((w.data | 32) <= 122) | (w.data >= 128))
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (w.row[1:] == w.row[:-1])
    dups, lines = dup_lines(w.data, w.off, w.gap)
    out = {
        "n_words": w.count,
        "word_chars": np.bincount(w.row, weights=chars, minlength=rows).astype(np.int64),
        "n_symbols": np.diff(symbols[w.off]),
        "n_dup_lines": dups,
        "n_repeat_words": repeat_words(w, word),
    }
    n = np.maximum(w.count, 1)
    marks = inner(w.data == 33)
    marked = inner(SYMBOLS[w.data])
    plain = (letters - upper >= w.end - w.start - 2) & (marked == 0) & (lower > 0)
    out |= {
        "symbols": out["n_symbols"] / n,
        "repeats": out["n_repeat_words"] / n,
        "dup_lines": dups / np.maximum(lines, 1),
        "marked": per(marked > 1) / n,
        "not_plain": 1 - per(plain) / n,
        "same": per(same) / n,
        "bare": per(letters == 0) / n,
        "capitals": per((upper > 1) & (lower == 0)) / n,
        "shouts": per(marks > 1) / n,
        "mean_chars": out["word_chars"] / n,
    }
    return out


def votes(m: dict[str, np.ndarray], rules: dict = RULES) -> np.ndarray:
    """Rows x rules of 0 bad, 1 good, 2 abstains."""
    cols = [np.where(m[k] > bad, 0, np.where(m[k] <= good, 1, 2) if good is not None else 2) for k, bad, good in rules.values()]
    return np.stack(cols, axis=1)


def features(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """One row per document: the base counts, and the rules' votes as a string of 0 (bad), 1 (good) and 2 (abstains)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            m = measures(b.column("text"))
            vote = votes(m, rules)
            pattern = [r.tobytes().decode() for r in (vote + 48).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(pattern, pa.string())], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def fit(counts: dict[str, int], rounds: int = 60, smooth: float = 1.0) -> dict:
    """Expectation-maximisation over pattern counts: prior of good, and of each rule P(vote | class).

    Rules start better than chance (START), which fixes which class is "good"; START also counts as `smooth` documents.
    """
    patterns = sorted(p for p in counts if p)
    m = len(patterns[0]) if patterns else len(RULES)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([[int(c) for c in p] for p in patterns]).reshape(len(patterns), m)
    prior = 0.8
    rate = np.tile(START, (m, 1, 1))  # rule, class, vote
    for _ in range(rounds if len(patterns) else 0):
        good = _posterior(vote, prior, rate)
        prior = float(((n * good).sum() + smooth) / (n.sum() + 2 * smooth))
        for j in range(m):
            for c, weight in ((0, n * (1 - good)), (1, n * good)):
                tally = np.bincount(vote[:, j], weights=weight, minlength=3) + smooth * START[c]
                rate[j, c] = tally / tally.sum()
    return {"prior": prior, "rate": rate, "posterior": dict(zip(patterns, _posterior(vote, prior, rate).tolist(), strict=True)) if patterns else {}}


def _posterior(vote: np.ndarray, prior: float, rate: np.ndarray) -> np.ndarray:
    at = np.arange(vote.shape[1])
    bad, good = (np.log(rate[at, c, vote]).sum(axis=1) + np.log(p) for c, p in ((0, 1 - prior), (1, prior)))
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base counts, base verdict, posterior probability of good quality and whether the document is kept.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, votes, posterior.
    """
    seen = checkpointed(features(docs))
    counts = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** rules rows at most
    model = fit(counts)
    known = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in model["posterior"].items()] or [("", 0.0)], "pattern string, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        seen.join(F.broadcast(known), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.coalesce("posterior", F.lit(0.0)) >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("pattern").alias("votes"), "posterior")
    )
