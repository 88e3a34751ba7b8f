"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learnt from labelled rows: words, and stems of several words, that occur in toxic documents in several
different contexts and hardly ever in others. A token's Levenshtein automaton is run over the lexicon's trie, which
finds terms within one edit (also after undoing digit-for-letter spelling). A window round each hit tells quotation (the
term stands between quotation marks or by a verb of saying) from abuse, and a small logistic regression turns
context-weighted hits into a score. Learning reads at most `sample` labelled rows (smallest id hashes).

Null and empty texts have no hits. Rows without a label, with a null label or held out are not learnt from. Without toxic
labels the lexicon is empty and all scores are equal. Texts and tokens of any length are searched whole. Repeated rows get
equal scores, an empty table an empty result, and ties of the lexicon go by code point. Other columns are carried along by
`reject_toxic` whatever their names, and not used for scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled
from .text import SMALL_STEP, Words, checkpointed, held_out, mix, pieces, span_hashes

STEMS = (4, 5, 6)
#: Weights of an exact or stem hit, of a hit within one edit, and the factor of a quoted one.
EXACT, NEAR, QUOTED = 1.0, 0.5, 0.3
MIN_NEAR, WINDOW_BYTES, CLUSTER_WORDS = 5, 80, 20
#: Tokens whose match a task remembers, about; then it forgets all.
KNOWN = 200_000
LEET = str.maketrans("013457@$", "oieastas")
QUOTES = "\"“”„«»‘’"
SAYING = re.compile(r"\b(said|says|wrote|called|quote|quoted|quoting|word|term|dit|écrit|sagte|schrieb|dijo|escribió)\b")

#: Bytes cut from both ends of a token.
TRIM = np.zeros(256, bool)
TRIM[list(b".,;:!?\"'()[]{}<>*#&%|-_/~`")] = True


def trimmed(text: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case, and the bounds and hash of each without marks at its ends (a word of marks keeps its last)."""
    w = Words(text, lower=True)
    worded = ~TRIM[w.data]
    before = np.concatenate(([0], np.cumsum(worded)))
    place = np.concatenate(([-1], np.flatnonzero(worded), [len(w.data)]))
    start = np.minimum(place[before[w.start] + 1], w.end - 1)
    end = np.maximum(place[before[w.end]] + 1, start + 1)
    return w, start, end, span_hashes(w.data, start, end)


def stretched(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a span holds three equal characters in a row (or as many equal bytes of up to four)."""
    out = np.zeros(len(start), bool)
    for width in range(1, 5):
        equal = np.concatenate(([0], np.cumsum(data[width:] == data[:-width])))
        need = 2 * width
        if len(equal) <= need:
            break
        found = np.concatenate(([0], np.cumsum(equal[need:] - equal[:-need] == need)))  # by first byte
        out |= found[np.clip(end - need - width + 1, start, len(found) - 1)] > found[np.minimum(start, len(found) - 1)]
    return out


class Trie:
    """Lexicon terms by character; a node is (children, term or None)."""

    def __init__(self, terms: list[str]):
        self.root: tuple[dict, list] = ({}, [None])
        for t in terms:
            node = self.root
            for c in t:
                node = node[0].setdefault(c, ({}, [None]))
            node[1][0] = t


class LevenshteinAutomaton:
    """The automaton of strings within `edits` of a word; a state is a tuple of (place, edits so far)."""

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits = word, edits
        self.start = self._closed({0: 0})

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        for i in range(len(self.word) + 1):
            if i in state and i < len(self.word) and state[i] < self.edits:
                state[i + 1] = min(state.get(i + 1, self.edits + 1), state[i] + 1)
        return state

    def step(self, state: dict[int, int], c: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, e in state.items():
            if i < len(self.word) and self.word[i] == c:
                out[i + 1] = min(out.get(i + 1, self.edits + 1), e)
            if e < self.edits:
                out[i] = min(out.get(i, self.edits + 1), e + 1)
                if i < len(self.word):
                    out[i + 1] = min(out.get(i + 1, self.edits + 1), e + 1)
        return self._closed(out)

    def accepts(self, state: dict[int, int]) -> int | None:
        return state.get(len(self.word))

    def over(self, trie: Trie) -> tuple[str, int] | None:
        """The nearest term of the trie within the edits (ties by code point), and its distance."""
        best: tuple[int, str] | None = None
        todo = [(trie.root, self.start)]
        while todo:
            (children, term), state = todo.pop()
            if term[0] is not None and (e := self.accepts(state)) is not None and (best is None or (e, term[0]) < best):
                best = (e, term[0])
            for c, child in children.items():
                if after := self.step(state, c):
                    todo.append((child, after))
        return (best[1], best[0]) if best else None


class Lexicon:
    """Words and stems; `clean` are spellings near a word that documents free of toxicity use too."""

    def __init__(self, words: list[str], stems: list[str], clean: frozenset[str] = frozenset()):
        self.words, self.stems, self.clean = frozenset(words), frozenset(stems), clean
        self.trie = Trie([w for w in words if len(w) >= MIN_NEAR])
        self.longest = max(map(len, words), default=0) + 1
        # a token within one edit of a term shares its first or last two bytes, and its length nearly (modulo 64)
        self.edges = np.zeros((2, 1 << 22), bool)
        self.heads = np.zeros(1 << 16, bool)
        for t in words:
            b = t.encode()
            for n in range(max(1, len(b) - 3), len(b) + 4):
                self.edges[0, n % 64 << 16 | b[0] << 8 | b[min(1, len(b) - 1)]] = True
                self.edges[1, n % 64 << 16 | b[max(0, len(b) - 2)] << 8 | b[-1]] = True
        for t in stems:
            b = t.encode()
            self.heads[b[0] << 8 | b[1]] = True
        self.known: dict[int, float] = {}

    def candidates(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.int64)
        d = data.astype(np.int64)
        n = end - start
        head = d[start] << 8 | d[np.minimum(start + 1, end - 1)]
        tail = d[np.maximum(end - 2, start)] << 8 | d[end - 1]
        leet = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57) | (data == 64) | (data == 36))))
        odd = leet[end] > leet[start]
        size = n % 64 << 16
        return np.flatnonzero(self.edges[0][size | head] | self.edges[1][size | tail] | self.heads[head] | odd | stretched(data, start, end))

    def match(self, token: str) -> float:
        """EXACT for a term or a word with a stem, NEAR for one within an edit, else 0."""
        if token in self.words or any(token[:k] in self.stems for k in STEMS if len(token) > k):
            return EXACT
        plain = token.translate(LEET)
        if plain != token and any(c.isalpha() for c in token) and plain in self.words:
            return NEAR
        plain = re.sub(r"(.)\1{2,}", r"\1", plain)
        if len(plain) < MIN_NEAR or len(plain) > self.longest or token in self.clean:
            return 0.0
        return NEAR if plain in self.words or LevenshteinAutomaton(plain).over(self.trie) else 0.0

    def hits(self, text: pa.Array) -> list[tuple[int, int, float, str]]:
        """(row, word number, weight in its context, token) of all hits."""
        w, start, end, word = trimmed(text)
        at = self.candidates(w.data, start, end)
        value, back = np.unique(word[at], return_inverse=True)
        first = np.full(len(value), -1)
        first[back[::-1]] = at[::-1]
        weight = np.zeros(len(value))
        if len(self.known) > KNOWN:
            self.known.clear()
        for k, (h, i) in enumerate(zip(value.tolist(), first.tolist(), strict=True)):
            if (known := self.known.get(h)) is None:
                known = self.known[h] = self.match(bytes(w.data[start[i] : end[i]]).decode("utf-8", "replace"))
            weight[k] = known
        out = []
        for i in at[weight[back] > 0].tolist():
            low, high = int(w.off[w.row[i]]), int(w.off[w.row[i] + 1])
            a, b = int(start[i]), int(end[i])
            before = bytes(w.data[max(low, a - WINDOW_BYTES) : a]).decode("utf-8", "ignore")
            after = bytes(w.data[b : min(high, b + WINDOW_BYTES)]).decode("utf-8", "ignore")
            token = bytes(w.data[a:b]).decode("utf-8", "replace")
            out.append((int(w.row[i]), i, self.known.get(int(word[i]), 0.0) * context(before, after), token))
        return out


def context(before: str, after: str) -> float:
    """QUOTED if the window shows quotation, else 1: an open mark before and a mark after, or a verb of saying with a mark."""
    marks = sum(c in QUOTES for c in before)
    closes = any(c in QUOTES for c in after)
    if closes and (marks % 2 == 1 or marks and SAYING.search(before + " " + after)):
        return QUOTED
    return 1.0


def measures(lexicon: Lexicon, text: pa.Array) -> np.ndarray:
    """Of each row: log of 1 + weighted hits, whether there is any, log of 1 + most in a window of words."""
    out = np.zeros((len(text), 3))
    own: dict[int, list[tuple[int, float]]] = {}
    for row, at, weight, _ in lexicon.hits(text):
        own.setdefault(row, []).append((at, weight))
    for row, hits in own.items():
        total, most, low, run = 0.0, 0.0, 0, 0.0
        for at, weight in hits:
            total += weight
            run += weight
            while hits[low][0] <= at - CLUSTER_WORDS:
                run -= hits[low][1]
                low += 1
            most = max(most, run)
        out[row] = math.log1p(total), min(1.0, total), math.log1p(most)
    return out


def learn_lexicon(rows: DataFrame, min_docs: int = 5, min_share: float = 0.005, min_contexts: int = 4, min_lift: float = 30.0) -> Lexicon:
    """Terms of toxic documents from labelled rows (label, text), which `sample` bounds and with them the terms.

    A term needs `min_docs` toxic documents and `min_share` of them, which chance hardly ever reaches, `min_contexts`
    different words before it (so that copies of one document don't count) and a `min_lift` over other documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=SMALL_STEP):
            tally: dict[tuple[str, int], list[int]] = {}
            w, start, end, word = trimmed(b.column("text"))
            before = np.concatenate(([0], mix(word[:-1]))) if len(word) else word
            for r, label in enumerate(b.column("label").to_pylist()):
                seen: dict[tuple[str, int], int] = {}
                for i in range(int(w.first[r]), int(w.first[r + 1])):
                    token = bytes(w.data[start[i] : end[i]]).decode("utf-8", "replace")
                    seen[token, 0] = seen.get((token, 0), 0) | 1 << int(before[i]) % 63
                    for k in STEMS:
                        if len(token) > k:
                            key = (token[:k], 1)
                            seen[key] = seen.get(key, 0) | 1 << int(word[i]) % 63
                for key, mask in seen.items():
                    t = tally.setdefault(key, [0, 0, 0])
                    if label >= 0.5:
                        t[0] += 1
                        t[2] |= mask
                    else:
                        t[1] += 1
            if tally:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally]), pa.array([k[1] for k in tally], pa.int32()), *(pa.array([t[j] for t in tally.values()], pa.int64()) for j in range(3))], names=["term", "kind", "pos", "neg", "mask"])

    total = rows.agg(F.sum(F.when(F.col("label") >= 0.5, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).first()
    n_pos, n_neg = total["pos"] or 0, (total["n"] or 0) - (total["pos"] or 0)
    if not n_pos:
        return Lexicon([], [])
    tallies = rows.select("text", "label").mapInArrow(run, "term string, kind int, pos long, neg long, mask long").groupBy("term", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_or("mask").alias("mask"))
    lift = (F.col("pos") / n_pos) / ((F.col("neg") + 0.5) / (n_neg + 1))
    found = tallies.where((F.col("pos") >= max(min_docs, min_share * n_pos)) & (F.bit_count("mask") >= min_contexts) & (lift >= min_lift) & (F.length("term") >= 3)).orderBy("term", "kind").collect()
    words = [r["term"] for r in found if r["kind"] == 0]
    # shorter stems match what longer ones and their words do
    stems = {r["term"] for r in found if r["kind"] == 1}
    stems -= {s for s in stems if any(s[:k] in stems for k in STEMS if k < len(s))}
    return Lexicon([w for w in words if not any(w[:k] in stems for k in STEMS if len(w) > k)], sorted(stems))


def clean_spellings(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Tokens near a term in labelled rows that aren't toxic; the number of labelled rows bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=SMALL_STEP):
            label = b.column("label").to_pylist()
            near = {t for row, _, _, t in lexicon.hits(b.column("text")) if label[row] < 0.5 and t not in lexicon.words}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(near), pa.string())], names=["token"])

    got = rows.where("label < 0.5").select("text", "label").mapInArrow(run, "token string").distinct().collect()
    return frozenset(r["token"] for r in got)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights and, last, bias of a ridge logistic regression, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    loss = lambda w: np.logaddexp(0, np.where(y > 0.5, -1, 1) * (x @ w)).sum() + 0.5 * w @ ridge @ w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the regression's weights."""
    rows = checkpointed(labelled(docs, labels, "toxic", sample).select("text", "label"))
    lexicon = learn_lexicon(rows)
    lexicon = Lexicon(sorted(lexicon.words), sorted(lexicon.stems), clean_spellings(rows, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=SMALL_STEP):
            m = measures(lexicon, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array(m[:, j].copy()) for j in range(3))], names=["label", "a", "b", "c"])

    got = rows.select("text", "label").mapInArrow(run, "label double, a double, b double, c double").groupBy("label", "a", "b", "c").agg(F.count("*").alias("n")).toPandas()  # `sample` rows at most
    got = got.sort_values(["a", "b", "c", "label"]).loc[lambda d: d.index.repeat(d.n)]
    if not len(got) or got.label.max() < 0.5:
        return lexicon, np.array([0.0, 0.0, 0.0, -3.0])
    return lexicon, logistic(got[["a", "b", "c"]].to_numpy(), (got.label.to_numpy() >= 0.5).astype(float))


def score_rows(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, keep: int | None = None) -> DataFrame:
    """The columns of docs (or the first `keep` of them) as c0, c1 and so on, and `score`, the score of column `text`."""
    shared = docs.sparkSession.sparkContext.broadcast((sorted(lexicon.words), sorted(lexicon.stems), lexicon.clean))
    flat = [f"c{k}" for k in range(len(docs.columns))]
    at = flat[docs.columns.index("text")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f) for c, f in zip(docs.columns, flat, strict=True)]).withColumn(at, F.col(at).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for b in pieces(batches, at, SMALL_STEP):
            m = measures(own, b.column(at))
            score = 1 / (1 + np.exp(-np.clip(m @ weights[:3] + weights[3], -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(score)], names=[*b.schema.names[:keep], "score"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes[:keep]) + ", score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_rows(docs, *train(docs, labels, sample), keep=1).select(F.col("c0").alias("doc_id"), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """docs without those that score `threshold` or more."""
    kept = score_rows(docs, *train(docs, labels, sample)).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
