"""Classifiers, line templates and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auralake.llm import lines, quality, toxicity


def corpus(spark, rng, n=400):
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    bad = ["scoundrel", "vermin", "rotter"]
    rows = []
    for i in range(n):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        if i % 2 == 0:
            w = [x + "###" for x in w] if i % 4 else w
        rows.append((1000 + i, " ".join(w)))
    return spark.createDataFrame(rows + [(1, None), (2, ""), (5, "plain words here")], "doc_id long, text string")


def test_quality_learns_and_holds_out(spark, labels, none):
    table, rng = labels
    docs = corpus(spark, rng)
    known = spark.createDataFrame([(1000 + i, 0 if i % 4 == 2 else 1) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, known).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r for d, r in got.items() if d >= 1000 and r.held_out]
    assert len(held) > 40 and sum((r.score >= 0.5) == ((r.doc_id - 1000) % 4 != 2) for r in held) >= 0.95 * len(held)
    assert quality.quality_scores(none, known).count() == 0
    assert {r.score for r in quality.quality_scores(docs, known.limit(0)).collect()} == {0.5}


def test_toxicity_learns_and_rejects(spark, labels, none):
    table, rng = labels
    docs = corpus(spark, rng).withColumnRenamed("doc_id", "doc_id")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, table).collect()}
    held = [r for d, r in got.items() if d >= 1000 and r.held_out]
    assert sum(r.predicted == int((r.doc_id - 1000) % 4 == 0) for r in held) >= 0.97 * len(held)
    assert got[1].predicted == got[2].predicted == 0
    kept = toxicity.reject_toxic(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}
    assert toxicity.toxicity_scores(none, table).count() == 0
    assert {r.predicted for r in toxicity.toxicity_scores(docs, table.where("toxic = 0")).collect()} == {0}


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=5), min_size=1, max_size=6), st.text(alphabet="abc", max_size=6))
@settings(max_examples=200, deadline=None)
def test_levenshtein_automaton(terms, word):
    best = min((distance(t, word), t) for t in terms)
    got = toxicity.LevenshteinAutomaton(word).over(toxicity.Trie(terms))
    assert got == ((best[1], best[0]) if best[0] <= 1 else None)


def test_lexicon_hits():
    lex = toxicity.Lexicon(["scoundrel"], ["chlla"])
    texts = ["you scoundrel!", 'he said "scoundrel" twice', "you scuondrel", "you scoundrl", "you sc0undrel", "chllando", "clean text", None, ""]
    m = toxicity.measures(lex, pa.array(texts, pa.string()))
    total = np.expm1(m[:, 0])
    assert total.round(2).tolist() == [1.0, 0.3, 0.0, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0]


def test_stretched_and_marked_spellings():
    lex = toxicity.Lexicon(["idiot", "crétin"], [])
    texts = ["you iiiidiooooooooooooot", "aaaidiooooooooot", "iiiiiiiidiotttttttt", "you créééééééétin", "######idiot!!!!!!!", "-------- x", "", None, "no iddle words"]
    total = np.expm1(toxicity.measures(lex, pa.array(texts, pa.string()))[:, 0])
    assert total.round(2).tolist() == [0.5, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0, 0.0]
    d = np.frombuffer(b"aab bbb aaab ab", np.uint8)
    assert toxicity.stretched(d, np.array([0, 4, 8, 13]), np.array([3, 7, 12, 15])).tolist() == [False, True, True, False]


def test_line_templates(spark, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        body = [" ".join(word() for _ in range(12)) for _ in range(3)]
        body.insert(rng.randrange(4), f"Copyright {1990 + i} all rights reserved by owner {i}")
        if i % 2:
            body.insert(rng.randrange(4), f"Posted in section {word()} by the site staff today")
        rows.append((i, "\n".join(body), "en"))
    copied = "\n".join(" ".join(word() for _ in range(10)) for _ in range(4))
    rows += [(100 + i, copied, "en") for i in range(40)] + [(200, None, "en"), (201, "", "en"), (202, "short\nshort", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lines.drop_templates(docs).collect()}
    assert len(got) == len(rows)
    for i in range(60):
        assert got[i].n_dropped == 1 + i % 2 and len(got[i].text.split("\n")) == 3
    assert all(got[100 + i].text == copied for i in range(40))
    assert got[200].text is None and got[201].text == "" and got[202].n_dropped == 0
    assert lines.drop_templates(none).count() == 0


def test_line_templates_without_broadcast(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i)}a ba ca da\nvisit our page number {i} for more\nlast {chr(97 + i)}b one two") for i in range(26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, lines.drop_templates(docs).collect()))
    monkeypatch.setattr(lines, "BROADCAST", 0)
    assert sorted(map(tuple, lines.drop_templates(docs).collect())) == want
    assert all(r[3] >= 1 for r in want)


def invented(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


BLOCK = ["This page is published by the town library", "Opening hours are listed at the front desk", "Please return all books within four weeks", "Questions are answered by the evening staff"]


def test_blocks_of_templates(spark):
    rng = random.Random(11)
    rows = []
    for i in range(30):  # a footer of four lines in unrelated texts
        rows.append((i, "\n".join([invented(rng, 12) for _ in range(4)] + BLOCK)))
    base = [invented(rng, 10) for _ in range(8)]
    for i in range(40):  # near copies, each with a line of its own at another place
        copy = list(base)
        copy.insert(i % 9, f"{invented(rng, 9)}")
        rows.append((100 + i, "\n".join(copy)))
    got = {r.doc_id: r for r in lines.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_dropped == 4 and got[i].text == "\n".join(rows[i][1].split("\n")[:4]) for i in range(30))
    assert all(got[100 + i].text == rows[30 + i][1] for i in range(40))


def test_hot_copies_do_not_shield_a_template(spark):
    rng = random.Random(12)
    shared = "Printed by the council for all households"
    rows = []
    for i in range(20):
        rows.append((i, "\n".join([invented(rng, 12), shared, invented(rng, 12)])))
    base = [invented(rng, 12) for _ in range(5)] + [shared] + [invented(rng, 12) for _ in range(5)]
    for i in range(150):  # near copies differ by a word of the first line
        rows.append((100 + i, "\n".join([f"{base[0]} {invented(rng, 1)}", *base[1:]])))
    got = {r.doc_id: r for r in lines.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_dropped == 1 and shared not in r.text for r in got.values())


def test_short_templates(spark):
    rng = random.Random(13)
    rows = [(i, "\n".join(["Home", invented(rng, 12), "Read more", invented(rng, 12)] + (["Rare"] if i < 7 else []))) for i in range(20)]
    got = {r.doc_id: r for r in lines.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_dropped == 2 and "Home" not in r.text and "Read more" not in r.text and ("Rare" in r.text) == (r.doc_id < 7) for r in got.values())


def test_pipeline_stages(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.drop("key").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(6, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "source_mixing", "packing"]
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    stage = dict(pipeline.STAGES)["jaccard_join"](spark, docs.drop("key"), str(tmp_path))
    assert stage.columns == docs.drop("key").columns
