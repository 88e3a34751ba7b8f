"""Operators whose results are exact, against brute force."""

import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auralake.llm import fmindex, jaccard, media, mixing, packing, pii, rules, substring
from auralake.llm.components import components


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_jaccard_matches_brute_force(docs, texts):
    want = brute.components(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()}
    assert got == want


@pytest.mark.parametrize("small,block,often", [(1, 3, 99), (3, 1000, 2)])
def test_jaccard_divides_regions_exactly(spark, monkeypatch, small, block, often):
    """Small limits send every region through pivots, cells and blocks."""
    import random

    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    monkeypatch.setattr(jaccard, "SLICE", 7)
    monkeypatch.setattr(jaccard, "DENSE", often)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(14)]
    texts = {i: " ".join(rng.choice(pool) for _ in range(rng.randint(5, 12))) for i in range(40)}
    base = [f"b{i}" for i in range(40)]
    for i in range(40, 110):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(40)] = f"q{rng.randrange(5)}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()}
    assert got == brute.components(texts)


def test_jaccard_edges(spark, none, docs):
    assert jaccard.jaccard_join(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, "A b\tc d\ne")], "doc_id long, text string")
    assert rows(jaccard.jaccard_join(df), "doc_id", "n_shingles", "component_id") == [(3, 1, 3), (3, 1, 3), (4, 1, 3), (None, 1, None)]
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert 6 in kept and 7 not in kept and {0, 1, 2} <= kept


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_substring_matches_brute_force(docs, texts):
    got = rows(substring.remove_repeats(docs, keep_text=False), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.without_repeats(list(enumerate(texts))), key=repr)


def test_substring_small_windows_and_repeated_rows(spark, none):
    import random

    assert substring.remove_repeats(none).count() == 0
    rng = random.Random(2)
    data = [(i % 9, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(50, "z " * 30), (51, "z " * 30), (None, "q r s " * 9)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(substring.remove_repeats(df, window=12), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.without_repeats(data, 12), key=repr)


@given(st.lists(st.tuples(st.booleans(), st.lists(st.integers(0, 3), max_size=30)), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_fm_index_counts(marked_parts):
    """Intervals and matching statistics against counted substrings; a marked sequence stands for two."""
    parts, marked = [p for _, p in marked_parts], np.array([m for m, _ in marked_parts])
    values = np.array([v for p in parts for v in p], np.int64)
    sizes = np.array([len(p) for p in parts])
    count = {}
    for p, m in zip(parts, marked.tolist(), strict=True):
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                count[tuple(p[i:j])] = count.get(tuple(p[i:j]), 0) + 1 + m
    found = set()
    for p, a, e in fmindex.repeated(values, sizes, 4, marked):
        found |= {(p, j) for j in range(a, e)}
    want = {(k, j) for k, p in enumerate(parts) for i in range(len(p) - 3) if count[tuple(p[i : i + 4])] > 1 for j in range(i, i + 4)}
    assert found == want
    stats = fmindex.matching_statistics(fmindex.FMIndex(values, sizes, marked), np.append(values, 9), np.append(sizes, 1))
    longest = [max((n for n in range(1, j + 1) if count[tuple(p[j - n : j])] > 1), default=0) for p in parts for j in range(1, len(p) + 1)]
    assert stats.tolist() == [*longest, 0]


PII_TEXT = st.text(alphabet="ab.@+-_%() 0123456789\n:/é", max_size=80)


@given(PII_TEXT)
@settings(max_examples=400, deadline=None)
def test_pii_base_spans(text):
    assert [f"{k}:{a}:{e}" for a, e, k in pii.spans(text) if k in pii.BASE] == brute.base_spans(text)


def test_pii_kinds(spark, docs, texts):
    text = "Mail a.b@c-d.org, ip 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111, call +44 (20) 7946-0958, see https://x.org/a?b. IBAN: GB82 WEST 1234 5698 7654 32, account no 12345678"
    kinds = [k for _, _, k in pii.spans(text)]
    assert kinds == ["email", "ip", "card", "phone", "url", "iban", "account"]
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got if r.doc_id in (0, 1, 2)} == {empty}


def test_rule_counts(docs, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.quality_rules(docs).collect()}
    assert got == {i: brute.rule_counts(t) for i, t in enumerate(texts)}


@given(st.lists(st.text(alphabet="ab#| \n\té", max_size=60), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_rule_measures(texts):
    import pyarrow as pa

    m = rules.measures(pa.array(texts))
    got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute.rule_counts(t) for t in texts]


def test_rules_verdict(spark, none):
    assert rules.quality_rules(none).count() == 0
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    data = [(i, " ".join(word() for _ in range(80))) for i in range(60)] + [(100 + i, " ".join(word() + "###" for _ in range(80))) for i in range(20)]
    got = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[i] == (i < 100) for i in got)


def test_media_round_trip(docs, texts):
    for r in media.media_columns(docs).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        read = media.demux(bytes(r.media))
        assert read["payload"] == payload and read["errors"] == 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and r.access_units[0].random_access


@given(st.binary(max_size=5000))
@settings(max_examples=50, deadline=None)
def test_transport_stream(data):
    read = media.demux(media.mux(data or b"x"))
    assert read["payload"] == (data or b"x")
    assert read["pts"] == [k * 11520 for k in range(len(read["pts"]))]


def test_transport_stream_faults():
    stream = media.mux(bytes(4000))
    lost = stream[: 5 * 188] + stream[6 * 188 :]
    assert media.demux(lost)["errors"] == 1
    broken = bytearray(stream)
    broken[188 + 20] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(broken))


PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_token_ids(text):
    from tokenizers import Tokenizer

    t = packing._tokenizer(PATH)
    assert isinstance(t, Tokenizer)
    assert packing.encode(text, PATH).tolist() == t.encode(text, add_special_tokens=False).ids


def test_special_token_text():
    text = "a <|endoftext|> b"
    assert packing.encode(text, PATH).tolist() == packing._tokenizer(PATH).encode(text, add_special_tokens=False).ids


def test_packing(docs, texts, none):
    assert packing.pack(none, PATH).count() == 0
    got = packing.pack(docs, PATH, capacity=256, group_size=10).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, parts in by_doc.items():
        ids = np.append(packing.encode(texts[d] or "", PATH), 0).astype("<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=80, deadline=None)
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    want, free = [], []
    for s in sizes:
        k = next((i for i, f in enumerate(free) if f >= s), len(free))
        free += [50] * (k == len(free))
        free[k] -= s
        want.append(k)
    assert packing.first_fit_decreasing(sizes, 50) == want


def test_source_targets():
    t = mixing.source_targets({"b": 100, "a": 100, None: 100, "c": 1000})
    assert t == pytest.approx({"a": 200, "b": 300, "c": 600, None: 200})  # weights 1, 2, 3 and 1 again; b stops at 300
    assert sum(t.values()) == pytest.approx(1300) and all(t[s] <= 3 * n + 1e-9 for s, n in {"b": 100, "a": 100, None: 100, "c": 1000}.items())


def test_mixing(spark, none):
    import random

    rng = random.Random(4)
    data = [(i, " ".join(["w"] * rng.randint(0, 200)), [None, "s1", "s2", "s3"][min(3, i % 7)]) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {d: s for d, _, s in data}
    for s in {None, "s1", "s2", "s3"}:
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 200
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in own)
    assert mixing.mix_sources(none).count() == 0


def test_open_cells_ship_texts_of_possible_partners_only(spark, monkeypatch):
    """Documents that share a pivot but not four fifths of their shingles meet as counts; their texts are not sent to blocks."""
    import random

    rng = random.Random(9)
    for name, value in (("SMALL", 1), ("BLOCK", 4), ("SLICE", 5), ("SAMPLE", 1)):
        monkeypatch.setattr(jaccard, name, value)
    shared = [f"s{i}" for i in range(30)]
    texts = {i: " ".join(shared + [f"w{i}x{k}" for k in range(6)]) for i in range(40)}
    for i in range(40, 50):  # one word off a text before, at either end
        words = texts[i - 40].split()
        words[rng.choice((0, 35))] = f"q{i}"
        texts[i] = " ".join(words)
    sent, partners = [], jaccard.with_partners

    def counted(rows, classes):
        out = partners(rows, classes)
        sent.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "with_partners", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()}
    assert got == brute.components(texts)
    assert sent, "no cell was open"
    before, after = sent[0]
    assert after < before / 2


def test_shuffle_files_of_earlier_steps_go(spark, monkeypatch):
    """Once a table is written, the files of the shuffles behind it leave the disk without waiting for a full heap."""
    import time

    from auralake.llm import text

    monkeypatch.setattr(text, "COLLECT_S", 0)
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    spark._jvm.System.gc()
    before = files()
    made = text.checkpointed(spark.range(5000).selectExpr("id", "id % 7 as k").repartition(5, "k"))
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.5)
        text.collect_garbage(spark)  # as each later step does
    assert not left and made.count() == 5000
