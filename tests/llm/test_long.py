"""Very long texts, null and empty ones, empty tables and clashing names for operators that had no such test."""

import hashlib

from auralake.llm import media, pii, quality, rules

LONG = "alpha beta gamma delta\n" * 40_000
ROWS = [(1, LONG, 7, "x"), (2, None, 7, "x"), (3, "", 7, "x"), (None, "one", 7, "x"), (4, "one", 7, "x"), (4, "one", 7, "x")]
SCHEMA = "doc_id long, text string, n_words long, `key` string"


def test_media(spark, none):
    assert media.media_columns(none).count() == 0
    got = media.media_columns(spark.createDataFrame(ROWS, SCHEMA), keep_media=False).collect()
    assert len(got) == 6 and all(r.access_units[0].random_access and r.access_units[0].position == 0 for r in got)
    one = next(r for r in got if r.doc_id == 1)
    payload = LONG.encode() + b"\0" * (-len(LONG) % 64)
    assert one.payload_sha256 == hashlib.sha256(payload).hexdigest() and len(one.access_units) > 10
    assert [u.pts for u in one.access_units] == sorted(u.pts for u in one.access_units)
    assert len({r.media_sha256 for r in got if r.doc_id in (4, None)}) == 1


def test_rules(spark, none):
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_dup_lines, got[1].n_repeat_words) == (160_000, 760_000, 39_999, 160_000)
    assert got[1].base_failed and not got[2].kept and got[3].n_words == 0 and rules.quality_rules(none).count() == 0


def test_personal_data(spark, none):
    assert pii.personal_data(none).count() == 0
    text = "word " * 200_000 + "a@b.org"
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert got[1].spans == f"email:1000000:{len(text)}" and got[2].spans == ""


def test_quality(spark, labels, none):
    given = spark.createDataFrame(ROWS, SCHEMA)
    assert quality.quality_scores(none, labels[0]).count() == 0
    got = quality.quality_scores(given, labels[0]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
