import random

import pytest

NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(NAMES) + rng.choice(["", "s", "ing", "ed", "er"]) + str(rng.choice("abcdefghij")) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, short, repeated, near and very long texts."""
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split()
    near[40] = "changed"
    passage = prose(rng, 60)
    out = [None, "", " \t\n ", "one", "one", "One two", base, base, " ".join(near), base.upper(), "x " * 400, "é ß 漢字 " * 30, prose(rng, 5000)]
    for _ in range(12):
        out.append(f"{prose(rng, 80)} {passage} {prose(rng, 50)}")
    for k in range(20):
        copy = base.split()
        copy[k * 7] = f"odd{k}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src1", "src2", "src10"][i % 4], len(t or ""), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    rng = random.Random(7)
    return spark.createDataFrame([(1000 + i, i % 2, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), rng
