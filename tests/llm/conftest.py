"""Small document tables: ordinary, odd and empty ones."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those that operators use inside, or with others but for case.
EXTRA = "TEXT string, row long, h long, key string, `a.b` int"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(300)) for _ in range(n))


def rows(seed=1, n=30):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randrange(4, 120)), "en", f"src{i % 3}", 0) for i in range(n)]
    base = prose(rng, 200)
    out += [(n + i, base.replace(" ", "  ", 1) if i % 2 else base, "en", "src0", 0) for i in range(6)]
    return out


ODD = [
    (1000, None, "en", "src0", None), (1001, "", None, None, 0), (1002, " \t\n ", "en", "src1", 4), (1003, "one", "en", "src1", 3), (1003, "one", "en", "src1", 3),
    (1004, "É" * 5 + " émile 漢字 🎉 word " * 3, "fr", "src2", 9), (1005, "x" * 60_000, "en", "src0", 60_000), (1006, "long words here " * 9_000, "en", "src0", 1), (None, "an id that is null", "en", "src0", 18),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows() + ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    return spark.createDataFrame([(*r, "other", 1, 2, "k", 3) for r in rows() + ODD], f"{SCHEMA}, {EXTRA}").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
