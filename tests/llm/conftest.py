import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, k string, label string"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en", None if i in (2, None) else f"s{i % 3}", 0, "x", "y", "z") for i, t in texts]


@pytest.fixture(scope="session")
def texts():
    """Null, empty and very long texts, copies, near copies, shared passages, repeated ids and repeated rows."""
    base, shared = passage(1, 120), passage(2, 70)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, base), (7, base), (8, " ".join(near)), (9, passage(3, 40) + " " + shared + " " + passage(4, 50)),
        (10, passage(5, 33) + " " + shared + " " + passage(6, 20)), (11, "Released under the MIT License. " + passage(7, 30)), (12, "a " * 3000), (13, passage(8, 4000)),
        (14, "é ü 漢字 🙂 " * 40), (15, base.upper()), (16, "x" * 3000), (6, base), (17, passage(9, 60)), (17, passage(10, 60)), (None, "no id " + passage(11, 50)), (None, base),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
