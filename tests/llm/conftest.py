import random

import pytest

#: Columns whose names clash with those that operators use inside.
SCHEMA = "doc_id bigint, text string, row bigint, rep string, label string, source string, lang string, bucket int, length int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ro", "ti", "men", "sul", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and long texts, null and repeated ids, equal and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    plain = [prose(rng, rng.randint(40, 120)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, long), (24, plain[0]), (25, plain[0]), (25, plain[0]), (None, plain[1]), (None, None), (26, "one"), (27, "x" * 3000), (28, "Ünïcödé ’tïs 日本 'll don't"), (29, plain[3] + "\n" + plain[3])]
    return [(d, t, 7, "r", None, "s", None, 1, 2) for d, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
