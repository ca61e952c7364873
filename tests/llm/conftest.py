import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("class", T.StringType())]
)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, shared passages, personal data, odd characters."""
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    base = prose(rnd, 120)
    words = base.split(" ")
    near = list(words)
    near[60] = "changed"
    out = [(0, None), (1, ""), (2, "   "), (3, "one"), (4, "one two"), (5, "One  TWO"), (6, base), (7, base), (8, " ".join(near)), (9, prose(rnd, 20) + " " + passage + " " + prose(rnd, 15)), (10, passage + " " + prose(rnd, 9))]
    out += [(11, "mail bob.smith@example.org or 10.0.0.256 and 192.168.1.1, card 4111 1111 1111 1111, call +49 (30) 123-4567-89 now"), (12, "é ﬁ İ 日本 ▁x <s> \t\n á ß"), (13, "x" * 3000 + " " + "1" * 2500 + " " + "a.b@" * 300), (14, prose(rnd, 4000)), (15, "same line\n" * 60)]
    out += [(16, prose(rnd, 30)), (16, "another text under the id of its neighbour"), (None, prose(rnd, 25)), (None, "no id"), (6, base), (20, "a.b@c.d.e_f@g.h 1.2.3.4.5 +1234567890123456 4111-1111-1111-1112"), (-7, prose(rnd, 40))]
    return [(i, t, "en" if k % 2 else None, None, None if t is None else len(t), "clash", "clash") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
