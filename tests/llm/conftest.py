import random

import pytest


def words(r, n):
    return " ".join("".join(r.choice("etaonrishdlu") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, repeats within a text, blanks and other scripts."""
    r = random.Random(4)
    base = [words(r, r.randint(5, 220)) for _ in range(30)]
    shared = words(r, 40)
    texts = list(base)
    texts += [base[3], base[3], base[5] + "  ", base[7].replace(" ", "\n")]
    texts += [" ".join(w if k % 40 else "changed" for k, w in enumerate(base[k_].split())) for k_ in (8, 9, 10)]
    texts += [words(r, 30) + " " + shared + " " + words(r, 20) for _ in range(6)]
    texts += [(words(r, 3) + " ") * 40, "x" * 400, "", " \n\t ", "один два три четыре пять " * 12, "日本語" * 80, "a b c", "Mail a.b@c.example.com or +1 (555) 010-0199, 10.0.0.1."]
    return [(k * 3, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_rows():
    """Null and repeated ids, null, empty and very long texts."""
    long = "alpha beta gamma delta " * 4000
    return [(None, "null id row with some words in it and more"), (1, None), (2, ""), (3, long), (4, "same text here twice over for ties"), (4, "same text here twice over for ties"), (4, "another text of the same id"), (5, "same text here twice over for ties")]


SCHEMA = "doc_id long, text string"
#: Extra columns whose names clash with what operators use inside.
CLASHING = ["bucket", "shard", "kind", "codes", "docs", "fp", "node", "label", "key", "h1", "h2", "_h1", "_gone", "_both", "_base", "_every", "base_spans", "all_spans", "score", "class", "next", "range", "guest", "words", "window", "quality"]


@pytest.fixture
def frame(spark):
    def make(rows, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, SCHEMA)
        return df.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)]) if extra else df

    return make
