"""Long texts keep all their anchors."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.llm import syncmers


@pytest.mark.parametrize("n", [2000, 6000])
def test_passage_shared_by_long_texts(spark, n):
    r = random.Random(n)
    words = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    rows = []
    for _ in range(10):
        shared = words(60)
        rows.append((" ".join(words(n // 2) + shared + words(n // 2)), " ".join(words(n // 3) + shared + words(n - n // 3))))
    df = spark.createDataFrame(rows, "a string, b string").select(syncmers.anchors(F.col("a"), 5).alias("a"), syncmers.anchors(F.col("b"), 5).alias("b"))
    got = df.select(F.size("a").alias("n"), syncmers.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(g.x > 0 for g in got) and all(g.n > n / 4 for g in got)


def plain_anchors(text, k=5):
    """Closed syncmers as sets of Python lists, one k-mer after the other."""
    import re

    import xxhash

    def chain(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
        return h - (h >> 63 << 64)

    words = [h - (h >> 63 << 64) for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall("[^\x20\x09-\x0d]{1,12}", text))]
    if len(words) < k:
        return list(dict.fromkeys(chain([w]) for w in words))
    kmers = [words[i : i + k] for i in range(len(words) - k + 1)]
    return list(dict.fromkeys(chain(m) for m in kmers if min(m) in (m[0], m[-1])))


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    shifts = sorted(b.index(h) - i for i, h in enumerate(a) if h in set(b))
    return 2 * sum(abs(s - shifts[len(shifts) // 2]) <= 32 for s in shifts) / (len(a) + len(b)) if shifts else 0.0


def test_fingerprints_by_brute_force(corpus, frame):
    rows = [*corpus, (None, "no id here but words and words"), (None, corpus[9][1]), (None, None)]
    got = {(r.doc_id, r.edited_sha256): r for r in syncmers.fingerprinted(frame(rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(corpus, reverse=True)
    for (i, text), (_, after) in zip(order[:-1], order[1:], strict=True):  # the last one's next has no id
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = next(r for (j, _), r in got.items() if j == i)
        own, changed, following = map(plain_anchors, (text, edited, after))
        assert [*map(int, r.fingerprint.split())] == own and [*map(int, r.edited_fingerprint.split())] == changed
        assert r.near_edited == pytest.approx(plain_likeness(own, changed)) and r.near_next == pytest.approx(plain_likeness(own, following))
