"""The pipeline's near-duplicates against all pairs of documents."""

import random

import pytest


def brute(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    label = {i: i for i in texts}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 10 * len(x & y) >= 8 * len(x | y) > 0):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if v == old else v for i, v in label.items()}
    return label


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    line = words(9)
    out = []
    for n in [3, 5, 8, 30, 90, 300, 900]:
        for _ in range(4):
            base = words(n) + line * (r.random() < 0.5)
            out.append(base)
            for share in (0.005, 0.01, 0.02, 0.03, 0.04):
                out.append([f"x{r.randrange(3000)}" if r.random() < share else w for w in base])
            out.append(base[: int(len(base) * r.uniform(0.75, 1))])
    group = words(120)
    for _ in range(90):  # more than a small bucket holds
        copy = list(group)
        copy[r.randrange(120)] = "y"
        copy[r.randrange(120)] = "z"
        out.append(copy)
    out += [[], [], line, line, ["One"], ["one"]]
    r.shuffle(out)
    return {i + 1: " ".join(t) for i, t in enumerate(out)}


def test_stage_links_all_pairs_alike(spark, texts):
    from cellweave.llm import pipeline

    docs = spark.createDataFrame([*texts.items(), (None, "no id")], "doc_id long, text string")
    kept = [r.doc_id for r in pipeline.near_dedup_stage(spark, docs, "").select("doc_id").collect()]
    label = brute(texts)
    assert None in kept and sorted(i for i in kept if i is not None) == sorted(i for i in texts if label[i] == i)


def test_components_are_those_of_all_pairs(spark, texts):
    from cellweave.llm import simhash

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == brute(texts)


def test_large_group_makes_pairs_in_proportion_to_its_members(spark, monkeypatch):
    from cellweave.llm import near_copies, simhash

    r = random.Random(5)
    base = [f"w{r.randrange(3000)}" for _ in range(150)]
    texts = {}
    for i in range(600):
        copy = list(base)
        for k in r.sample(range(150), r.randrange(2, 10)):
            copy[k] = f"x{r.randrange(10**6)}"
        texts[i + 1] = " ".join(copy)
    made, old = [], near_copies.verified

    def counted(pairs, *rest):
        made.append(pairs.distinct().count())
        return old(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in simhash.similar(docs).collect()} == brute(texts)
    assert sum(made) < 4 * len(texts), made


def test_parities_keep_all_alike_and_forest_connects():
    import numpy as np

    from cellweave.llm import near_copies as nc
    from cellweave.llm.components import roots

    r = np.random.default_rng(7)
    for n in (5, 40, 150, 600, 3000):
        for change in (0.02, 0.05, 0.1, 0.4):
            a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[r.random(n) >= change], r.integers(0, 1 << 64, int(n * change), dtype=np.uint64)]))
            odd = list(np.stack([nc.parities(a), nc.parities(b)], axis=1))
            common = len(np.intersect1d(a, b))
            kept = nc.even(np.array([0]), np.array([1]), np.array([len(a), len(b)]), odd, 80)[0]
            assert kept or 100 * common < 80 * (len(a) + len(b) - common)
            assert not (kept and n in (150, 600) and change == 0.4)
    i, j, cost = r.integers(0, 90, 700), r.integers(0, 90, 700), r.integers(0, 9, 700)
    i, j = i - i % 2, j - j % 2  # odd vertices stay alone
    keep = nc.spanning(i, j, cost, 90)
    whole = roots(90, i, j)
    assert (roots(90, i[keep], j[keep]) == whole).all() and len(keep) == 90 - len(set(whole.tolist()))
    closest = np.argsort(cost, kind="stable")
    cheap, label = 0, np.arange(90)
    for e in closest:  # Kruskal
        if label[i[e]] != label[j[e]]:
            cheap += cost[e]
            label[label == label[i[e]]] = label[j[e]]
    assert cost[keep].sum() == cheap
