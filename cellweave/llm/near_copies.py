"""The exact part of the SimHash operator's similarity groups: verification and completion by word shingles.

Two sets of which at least `percent` of the union is common share one of their first shingles in any order that all
documents keep: of n shingles the first n - ceil(percent * n) + 1 are keys. Documents meet in the buckets of their keys,
pairs too unlike in size, place or fingerprint are discarded there, and the rest is verified on the whole sets.

Scale: documents of equal sets are one node. Shingles common in a sample (which only sets the order, so no
result hangs on it) come last and are seldom keys. In a large bucket its members first meet one of them. Those that are
not connected by then are compared inside the bucket, but only a least spanning forest of the pairs found leaves it, and
all pairs only where their verification has left groups apart, so a large group of near copies costs rows in proportion
to its members and not to its pairs. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Workspace, chunks, documents_of, joined, mix, parts_for, random_words, release, word_bounds, word_hashes
from .components import least_labels, roots
from .native import small

SHARE, SAMPLE, COMMON, SMALL, BLOCK = 8, 4000, 100_000, 64, 1 << 18
MOST_BROADCAST = 1_000_000
#: A fingerprint has four words of 64 bits. Of two sets alike in 80 percent a bit differs with a chance of 0.1875 at most,
#: and of 0.1582 if both have FEW shingles or more, so more than APART of the 256 bits differ with a chance of about 1 in
#: 10^6 (first number: fewer than FEW shingles in one of them).
WORDS, FEW, APART = ("fp", "fp1", "fp2", "fp3"), 20, (80, 70)
#: A bit of PARITY is the parity of how many of the set's shingles fall on it, so two sets differ in as many shingles as
#: bits at least: pairs that differ in more bits than alike sets do in shingles are discarded without loss.
PARITY = tuple(f"odd{k}" for k in range(8))
LONGS = ", ".join(f"{w} long" for w in WORDS + PARITY)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The ascending hashes of each text's runs of `width` words (ASCII without case); of fewer words the one of all, and
    none without words."""
    buf, starts, lengths = joined([t.lower() for t in texts])
    first, last = word_bounds(buf)
    words = word_hashes(buf, first, last, 501)
    cuts = np.searchsorted(first, np.append(starts, len(buf)))
    factors = random_words(503, width, True)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = min(width, b - a)
            sums = np.zeros(b - a - k + 1 if k else 0, U64)
            for i in range(k):
                sums += words[a + i : b - k + 1 + i] * factors[i]
            out.append(np.unique(mix(sums + U64(k))))
    return out


def needed(n, percent: int):
    """Of n shingles, how many a set as alike as that has at least."""
    return -(-n * percent // 100)


def keys_of(own: np.ndarray, common: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles: those that are not common in ascending order, then the common ones by rank."""
    n = len(own)
    if not n:
        return own
    at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
    held = common[at] == own if len(common) else np.zeros(n, bool)
    ordered = np.concatenate([own[~held], own[held][np.argsort(rank[at[held]], kind="stable")]]) if held.any() else own
    return ordered[: n - needed(n, percent) + 1]


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and set, all its shingles."""

    def run(batches):
        for ids, texts in chunks(batches):
            sets = [s.view(np.int64) for s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "set"])

    return documents_of(docs).mapInArrow(run, "doc_id long, set array<long>")


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending shingles that several documents of a sample (one in SHARE, about SAMPLE at least) hold, and their ranks,
    the commonest last."""
    step = min(-(-docs.count() // SAMPLE), SHARE)
    some = whole_sets(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(step, 1))) == 0), width).select("set").distinct()
    held = some.select(F.explode("set").alias("h")).groupBy("h").count().filter("count >= 3").orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()  # eight bytes a row
    h = held["h"].to_numpy().astype(np.int64).view(U64)
    order = np.argsort(h)
    return h[order], -order.astype(np.int64)


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set: bit by bit the majority of its hashes; 0 for none."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(own), 1 << 14):
        votes += np.unpackbits(own[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(own), bitorder="little").view("<u8")[0])


def parities(own: np.ndarray) -> np.ndarray:
    """PARITY of a set."""
    at = (mix(own + U64(4242)) & U64(64 * len(PARITY) - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * len(PARITY)) & 1, bitorder="little").view("<u8")


def first_keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, digest (of the whole set), n (its size), WORDS (its fingerprint), PARITY, keys."""
    common, rank = common_shingles(docs, width)

    def run(batches):
        for ids, texts in chunks(batches):
            sets = shingle_sets(texts, width)
            keys = [keys_of(s, common, rank, percent).view(np.int64) for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            with np.errstate(over="ignore"):
                fps = [np.array([fingerprint(mix(x + U64(777 * k)) if k else x) for x in sets], U64).view(np.int64) for k in range(len(WORDS))]
                odd = np.array([parities(x) for x in sets], U64).reshape(len(sets), len(PARITY)).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), *map(pa.array, fps), *map(pa.array, odd), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", *WORDS, *PARITY, "keys"])

    return documents_of(docs).mapInArrow(run, f"doc_id long, digest binary, n int, {LONGS}, keys array<long>")


def columns(batches) -> list[np.ndarray]:
    """Each column of all batches, without nulls in them."""
    held = list(batches)
    return [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(held[0].num_columns)] if held else []


def meeting(percent: int):
    """Over rows (key, node, n, at) that hold whole buckets: the rows that have another of like size in their bucket."""

    def run(batches):
        t = columns(batches)
        if not t:
            return
        order = np.lexsort((t[2], t[0]))
        key, n = t[0][order], t[2][order].astype(np.int64)
        near = (key[1:] == key[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
        keep = order[np.concatenate((near, [False])) | np.concatenate(([False], near))]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in t], names=["key", "node", "n", "at"])

    return run


def possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, at: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a bucket's rows can be alike, by their sizes and by what follows the shared key, and are not yet
    connected. At the first key they share this keeps every pair that is alike."""
    least = -(-(n[i] + n[j]) * percent // (100 + percent))
    rest = np.minimum(n[i] - at[i], n[j] - at[j])
    return (label[i] != label[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (rest >= least)


def apart(i: np.ndarray, j: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """In how many bits of all words each pair of rows differs."""
    out = np.zeros(len(i), np.int64)
    for w in words:
        out += np.bitwise_count(w[i] ^ w[j])
    return out


def near(i: np.ndarray, j: np.ndarray, n: np.ndarray, fps: list[np.ndarray]) -> np.ndarray:
    """Which pairs of rows have fingerprints no further apart than those of alike sets."""
    return apart(i, j, fps) <= np.where(np.minimum(n[i], n[j]) < FEW, *APART)


def even(i: np.ndarray, j: np.ndarray, n: np.ndarray, odd: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of rows differ in no more parities than alike sets do in shingles; loses no pair that is alike."""
    both = n[i] + n[j]
    return apart(i, j, odd) <= both - 2 * -(-both * percent // (100 + percent))


def spanning(a: np.ndarray, b: np.ndarray, cost: np.ndarray, size: int) -> np.ndarray:
    """Which of the edges (a, b) between so many vertices form a least spanning forest; of equal costs the first."""
    order = np.argsort(cost, kind="stable")
    a, b = a[order], b[order]
    label, live, chosen = np.arange(size), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(live := live[label[a[live]] != label[b[live]]]):
        best = np.full(size, len(a))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        chosen.append(np.unique(best[best < len(a)]))
        label = roots(size, label[a[chosen[-1]]], label[b[chosen[-1]]])[label]
    return order[np.concatenate(chosen)]


def candidates(percent: int, turn: str):
    """Over rows (key, node, n, at, label, WORDS, and but for the star PARITY) that hold whole buckets: pairs (a, b) of nodes to
    verify. "star": each row meets one of its bucket. "forest": all that are not connected meet, and of the pairs that may
    be alike those stay that connect all of a bucket's labels that any connect, the closest first. "all": all of them."""

    def run(batches):
        t = columns(batches)
        if not t:
            return
        with np.errstate(over="ignore"):
            order = np.lexsort((mix(t[1].view(U64) + U64(1)), t[0]))
        key, node, n, at, label, *words = [x[order].astype(np.int64) for x in t]
        fps, odd = [x.view(U64) for x in words[: len(WORDS)]], [x.view(U64) for x in words[len(WORDS) :]]
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(edges)
        by = np.lexsort((label, key))
        vertex = np.zeros(len(by), np.int64)  # a label of a bucket
        vertex[by[1:]] = np.cumsum((key[by[1:]] != key[by[:-1]]) | (label[by[1:]] != label[by[:-1]]))
        found, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def forest():
            i, j = map(np.concatenate, zip(*found, strict=True))
            keep = spanning(vertex[i], vertex[j], apart(i, j, odd), len(vertex))
            found[:] = [(i[keep], j[keep])]

        def put(i, j):
            nonlocal held
            keep = possible(i, j, n, at, label, percent)
            i, j = i[keep], j[keep]
            keep = near(i, j, n, fps)
            i, j = i[keep], j[keep]
            if odd:
                keep = even(i, j, n, odd, percent)
                i, j = i[keep], j[keep]
            found.append((i, j))
            held += len(i)
            if turn == "forest" and held > BLOCK:
                forest()
                held = 0

        if turn == "star":
            put(np.repeat(edges[:-1], sizes), np.arange(len(key)))
        else:
            last = np.repeat(edges[1:], sizes)
            rows, shift = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL), 1
            while len(rows := rows[rows + shift < last[rows]]):
                put(rows, rows + shift)
                shift += 1
            for k in np.flatnonzero(sizes > SMALL):
                rows = np.arange(edges[k], edges[k + 1])
                names, own, count = np.unique(label[rows], return_inverse=True, return_counts=True)
                rows = rows[np.argsort(own != np.argmax(count), kind="stable")]  # the largest group needs no pairs inside
                step = max(BLOCK // len(rows), 1)
                for x in range(count.max(), len(rows), step):
                    later = np.arange(x, min(x + step, len(rows)))  # each meets all before it
                    before = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
                    put(rows[before], rows[np.repeat(later, later)])
        if turn == "forest":
            forest()
        a, b = (node[np.concatenate(x)] for x in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, space: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough. Only the texts of these pairs are read again, and only their
    sets travel, a copy for each pair."""
    near = small(space.save(pairs.distinct(), f"near{name}"), MOST_BROADCAST)  # two numbers a row
    ends = small(space.save(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"ends{name}"), MOST_BROADCAST)
    sets = space.save(whole_sets(docs.select("doc_id", "text").join(ends, "doc_id", "left_semi"), width), f"sets{name}")
    x, y = sets.toDF("a", "x").join(near, "a"), sets.toDF("b", "y").join(near, "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = x.join(y, ["a", "b"]).filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent)
    out = space.save(alike.select("a", "b").distinct(), f"links{name}")
    space.remove(f"sets{name}")
    return out


def components(docs: DataFrame, width: int, percent: int, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over pairs at least so alike. close gives, for (doc_id, fp) of
    one document for each distinct set, the pairs that fingerprints find; they are verified first, with those of the stars,
    and what they connect need not meet again."""
    space = Workspace(docs.sparkSession, "near")
    docs = docs.filter(F.col("doc_id").isNotNull())
    sets = space.save(first_keys(docs, width, percent), "keys")
    nodes = space.save(sets.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.min_by(w, "doc_id").alias(w) for w in WORDS + PARITY]), "nodes")
    dealt = sets.join(nodes.select("digest", F.col("node").alias("doc_id")), ["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "n", F.posexplode("keys").alias("at", "key")).select("key", "node", "n", "at")
    shards = parts_for(sets)
    rows = space.save(dealt.repartition(shards, "key").mapInArrow(meeting(percent), "key long, node long, n int, at int"), "rows")
    links, labels = None, None
    for k, turn in enumerate(("star", "forest", "all")):
        words = WORDS if turn == "star" else WORDS + PARITY
        who = nodes.select("node", *words)
        who = who.withColumn("label", F.col("node")) if labels is None else who.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        now = rows.join(who, "node").select("key", "node", "n", "at", "label", *words)
        pairs = now.repartition(parts_for(rows, 1 << 20), "key").mapInArrow(candidates(percent, turn), "a long, b long")
        if turn == "star":
            pairs = pairs.union(close(nodes.select(F.col("node").alias("doc_id"), "fp")))
        found = verified(pairs, docs, width, percent, space, str(k))
        links = found if links is None else links.union(found)
        both = links.union(links.select("b", "a"))
        ends = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
        labels = space.save(least_labels(space.save(ends, f"nodes{k}"), both, space), f"least{k}")
        release(docs.sparkSession)
    held = sets.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").join(labels, "node", "left")
    return held.select("doc_id", F.coalesce("label", "node").alias("component_id"))
