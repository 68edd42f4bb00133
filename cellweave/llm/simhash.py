"""SimHash fingerprints of word shingles, and links between those that differ in few bits, by pivot distance tables.

Every fingerprint has a row of precomputed Hamming distances to many reference fingerprints (pivots). By the triangle
inequality two fingerprints within r bits have rows that differ by at most r in every coordinate, so a pair whose rows
differ by more is discarded unseen; the survivors are verified on the fingerprints themselves.

Scale: rows are only compared inside buckets, since a table of all pairs has no place at 100 TB. Of six blocks of a
fingerprint at least two are equal if four bits differ or fewer, so each pair of blocks deals fingerprints to buckets of
about N / 2^21, and no link is lost. Equal fingerprints are one node. What a task finds leaves it as a star to the least
node of each local group, not as pairs; inside a bucket of thousands a leader links its surroundings first, and only
groups that may still touch are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import U64, Workspace, chunks, documents_of, parts_for, random_words, table
from .components import least_labels, roots

HOT = 1500


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bit by bit the majority of the shingles' XXH64 (seed 42); 0 for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
    ends = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(whole)]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        h = np.array([digest(whole[x:y], 42) for x, y in zip(starts[a : a + (1 << 15)], ends[a : a + (1 << 15)], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, a signed long with the fingerprint's bits."""

    def run(batches):
        for ids, texts in chunks(batches, 16 << 20):
            fps = np.array([fingerprint(t, width) for t in texts], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return documents_of(docs).mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots], axis=1).astype(np.int8)


def close(i: np.ndarray, j: np.ndarray, fps: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those within so many bits: first by the pivots' coordinates, a few at a time."""
    for a in range(0, rows.shape[1], 4):
        if not len(i):
            return i, j
        keep = (np.abs(rows[i, a : a + 4] - rows[j, a : a + 4]) <= bits).all(axis=1)
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= bits
    return i[keep], j[keep]


def crowd(fps: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within a large bucket, without all its pairs. A leader is linked to all
    within reach, and those are no leaders; afterwards groups not yet connected are compared if their leaders are near
    enough for any of their members to be."""
    n, free = len(fps), np.ones(len(fps), bool)
    led = np.full(n, -1)
    i, j, leaders = [], [], []
    while free.any():
        x = int(np.argmax(free))
        near = np.flatnonzero((np.abs(rows - rows[x]) <= bits).all(axis=1)) if rows.shape[1] else np.arange(n)
        near = near[np.bitwise_count(fps[near] ^ fps[x]) <= bits]
        i.append(np.full(len(near), x))
        j.append(near)
        led[near[free[near]]] = len(leaders)
        leaders.append(x)
        free[near] = False
    i, j = np.concatenate(i), np.concatenate(j)
    heads, label = np.array(leaders), roots(n, i, j)
    order = np.argsort(led, kind="stable")
    cuts = np.searchsorted(led[order], np.arange(len(heads) + 1))
    for a, x in enumerate(heads):
        far = np.bitwise_count(fps[heads[a + 1 :]] ^ fps[x])
        for b in a + 1 + np.flatnonzero((far > bits) & (far <= 3 * bits)):
            if label[heads[b]] == label[x]:
                continue
            p, q = order[cuts[a] : cuts[a + 1]], order[cuts[b] : cuts[b + 1]]
            for s in range(0, len(p), 512):
                u, v = np.repeat(p[s : s + 512], len(q)), np.tile(q, len(p[s : s + 512]))
                u, v = close(u, v, fps, rows, bits)
                if len(u):
                    i, j = np.append(i, u[0]), np.append(j, v[0])
                    label = roots(n, np.append(np.arange(n), u[0]), np.append(label, v[0]))
                    break
    return i, j


def star_links(bits: int, n_pivots: int):
    """Over rows (key, fp) that hold whole buckets: links (a, b) from each fingerprint to the least of its local group."""

    def run(batches):
        t = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not t:
            return
        key, fp = np.concatenate([x for x, _ in t]), np.concatenate([y for _, y in t]).view(U64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fps, own = np.unique(fp[order], return_inverse=True)
        rows = pivot_table(fps, random_words(303, n_pivots))
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.repeat(np.diff(edges), np.diff(edges))
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1], edges[1:], strict=True) if len(size) and size.max() > HOT else ():
            if b - a > HOT:
                some = own[a:b]
                x, y = crowd(fps[some], rows[some], bits)
                i.append(some[x])
                j.append(some[y])
        at = np.flatnonzero((size > 1) & (size <= HOT))
        last = np.repeat(edges[1:], np.diff(edges))
        shift = 1
        while len(at := at[at + shift < last[at]]):
            for s in range(0, len(at), 1 << 19):
                x, y = close(own[at[s : s + (1 << 19)]], own[at[s : s + (1 << 19)] + shift], fps, rows, bits)
                i.append(x)
                j.append(y)
            shift += 1
            if shift % 64 == 0:
                f = roots(len(fps), np.concatenate(i), np.concatenate(j))
                i, j = [np.flatnonzero(f != np.arange(len(f)))], [f[f != np.arange(len(f))]]
        label = roots(len(fps), np.concatenate(i), np.concatenate(j))
        a = np.flatnonzero(label != np.arange(len(label)))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[label[a]].view(np.int64))], names=["a", "b"])

    return run


def blocks_for(bits: int, equal: int = 2) -> list[tuple[int, int]]:
    """(first bit, width) of bits + equal blocks; of these at least `equal` agree if at most `bits` bits differ."""
    n = bits + equal
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def bucket_keys(fp, bits: int):
    """One key for each pair of blocks: which pair, and what the two blocks hold."""
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in blocks_for(bits)]
    return F.array(*[F.lit(k << 48) + F.shiftleft(block[x], 24) + block[y] for k, (x, y) in enumerate(combinations(range(len(block)), 2))])


def starred(fps: DataFrame, bits: int, n_pivots: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Of fps (doc_id, fp): the distinct fingerprints (node, label: their least doc_id), and links (a, b) from each to the
    least of a local group within so many bits."""
    nodes = space.save(fps.filter(F.col("doc_id").isNotNull()).groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("label")), "nodes")
    dealt = nodes.select(F.explode(bucket_keys(F.col("node"), bits)).alias("key"), F.col("node").alias("fp"))
    stars = dealt.repartition(parts_for(dealt), "key").mapInArrow(star_links(bits, n_pivots), "a long, b long").distinct()
    return nodes, space.save(stars, "stars")


def components(fps: DataFrame, bits: int = 4, n_pivots: int = 24, space: Workspace | None = None) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most `bits` differing bits."""
    space = space or Workspace(fps.sparkSession, "simhash")
    fps = space.save(fps, "fps")
    nodes, stars = starred(fps, bits, n_pivots, space)
    links = stars.union(stars.select("b", "a"))
    linked = nodes.join(links.select(F.col("a").alias("node")).distinct(), "node")
    least = least_labels(space.save(linked, "linked"), links, space)
    found = nodes.join(least.withColumnRenamed("label", "least"), "node", "left").select(F.col("node").alias("fp"), F.coalesce("least", "label").alias("component_id"))
    return fps.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def close_documents(fps: DataFrame, bits: int = 4, n_pivots: int = 24) -> DataFrame:
    """Pairs (a, b) of doc_ids that connect all documents of fps (doc_id, fp) whose fingerprints are connected."""
    nodes, stars = starred(fps, bits, n_pivots, Workspace(fps.sparkSession, "close"))
    equal = fps.join(nodes, fps["fp"] == nodes["node"]).filter(F.col("label") < F.col("doc_id")).select(F.col("label").alias("a"), F.col("doc_id").alias("b"))
    one, two = nodes.toDF("a", "x"), nodes.toDF("b", "y")
    return equal.union(stars.join(one, "a").join(two, "b").select(F.least("x", "y"), F.greatest("x", "y")))


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Null or blank text: fingerprint zero, which links like any other. Null doc_id: a fingerprint, and the component of
    equal fingerprints if a document with an id has one, else null. Repeated rows come back as often as they are there.
    Extra columns are ignored."""
    found = components(fingerprints(docs, width), bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 4) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over pairs of documents whose sets of shingles of `width`
    words have at least so many percent of their union in common; of documents with an id.

    Fingerprints (of the distinct shingles) within `bits` bits, found by the pivots' tables, come first and are verified
    on the sets. Sets alike in 80 percent may lie 20 bits apart, where no table of pivots or blocks discards anything, so
    the links beyond are completed by the shingles themselves (near_copies), which meet, are discarded if their
    fingerprints lie too far apart for that likeness, and are verified. Null or wordless texts are equal. Rows that repeat
    a doc_id with another text are one node. Extra columns are ignored."""
    return near_copies.components(docs, width, percent, lambda fps: close_documents(fps, bits))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 4) -> DataFrame:
    """docs without documents that a smaller doc_id's group of similar ones holds; columns as they are. Rows with null
    doc_id, and rows that repeat a kept doc_id, stay."""
    found = similar(docs, width, percent, bits).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, bits=4)
