"""A quality classifier on supervised subword embeddings.

Words, character n-grams and neighbouring words of a text are hashed to slots of learned vectors; a document is the mean
of its groups' mean vectors, and a softmax layer gives the classes. Vectors and layer are trained by numpy stochastic
gradient descent on the driver, on a bounded sample of labelled rows (SAMPLE; whole texts). What comes from outside a
text (labels, language, source, id) is no input.

Scale: with the layer applied, a slot's vector is one number (the difference of the two classes), so scoring is a lookup
and a mean, one pass over the texts in Arrow batches without a shuffle. The table of numbers has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, documents_of, joined, slices, table, word_bounds, word_hashes

SLOTS_LOG2 = 17
SLOTS = 1 << SLOTS_LOG2
DIM = 8
#: The most labelled rows that training reads, about; a share of all by a hash of doc_id.
SAMPLE = 4000
FOLDS = 5
SAME, OTHER = 0, 1  # slots of neighbours: equal, and different, words
CHARS = (3, 4)


def slots_of(texts: list[bytes]):
    """For each group of features (words, neighbours, character n-grams): slots in order and each text's bounds."""
    buf, at, lengths = joined(texts)
    starts, ends = word_bounds(buf)
    words = word_hashes(buf, starts, ends, 500)
    bounds = np.searchsorted(starts, np.concatenate((at, [len(buf)])))
    yield (words >> np.uint64(64 - SLOTS_LOG2)).astype(np.int32), bounds[:-1], bounds[1:]
    pair = np.where(words[1:] == words[:-1], SAME, OTHER).astype(np.int32)
    yield pair, np.minimum(bounds[:-1], len(pair)), np.clip(bounds[1:] - 1, np.minimum(bounds[:-1], len(pair)), len(pair))
    gram = buf.astype(np.uint32)
    for n in range(2, max(CHARS) + 1):
        gram = (gram[:-1] << np.uint32(8)) | buf[n - 1 :]
        if n in CHARS:
            slot = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - SLOTS_LOG2)
            first = np.minimum(at, len(slot))
            yield slot.astype(np.int32), first, np.clip(at + lengths - n + 1, first, len(slot))


def scores(texts: list[bytes], values: np.ndarray, bias: float) -> np.ndarray:
    """The probability of class 1 for each text; that of the bias for one without features."""
    total, groups = np.zeros(len(texts)), np.zeros(len(texts))
    with np.errstate(over="ignore"):
        for slot, a, b in slots_of(texts):
            sums = np.concatenate(([0.0], np.cumsum(values[slot], dtype=np.float64)))
            n = b - a
            total += np.where(n > 0, (sums[b] - sums[a]) / np.maximum(n, 1), 0)
            groups += n > 0
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(groups, 1) + bias, -30, 30)))


def bags(texts: list[bytes]):
    """(slots, weights) of each text: its groups' means, added up and averaged."""
    with np.errstate(over="ignore"):
        parts = list(slots_of(texts))
    for t in range(len(texts)):
        own = [s[a[t] : b[t]] for s, a, b in parts if b[t] > a[t]]
        if not own:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            continue
        slot = np.concatenate(own)
        weight = np.concatenate([np.full(len(s), 1 / (len(s) * len(own)), np.float32) for s in own])
        ids, inverse = np.unique(slot, return_inverse=True)
        yield ids, np.bincount(inverse, weight).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 2) -> tuple[np.ndarray, float]:
    """Vectors and softmax layer by stochastic gradient descent with per-coordinate step sizes; folded to one number a
    slot and a bias."""
    if not len(texts) or len(set(labels.tolist())) < 2:
        return np.zeros(SLOTS, np.float32), 4.0 if not len(labels) or labels[0] else -4.0
    held = [x for a in range(0, len(texts), 64) for x in bags(texts[a : a + 64])]
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / DIM, 1 / DIM, (SLOTS, DIM)).astype(np.float32)
    layer, bias = r.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_l, seen_b = np.full(SLOTS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = r.permutation(len(held))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            ids = np.concatenate([held[k][0] for k in rows])
            w = np.concatenate([held[k][1] for k in rows])
            own = np.repeat(np.arange(len(rows)), [len(held[k][0]) for k in rows])
            doc = np.stack([np.bincount(own, vectors[ids, d] * w, len(rows)) for d in range(DIM)], axis=1).astype(np.float32)
            z = doc @ layer + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            miss = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = miss @ layer.T
            grad_l, grad_b = doc.T @ miss, miss.sum(axis=0)
            uniq, inverse = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inverse, back[own, d] * w, len(uniq)) for d in range(DIM)], axis=1).astype(np.float32)
            seen_v[uniq] += (grad**2).mean(axis=1)
            vectors[uniq] -= step * grad / np.sqrt(seen_v[uniq])[:, None]
            seen_l += grad_l**2
            layer -= step * 0.2 * grad_l / np.sqrt(seen_l)
            seen_b += grad_b**2
            bias -= step * 0.2 * grad_b / np.sqrt(seen_b)
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """About `most` rows (text, quality) at most, of those outside the held-out fold, by a hash of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    n = own.count()
    if n > most:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return documents_of(docs).join(F.broadcast(own), "doc_id").select("doc_id", "text", "quality")  # own: about `most` rows


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    rows = sorted(((r.doc_id, bytes(r.text or b""), r.quality) for r in labelled_sample(docs, labels, most).toLocalIterator()), key=lambda r: r[:2])
    return train([t for _, t, _ in rows], np.array([q for _, _, q in rows]))


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row."""
    values, bias = model

    def run(batches):
        for ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores(texts, values, bias))], names=["doc_id", "score"])

    return documents_of(docs).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Null text is empty, and empty texts score the bias. Null
    doc_id: not held out. Repeated rows come back as they are. Without labels of both classes every score is the same.
    Extra columns are ignored."""
    out = scored(docs, fitted(docs, labels, most))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """docs without those that the classifier rejects; columns as they are."""
    values, bias = fitted(docs, labels, most)
    schema = docs.schema
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            got = np.concatenate([np.zeros(0), *[scores(texts[part], values, bias) for part in slices(texts)]])
            yield b.filter(pa.array(got >= threshold))

    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
