"""Packing of tokenised documents into sequences, as a cutting-stock problem solved by column generation.

A document is cut into whole sequences and a rest. The rests' lengths form a histogram; a linear program over patterns
(which lengths share a sequence) is solved by column generation, in which a knapsack dynamic program prices new
patterns; the solution is rounded down, what remains is filled first-fit, and the patterns' places are given to the
documents by their rank within their length class.

Scale: texts are tokenised once, in their own tasks, and leave them as lengths and checksums. The histogram has at most
length / QUANTUM rows whatever the input, so the program is solved on the driver. Ranks come from counts by (class,
bucket) and a row number within these, and sequences from a join with the table of patterns, whose size is bounded by
the number of classes; a length that a third of all documents have is spread over all buckets.
"""

from __future__ import annotations

import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, chunks, documents_of, parts_for, table

QUANTUM = 8
GAP = 2e-4
STAY = 0.95
CACHED = 300_000
END = 1


#: Letters whose lower case is the same for any tokenizer, in any context.
PLAIN = re.compile("[^\x00-\u024f]")
#: Between a small letter and punctuation (but an apostrophe, which may begin a contraction) words are cut anyway.
STOP = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])(?=[!-&(-/:-@\\[-`{-~])")
#: Bytes as the byte-level vocabularies spell them: printable ones stand for themselves, the rest follow from 256 on.
SPELLED = {b: chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
SPELLED |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SPELLED)}


class Numbered(dict):
    """Words by number; a word not seen before gets the next one and is noted."""

    def __init__(self):
        super().__init__({"": 0})
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k


class WordEncoder:
    """Ids of a tokenizer that lower-cases, never joins what blanks and line feeds separate, and splits letters from
    punctuation. Each distinct word is encoded once by the tokenizer itself and kept in a bounded store."""

    def __init__(self, path: str, apart: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart, self.apart_id = apart, self.tokenizer.token_to_id(apart)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.known = Numbered()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.size = np.zeros(CACHED * 2, np.int64), np.zeros(CACHED * 2, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encodes words: those of Latin letters by the tokenizer's model, which is all that is left to do for them; others
        together, a special token between them; those that may hold one, one by one."""
        letters = [w for w in words if w.isalpha() and not PLAIN.search(w) and w.islower()]
        held = set(letters)
        plain = [w for w in words if w not in held and "<|" not in w]
        odd = [w for w in words if w not in held and "<|" in w]
        parts = []
        if letters:
            tokens = self.model.tokenize
            found = [[t.id for t in tokens(w if w.isascii() else w.encode().decode("latin-1").translate(SPELLED))] for w in letters]
            parts.append((letters, np.array(list(chain.from_iterable(found)), np.uint32), np.array(list(map(len, found)))))
        if plain:
            ids = np.array(self.tokenizer.encode(self.apart.join(plain), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.apart_id)
            size = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
            parts.append((plain, ids[ids != self.apart_id], size))
        if odd:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            parts.append((odd, np.concatenate(found), np.array([len(f) for f in found])))
        for names, ids, size in parts:
            at = np.array([self.known[w] for w in names])
            while len(self.known) > len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.size))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.at[at], self.size[at] = self.used + np.cumsum(size) - size, size
            self.used += len(ids)

    def words(self, text: str) -> list[str]:
        if "<|" not in text and not PLAIN.search(text):
            text = STOP.sub(" ", text.lower())
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED:
            self.clear()
        words = [self.words(t) for t in texts]
        index = np.array(list(map(self.known.__getitem__, chain.from_iterable(words))), np.int64)
        fresh, self.known.fresh = self.known.fresh, []
        for start in range(0, len(fresh), 20_000):
            self.learn(fresh[start : start + 20_000])
        size = self.size[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([len(ws) for ws in words])
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], last))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenised(docs: DataFrame, length: int, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, doc_tokens (with the end's id) and, for each piece of `length` ids and the rest, its checksum (and ids)."""

    def run(batches):
        encode = encoder(path or default_tokenizer()).encode
        for ids, texts in chunks(batches, 1 << 20):
            found = [np.append(x, END).astype("<u4") for x in encode([t.decode("utf-8", "replace") for t in texts])]
            sums = [[zlib.crc32(x[a : a + length].tobytes()) for a in range(0, len(x), length)] for x in found]
            cols = [pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
            names = ["doc_id", "doc_tokens", "sums"]
            if with_ids:
                cols.append(pa.array([x.tobytes() for x in found], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents_of(docs).mapInArrow(run, "doc_id long, doc_tokens long, sums array<long>" + ", ids binary" * with_ids)


def price(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The pattern of most value in `room`: a knapsack by dynamic programming, any number of each size."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        fits = np.flatnonzero(sizes <= w)
        if len(fits):
            got = best[w - sizes[fits]] + value[fits]
            k = int(np.argmax(got))
            if got[k] > best[w] + 1e-12:
                best[w], pick[w] = got[k], fits[k]
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
            continue
        pattern[pick[w]] += 1
        w -= sizes[pick[w]]
    return pattern, float(best[room])


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): together each size as often as demanded. Column generation on the linear program, until the
    duals' bound shows that at most GAP of the sequences could still be saved; rounded down, then up where demand allows;
    the rest goes first-fit in order of size, at most about one item a class and pattern."""
    if not len(sizes):
        return []
    n = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    x, bound, best = np.linalg.solve(basis, demand.astype(float)), 0.0, None
    for _ in range(most):
        duals = np.linalg.solve(basis.T, np.ones(n))
        pattern = None
        if best is not None:  # duals swing; patterns are priced near those of the best bound as long as that helps
            calm = STAY * best + (1 - STAY) * duals
            found, value = price(calm, sizes, room)
            if (low := float(calm @ demand) / max(value, 1.0)) > bound:
                bound, best = low, calm
            pattern = found if duals @ found > 1 + 1e-6 else None
        if pattern is None:
            pattern, value = price(duals, sizes, room)
            if best is None or float(duals @ demand) / max(value, 1.0) > bound:
                bound, best = float(duals @ demand) / max(value, 1.0), duals
            if value <= 1 + 1e-7:
                break
        if x.sum() <= bound * (1 + GAP):
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        x = np.linalg.solve(basis, demand.astype(float))
    left, plan = demand.astype(np.int64).copy(), []
    whole = np.floor(x + 1e-6)
    for j in np.argsort(-x, kind="stable"):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(whole[j]), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    for j in np.argsort(whole - x, kind="stable"):  # once more where most is left over, as far as demand goes
        pattern = np.rint(basis[:, j]).astype(np.int64)
        if pattern.any() and (pattern <= left).all():
            plan.append((pattern, 1))
            left -= pattern
    while left.any():
        pattern, free = np.zeros(n, np.int64), room
        for k in np.argsort(-sizes, kind="stable"):
            take = min(int(left[k]), free // int(sizes[k]))
            pattern[k] += take
            free -= take * int(sizes[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def place_table(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each class of a pattern: (class, first rank, past the last, how many a sequence, first sequence, first slot)."""
    rows, given, base = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in plan:
        slot = 0
        for k in np.flatnonzero(pattern):
            a = int(pattern[k])
            rows.append((int(sizes[k]), int(given[k]), int(given[k] + a * times), a, base, slot))
            given[k] += a * times
            slot += a
        base += times
    return rows


def packed(docs: DataFrame, length: int = 2048, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian).

    Every row of docs is packed, repeated ones too. Null or empty text is one id, the end's. Null doc_ids stay null.
    Extra columns are ignored. An empty table gives no rows."""
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    buckets = parts_for(docs)
    told = space.save(tokenised(docs, length, path, with_ids), "tokens")
    rest = (F.col("doc_tokens") % length).cast("int")
    rows = told.select("*", rest.alias("rest"), F.ceil(rest / QUANTUM).cast("int").alias("class"), F.pmod(F.xxhash64("doc_id", "doc_tokens", "sums"), F.lit(buckets)).cast("int").alias("bucket"))
    rows = rows.withColumn("whole", F.floor(F.col("doc_tokens") / length).cast("long"))

    # Counts by (class, bucket): a row for each, and per class at most length / QUANTUM for the driver.
    counts = space.save(rows.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")), "counts")
    totals = {r[0]: r[1] for r in counts.filter("class > 0").groupBy("class").agg(F.sum("n")).collect()}
    sizes = np.array(sorted(totals), np.int64)
    plan = cutting_stock(sizes, np.array([totals[int(k)] for k in sizes], np.int64), -(-length // QUANTUM)) if totals else []
    places = spark.createDataFrame(place_table(sizes, plan) or [(0, 0, 0, 1, 0, 0)], "class int, low long, high long, each long, base long, slot long")
    first_whole = sum(t for _, t in plan)

    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    ahead = counts.select(F.col("class").alias("c"), F.col("bucket").alias("b"), before)
    by_bucket = counts.groupBy("bucket").agg(F.sum("whole").alias("w")).select(F.col("bucket").alias("b2"), F.coalesce(F.sum("w").over(Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("wholes"))  # a row for each bucket
    key = ["doc_id", "doc_tokens", "sums"]
    spots = rows.select("*", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*key)).alias("at"))
    rests = spots.filter("class > 0").join(ahead, (F.col("class") == F.col("c")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("before") + F.col("at") - 1)
    rests = rests.join(F.broadcast(places.withColumnRenamed("class", "c2")), (F.col("class") == F.col("c2")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))  # places: bounded by the classes
    off = F.col("rank") - F.col("low")
    start = F.col("whole") * length
    more = [F.expr(f"substring(ids, whole * {4 * length} + 1, rest * 4)").alias("ids")] if with_ids else []
    rests = rests.select("doc_id", start.alias("start"), F.col("rest").cast("long").alias("length"), F.element_at("sums", -1).alias("ids_crc32"), "doc_tokens", (F.col("base") + F.floor(off / F.col("each"))).cast("long").alias("sequence_id"), (F.col("slot") + off % F.col("each")).alias("in"), *more)
    inside = Window.partitionBy("sequence_id").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("in")

    running = F.coalesce(F.sum("whole").over(Window.partitionBy("bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wholes = rows.filter("whole > 0").withColumn("run", running).join(by_bucket, F.col("bucket") == F.col("b2"))
    wholes = wholes.select("*", F.posexplode(F.slice("sums", F.lit(1), F.col("whole").cast("int"))).alias("k", "ids_crc32"))
    more = [F.expr(f"substring(ids, k * {4 * length} + 1, {4 * length})").alias("ids")] if with_ids else []
    wholes = wholes.select("doc_id", (F.col("k") * F.lit(length).cast("long")).alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(first_whole) + F.col("wholes") + F.col("run") + F.col("k")).cast("long").alias("sequence_id"), *more, F.lit(0).cast("long").alias("offset"))
    return rests.unionByName(wholes).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"), *["ids"] * with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), length=2048)
