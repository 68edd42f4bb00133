"""Shared folders, sizes and hashing that several corpus operators use."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own on a single
    machine, and on a cluster one in the warehouse, never a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            held = f"{spark.conf.get('spark.sql.warehouse.dir')}/_cellweave"
            spark.sparkContext.setCheckpointDir(held)
        at = held or tempfile.mkdtemp(prefix="cellweave-")
        if not held:
            spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


class Workspace:
    """Parquet tables in the shared folder that cut lineage; they outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def remove(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of DataFrames that are no longer referenced."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, each: int = 8 << 20, most: int = 1_000_000) -> int:
    """Shards for a shuffle of df's rows: they grow with the input, so that a task's share doesn't, up to `most` (at 100
    TB a shard is then some 100 MB of files; tasks take several shards one after the other)."""
    held = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(max(held, -(-min(plan_bytes(df), 1 << 50) // each)), most))


def prime_from(n: int) -> int:
    """The least prime of n or more: ids with a common stride still fill all of so many buckets."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session's Arrow batches hold at most so many bytes, unless they are set to hold less already:
    Spark's own buffers for them lie outside its heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > most:
        spark.conf.set(key, str(most))


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and the text's UTF-8 bytes, by name; other columns are left out."""
    bounded_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the published splitmix64 finaliser's constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def random_words(seed: int, n: int, odd: bool = False) -> np.ndarray:
    out = np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=U64)
    return out | U64(1) if odd else out


def powers(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(n, random_words(seed, 1, True)[0], U64))


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of bytes with a gap after each; where each starts and how long it is."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + len(gap))))[: len(texts)].astype(np.int64)
    return np.frombuffer(gap.join(texts) + gap, np.uint8), starts, lengths


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end positions of maximal runs without separators."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SEPARATORS[buf]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit polynomial hash of every word over a random table of byte values."""
    if not len(starts):
        return np.zeros(0, U64)
    at = np.arange(len(buf), dtype=np.int32)
    owner = np.zeros(len(buf), np.int32)
    owner[starts] = np.diff(starts, prepend=0)
    at -= np.cumsum(owner, dtype=np.int32)
    del owner
    longest = int((ends - starts).max())
    values = random_words(seed, 256)[buf]
    with np.errstate(over="ignore"):
        values *= powers(seed + 1, longest + 1)[np.clip(at, 0, longest)]
        values[SEPARATORS[buf]] = 0
        out = np.add.reduceat(values, starts)
        return mix(out + (ends - starts).astype(U64))


def put_sorted(codes: np.ndarray) -> bytes:
    """Ascending 64-bit codes as byte planes of their gaps; high planes are zeros that block compression removes."""
    gaps = np.diff(codes, prepend=U64(0))
    return np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def get_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=U64)


def put_ints(values: np.ndarray) -> bytes:
    """Integers as byte planes of their distance from the least, which comes first."""
    base = np.int64(values.min()) if len(values) else np.int64(0)
    off = (values.astype(np.int64).view(U64) - np.asarray(base).view(U64)).astype("<u8")
    return np.asarray(base, "<i8").tobytes() + np.ascontiguousarray(off.view(np.uint8).reshape(-1, 8).T).tobytes()


def get_ints(blob: bytes) -> np.ndarray:
    base = np.frombuffer(blob[:8], "<i8")[0]
    planes = np.frombuffer(blob, np.uint8, offset=8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return (np.ascontiguousarray(planes.T).view("<u8").reshape(-1) + np.asarray(base).view(U64)).view(np.int64)


def slices(texts: list[bytes], size: int = 2 << 20):
    """Slices of texts that hold about so many bytes each."""
    a = held = 0
    for b, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield slice(a, b + 1)
            a, held = b + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def chunks(batches, size: int = 2 << 20):
    """(doc_ids, texts as UTF-8) from Arrow batches of (doc_id, text), some megabytes at a time; null texts are empty."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = b or b""
            ids.append(i)
            texts.append(b)
            held += len(b)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
