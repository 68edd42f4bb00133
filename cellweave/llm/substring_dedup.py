"""Removal of repeated word windows, by a log-structured index of window fingerprints.

The index is a list of sorted immutable runs, sharded by fingerprint. A new batch is turned into sorted pieces inside
its own tasks, merge-joined with the runs shard by shard, and what is new becomes a run of its own; runs of one level
are compacted into one of the next. FingerprintIndex keeps the runs in tables between calls; substring_dedup loads a
whole table, whose batches (by doc_id) go through each shard's runs one after the other inside the shard's task. A fingerprint is 64 bits: 40 bits of one hash are what the merge joins on, 24 bits
of an independent one verify the match, so a window is taken for another with a chance of about (windows held) / 2^64.

Scale: the windows travel as arrays of sorted codes, not as rows; a piece tells a shard each code once, with its least
document, so a window that a third of all documents hold costs a shard one entry a piece. What each document loses
comes back dealt by document. Shards and buckets grow with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace, chunks, documents_of, get_ints, get_sorted, joined, mix, parts_for, prime_from, put_ints, put_sorted, random_words, release, slices, table, word_bounds, word_hashes

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
PIECE = "shard int, kind int, codes binary, docs binary"
RUN, SEEN, LOST = 0, 1, 2
PIECE_WINDOWS = 800_000


def window_codes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of every window of every text, the number of its text, and each text's number of words."""
    buf, at, _ = joined(texts)
    starts, ends = word_bounds(buf)
    owner = np.searchsorted(at, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    n = len(starts) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), n_words
    code = np.zeros(n, U64)
    for seed, bits in ((101, 40), (202, 24)):
        words, total, weights = word_hashes(buf, starts, ends, seed), np.zeros(n, U64), random_words(seed + 7, width, True)
        with np.errstate(over="ignore"):
            for j in range(width):
                total += words[j : n + j] * weights[j]
        code = (code << U64(bits)) | (mix(total) >> U64(64 - bits))
    inside = owner[:n] == owner[width - 1 :]
    return code[inside], owner[:n][inside], n_words


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes >> U64(40)) * U64(shards)) >> U64(24)


def pieces(width: int, shards: int, buckets: int):
    """Sorted pieces of a task's documents: for each shard the codes with their least document; apart from these, by
    bucket of documents, the codes that a document loses to another one of the same piece."""

    def flush(codes: list, docs: list):
        code, doc = np.concatenate(codes), np.concatenate(docs)
        order = np.lexsort((doc, code))
        code, doc = code[order], doc[order]
        first = np.ones(len(code), bool)
        first[1:] = code[1:] != code[:-1]
        least = doc[first][np.cumsum(first) - 1]
        again = ~first & (doc != least)
        again[1:] &= (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        out = []
        lost, lost_doc = code[again], doc[again]
        code, doc = code[first], doc[first]
        cuts = np.searchsorted(shard_of(code, shards), np.arange(shards + 1))
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if b > a:
                out.append((s, SEEN, put_sorted(code[a:b]), put_ints(doc[a:b])))
        out += [(b % shards, LOST, c, d) for b, c, d in by_bucket(lost, lost_doc, buckets)]
        return batch(out)

    most = max(PIECE_WINDOWS, 4 * shards)  # a piece should have some windows for each shard

    def run(batches):
        codes, docs, held = [], [], 0
        for ids, texts in chunks(batches):
            ids, texts = zip(*[(i, t) for i, t in zip(ids, texts, strict=True) if i is not None], strict=True) if any(i is not None for i in ids) else ((), ())
            code, owner, _ = window_codes(list(texts), width)
            if len(code):
                codes.append(code)
                docs.append(np.array(ids, np.int64)[owner])
                held += len(code)
            if held >= most:
                yield flush(codes, docs)
                codes, docs, held = [], [], 0
        if held:
            yield flush(codes, docs)

    return run


def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["shard", "kind", "codes", "docs"])


def by_bucket(codes: np.ndarray, docs: np.ndarray, buckets: int):
    """(bucket, codes, docs) of what documents lose."""
    if not len(codes):
        return
    bucket = docs % buckets
    order = np.argsort(bucket, kind="stable")
    codes, docs, bucket = codes[order], docs[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), codes[a:b].astype("<u8").tobytes(), put_ints(docs[a:b])


class Runs:
    """One shard's sorted immutable runs, each with its level."""

    def __init__(self, fanout: int, held: list[np.ndarray] = ()):
        self.fanout, self.runs = fanout, [(0, h) for h in held]

    def join(self, code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a batch's entries in order of (code, doc): which of them are lost, and the codes that are new. An entry is
        lost if a run has its code (runs hold earlier batches, so they need no documents) or if another document of the
        batch, of smaller id, has it too. Codes are equal only if key and check bits both are."""
        first = np.ones(len(code), bool)
        first[1:] = code[1:] != code[:-1]
        own, least = code[first], doc[first]
        known = np.zeros(len(own), bool)
        for _, held in self.runs:
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            known |= held[at] == own
        group = np.cumsum(first) - 1
        return known[group] | (doc != least[group]), own[~known]

    def add(self, new: np.ndarray) -> None:
        """A run of level 0; while a level holds `fanout` runs, they become one of the next."""
        if len(new):
            self.runs.append((0, new))
        while self.runs and sum(k == self.runs[-1][0] for k, _ in self.runs) >= self.fanout:
            level = self.runs[-1][0]
            merged = np.sort(np.concatenate([r for k, r in self.runs if k == level]))  # runs of one index share no code
            self.runs = [(k, r) for k, r in self.runs if k != level] + [(level + 1, merged)]


def merge_shard(buckets: int, fanout: int, cuts: tuple[int, ...] = (), keep: bool = True):
    """Joins a shard's pieces with its runs, batch after batch (the entries between the doc_ids `cuts`): what documents
    lose, by bucket, and, to keep, what is new as a run."""

    def run(key, t):
        kinds, blobs, docs = (t.column(c).to_pylist() for c in ("kind", "codes", "docs"))
        out = [(int(get_ints(d)[0] % buckets), LOST, c, d) for k, c, d in zip(kinds, blobs, docs, strict=True) if k == LOST]
        runs = Runs(fanout, [get_sorted(c) for k, c in zip(kinds, blobs, strict=True) if k == RUN])
        seen = [(get_sorted(c), get_ints(d)) for k, c, d in zip(kinds, blobs, docs, strict=True) if k == SEEN]
        del blobs
        if seen:
            code, doc = (np.concatenate(x) for x in zip(*seen, strict=True))
            del seen
            part = np.searchsorted(np.array(cuts, np.int64), doc, "left")
            fresh, gone = [], []
            for b in range(len(cuts) + 1):
                own = np.flatnonzero(part == b)
                own = own[np.lexsort((doc[own], code[own]))]
                lost, new = runs.join(code[own], doc[own])
                gone.append(own[lost])
                runs.add(new)
                fresh.append(new)
            gone = np.concatenate(gone)
            out += [(b, LOST, c, d) for b, c, d in by_bucket(code[gone], doc[gone], buckets)]
            fresh = np.sort(np.concatenate(fresh))
            if keep and len(fresh):
                out.append((key[0].as_py(), RUN, put_sorted(fresh), b""))
        return pa.Table.from_batches([batch(out)])

    return run


def compact_shard(key, t):
    """Several runs' rows of a shard as one."""
    codes = [get_sorted(c) for c in t.column("codes").to_pylist()]
    return pa.Table.from_batches([batch([(key[0].as_py(), RUN, put_sorted(np.unique(np.concatenate(codes))), b"")])])


def remove_windows(width: int):
    """Marks the words of a bucket's documents that lost windows cover, and keeps the others."""

    def run(key, docs, lost):
        ids, texts = docs.column("doc_id").to_pylist(), [t or b"" for t in docs.column("text").to_pylist()]
        pairs = [(get_ints(d), np.frombuffer(c, "<u8")) for c, d in zip(lost.column("codes").to_pylist(), lost.column("docs").to_pylist(), strict=True)]
        doc, code = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, U64))
        order = np.argsort(doc, kind="stable")
        doc, code = doc[order], code[order]
        rows = []
        for part in slices(texts):
            some, own = texts[part], ids[part]
            codes, owner, _ = window_codes(some, width)
            cuts = np.searchsorted(owner, np.arange(len(some) + 1))
            for k, (i, text) in enumerate(zip(own, some, strict=True)):
                words = text.split()
                n, kept = len(words), words
                if i is not None and len(doc):
                    x, y = np.searchsorted(doc, [i, i + 1])
                    if y > x and cuts[k + 1] > cuts[k]:
                        hit = np.flatnonzero(np.isin(codes[cuts[k] : cuts[k + 1]], code[x:y]))
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, hit, 1)
                        np.add.at(edge, hit + width, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                text = b" ".join(kept)
                rows.append((i, n, n - len(kept), hashlib.sha256(text).hexdigest(), text))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def whole_rows(remove, names: tuple[str, ...]):
    """Rows without an id lose nothing and need not meet others."""

    def run(batches):
        none = pa.table({n: pa.array([], pa.binary()) for n in names})
        for b in batches:
            yield from remove(None, pa.Table.from_batches([b]), none).to_batches()

    return run


def without(docs: DataFrame, lost: DataFrame, buckets: int, width: int, keep_text: bool) -> DataFrame:
    """The documents without what they lose, dealt by bucket of doc_id."""
    lost = lost.filter(F.col("kind") == LOST).select(F.col("shard").alias("bucket"), "codes", "docs")
    bucket = F.pmod("doc_id", F.lit(buckets)).cast("int").alias("bucket")
    schema, remove = RESULT.replace("kept string", "kept binary"), remove_windows(width)
    done = docs.filter("doc_id IS NOT NULL").select("*", bucket).groupBy("bucket").cogroup(lost.groupBy("bucket")).applyInArrow(remove, schema)
    done = done.unionByName(docs.filter("doc_id IS NULL").mapInArrow(whole_rows(remove, ("codes", "docs")), schema))
    kept = F.col("kept").cast("string").alias("kept")
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", *[kept] * keep_text)


class FingerprintIndex:
    """Window fingerprints of all earlier batches. ingest() takes batches in order of doc_id (or of arrival)."""

    def __init__(self, spark: SparkSession, shards: int, buckets: int, width: int = 13, fanout: int = 2):
        self.spark, self.width, self.shards, self.buckets, self.fanout = spark, width, shards, buckets, fanout
        self.space, self.runs, self.n = Workspace(spark, "fingerprints"), [], 0

    def ingest(self, docs: DataFrame, keep_text: bool = True) -> DataFrame:
        """Removes from docs each window that an earlier batch or a document of smaller doc_id holds, then adds docs'
        windows to the index. Returns RESULT; without keep_text, kept is left out."""
        docs = documents_of(docs)
        self.n += 1
        rows = docs.mapInArrow(pieces(self.width, self.shards, self.buckets), PIECE)
        for _, _, run in self.runs:
            rows = rows.unionByName(run)
        merged = self.space.save(rows.groupBy("shard").applyInArrow(merge_shard(self.buckets, self.fanout), PIECE), f"batch{self.n}")
        done = self.space.save(without(docs, merged, self.buckets, self.width, keep_text), f"done{self.n}")
        run = self.space.save(merged.filter(F.col("kind") == RUN), f"run{self.n}")
        self.space.remove(f"batch{self.n}")
        self.runs.append((0, f"run{self.n}", run))
        self.compact()
        return done

    def compact(self) -> None:
        """While a level holds `fanout` runs, they become one run of the next level."""
        while self.runs:
            level = self.runs[-1][0]
            same = [r for r in self.runs if r[0] == level]
            if len(same) < self.fanout:
                return
            rows = same[0][2]
            for _, _, run in same[1:]:
                rows = rows.unionByName(run)
            self.n += 1
            merged = self.space.save(rows.groupBy("shard").applyInArrow(compact_shard, PIECE), f"run{self.n}")
            for _, name, _ in same:
                self.space.remove(name)
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, f"run{self.n}", merged)]


def substring_dedup(docs: DataFrame, width: int = 13, batches: int = 4, keep_text: bool = True, fanout: int = 2) -> DataFrame:
    """Each document without the words that a window of `width` words covers which also starts in a document of
    smaller doc_id. The table is a sequence of batches by doc_id, which are indexed one after the other.

    Null text: no words, and the hash of the empty string. Null doc_id: no document is smaller or larger; the row comes
    back whole. Rows that share a doc_id don't take words from each other. Extra columns are ignored."""
    spark = docs.sparkSession
    parts = parts_for(docs)
    shards, buckets = parts, prime_from(parts)
    docs = documents_of(docs)
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    space = Workspace(spark, "fingerprints")
    merge = merge_shard(buckets, fanout, tuple(sorted({int(c) for c in cuts})), keep=False)
    lost = space.save(docs.mapInArrow(pieces(width, shards, buckets), PIECE).groupBy("shard").applyInArrow(merge, PIECE), "lost")
    release(spark)
    return without(docs, lost, buckets, width, keep_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=13, keep_text=False)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, a, array_to_string(ws[a : a + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS a FROM d)),
f AS (SELECT win, min(doc_id) AS first_id FROM w GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(a, a + 13)) AS p FROM w JOIN f USING (win) WHERE doc_id > first_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
