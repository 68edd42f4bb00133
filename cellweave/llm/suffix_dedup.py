"""Removal of repeated byte strings, by suffix arrays that are built by two-stage sorting.

A suffix array sorts those suffixes directly that are smaller than their successors, and induces the rest by one scan
over the buckets of first bytes; adjacent common prefixes then give the groups of equal strings of `length` bytes.

Scale: suffixes of 100 TB can't be sorted in one place, so strings are dealt by content. Of each string of 100 bytes the
50-gram of least hash (leftmost if tied) is its anchor; equal strings have equal anchors. Strings in a row that share an
anchor's position form a stretch, whose bytes travel once. Only anchors that occur twice or more anywhere lead to
stretches, equal stretches of a task are merged before the shuffle (the later ones are lost for certain), and each shard
of anchors builds suffix arrays over blocks of whole anchors. A third of all documents being copies of one costs a
shard one stretch a task. Shards and buckets grow with the input.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace, chunks, documents_of, get_ints, get_sorted, joined, mix, parts_for, prime_from, put_ints, put_sorted, random_words, release, slices, table
from .substring_dedup import whole_rows

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
FOUND = "shard int, kind int, codes binary, docs binary"
STRETCH = "shard int, kind int, codes binary, docs binary, vers binary, starts binary, sizes binary, bytes binary"
SEEN, KNOWN, LOST = 1, 2, 3
BLOCK = 2 << 20
GAP = 0xFF  # never in UTF-8

_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        r = int(random_words(404, 1, True)[0])
        with np.errstate(over="ignore"):
            _powers["up"] = np.multiply.accumulate(np.full(n, r, U64))
            _powers["down"] = np.multiply.accumulate(np.full(n, pow(r, -1, 1 << 64), U64))
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` bytes in a row."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = power_tables(len(buf))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(random_words(405, 256)[buf] * up, out=total[1:])
        return mix((total[size:] - total[:-size]) * down[:n])


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text's number, first start, starts in a row, code) of all stretches."""
    size = length // 2
    buf, at, lengths = joined(texts, b"\xff")
    h = gram_hashes(buf, size)
    n = len(buf) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    # the least hash, then the leftmost place, as one number; 28 bits of place
    key = (h & ~U64((1 << 28) - 1)) | np.arange(len(h), dtype=U64)
    over, span = length - size + 1, 1
    low = key
    while span * 2 <= over:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < over:
        low = np.minimum(low[: n], low[over - span : over - span + n])
    place = (low[:n] & U64((1 << 28) - 1)).astype(np.int64)
    start = np.arange(n)
    owner = np.searchsorted(at, start, "right") - 1
    good = start + length <= at[owner] + lengths[owner]
    start, place, owner = start[good], place[good], owner[good]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[new], start[new] - at[owner[new]], np.diff(np.append(new, len(start))), h[place[new]]


def record(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
    names = [x.split()[0] for x in names.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)


def cut(group: np.ndarray):
    """(value, slice of the order) of each group; the order comes first."""
    order = np.argsort(group, kind="stable")
    held = group[order]
    edges = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1], [True]))) if len(held) else np.zeros(1, int)
    return order, [(int(held[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def known_by_bucket(code: np.ndarray, doc: np.ndarray, buckets: int, shards: int):
    order, groups = cut(doc % buckets)
    code, doc = code[order], doc[order]
    return [(b % shards, KNOWN, code[s].astype("<u8").tobytes(), put_ints(doc[s])) for b, s in groups]


def shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    return (code % U64(shards)).astype(np.int64)


def anchors(length: int, shards: int, buckets: int, most: int = 1_500_000):
    """Each anchor code of a piece once for its shard, with its document or -1 if it occurs again in the piece; what
    occurs again is known to repeat and goes to the documents' buckets."""

    def flush(codes, docs):
        code, doc = np.concatenate(codes), np.concatenate(docs)
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        first = np.concatenate(([True], code[1:] != code[:-1]))
        many = np.bincount(np.cumsum(first) - 1) > 1
        again = many[np.cumsum(first) - 1]
        pair = np.unique(np.stack([code[again], doc[again].view(U64)]), axis=1) if again.any() else np.zeros((2, 0), U64)
        out = known_by_bucket(pair[0], pair[1].view(np.int64), buckets, shards)
        code, doc = code[first], np.where(many, -1, doc[first])
        order, groups = cut(shard_of(code, shards))
        code, doc = code[order], doc[order]
        return record(out + [(s, SEEN, put_sorted(code[x]), put_ints(doc[x])) for s, x in groups], FOUND)

    most = max(most, 4 * shards)  # a piece should have some anchors for each shard

    def run(batches):
        codes, docs, held = [], [], 0
        for ids, texts in chunks(batches):
            own = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None and len(t) >= length]
            owner, _, _, code = stretches([t for _, t in own], length)
            if len(code):
                codes.append(code)
                docs.append(np.array([i for i, _ in own], np.int64)[owner])
                held += len(code)
            if held >= most:
                yield flush(codes, docs)
                codes, docs, held = [], [], 0
        if held:
            yield flush(codes, docs)

    return run


def repeated(shards: int, buckets: int):
    """Of a shard's codes those that several pieces have, or one has again, for the documents' buckets."""

    def run(key, t):
        kinds, codes, docs = (t.column(c).to_pylist() for c in ("kind", "codes", "docs"))
        out = [(int(get_ints(d)[0] % buckets), KNOWN, c, d) for k, c, d in zip(kinds, codes, docs, strict=True) if k == KNOWN]
        seen = [(get_sorted(c), get_ints(d)) for k, c, d in zip(kinds, codes, docs, strict=True) if k == SEEN]
        if seen:
            code, doc = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order]
            same = code[1:] == code[:-1]
            keep = (np.append(same, False) | np.insert(same, 0, False)) & (doc >= 0)
            order, groups = cut(doc[keep] % buckets)
            code, doc = code[keep][order], doc[keep][order]
            out += [(b, KNOWN, code[s].astype("<u8").tobytes(), put_ints(doc[s])) for b, s in groups]
        return pa.Table.from_batches([record(out, FOUND)])

    return run


def pairs_of(codes: list[bytes], docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    code, doc = np.concatenate([np.frombuffer(c, "<u8") for c in codes]), np.concatenate([get_ints(d) for d in docs])
    order = np.argsort(doc, kind="stable")
    return code[order], doc[order]


def lost_rows(doc, ver, start, count, buckets: int, shards: int | None = None):
    """Rows of lost starts, dealt by bucket (for a shard's task to pass on, if shards is given)."""
    order, groups = cut(doc % buckets)
    doc, ver, start, count = doc[order], ver[order], start[order], count[order]
    return [(b if shards is None else b % shards, LOST, b"", put_ints(doc[s]), put_ints(ver[s]), put_ints(start[s]), put_ints(count[s]), b"") for b, s in groups]


def cut_stretches(length: int, shards: int, buckets: int):
    """The stretches of a bucket's documents whose anchors repeat. Of equal ones the earliest goes to its shard."""

    def run(key, docs, known):
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        code, doc = pairs_of(known.column("codes").to_pylist(), known.column("docs").to_pylist())
        own = [(i, t, zlib.crc32(t)) for i, t in zip(ids, texts, strict=True) if i is not None and t and len(t) >= length]
        own = sorted({(i, v): (i, t, v) for i, t, v in own}.values(), key=lambda x: (x[0], x[2]))  # rows that repeat need one pass
        first: dict[bytes, tuple] = {}
        lost = []
        for part in slices([t for _, t, _ in own]):
            some = own[part]
            owner, start, count, codes = stretches([t for _, t, _ in some], length)
            edges = np.searchsorted(owner, np.arange(len(some) + 1))
            for k, (i, text, ver) in enumerate(some):
                x, y = np.searchsorted(doc, [i, i + 1])
                e = slice(edges[k], edges[k + 1])
                if x == y or e.start == e.stop:
                    continue
                for s in e.start + np.flatnonzero(np.isin(codes[e], code[x:y])):
                    s0, c = int(start[s]), int(count[s])
                    piece = text[s0 : s0 + c + length - 1]
                    held = first.get(piece)
                    if held is None:
                        first[piece] = (i, ver, s0, c, int(codes[s]))
                    elif held[0] < i or held[:2] == (i, ver):
                        lost.append((i, ver, s0, c))
                    else:  # another row of the same doc_id
                        first[piece + b"\xff" + b"%d" % len(first)] = (i, ver, s0, c, int(codes[s]))
        out = []
        if lost:
            out += lost_rows(*(np.array(x, np.int64) for x in zip(*lost, strict=True)), buckets, shards)
        if first:
            i, v, s0, c, h = zip(*first.values(), strict=True)
            i, v, s0, c, h = (np.array(i, np.int64), np.array(v, np.int64), np.array(s0, np.int64), np.array(c, np.int64), np.array(h, U64))
            strings = list(first)
            order, groups = cut(shard_of(h, shards))
            for s, x in groups:
                o = order[x]
                text = b"".join(strings[k][: int(c[k]) + length - 1] for k in o.tolist())
                out.append((s, SEEN, h[o].astype("<u8").tobytes(), put_ints(i[o]), put_ints(v[o]), put_ints(s0[o]), put_ints(c[o]), zstandard.compress(text, 3)))
        return pa.Table.from_batches([record(out, STRETCH)])

    return run


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts as they do."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(n, U64)
    for k in range(8):
        out = (out << U64(8)) | padded[k : n + k].astype(U64)
    return out


def sort_direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` bytes from each on; beyond that, ties stay in any order."""
    last = len(words) - 1
    order = at[np.argsort(words[at], kind="stable")]
    group = np.cumsum(np.concatenate(([0], words[order][1:] != words[order][:-1]))) if len(order) else order
    for d in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        here = np.flatnonzero(tied)
        if not len(here):
            break
        w, g = words[np.minimum(order[here] + d, last)], group[here]
        by = np.lexsort((w, g))
        order[here] = order[here][by]
        w = w[by]
        split = np.concatenate(([False], (g[1:] == g[:-1]) & (w[1:] != w[:-1])))
        step = np.zeros(len(order), np.int64)
        step[here] = split
        group = group + np.cumsum(step)
    return order


def suffix_array(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int, words: np.ndarray) -> np.ndarray:
    """The suffixes that begin one of the first `counts` places of the strings at `starts` (each ended by GAP), sorted
    by their first `length` bytes. Two stages: suffixes smaller than their successors are sorted directly; the rest,
    in the buckets of their first bytes, follow from one scan of the buckets in order."""
    n = len(text)
    after = np.append(text[1:], GAP)
    change = np.where(text != after, np.arange(n), n)
    change = np.minimum(np.minimum.accumulate(change[::-1])[::-1], n - 1)
    direct = text[change] < after[change]
    until = np.minimum.accumulate(np.where(direct, np.arange(n), n - 1)[::-1])[::-1]
    used, wanted = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.add.at(used, starts, 1)
    np.add.at(used, until[starts + counts - 1] + 1, -1)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, starts + counts, -1)
    used, wanted = np.cumsum(used[:-1]) > 0, np.cumsum(wanted[:-1]) > 0
    head = np.zeros(n, bool)
    head[starts] = True
    induced = used & ~direct
    sorted_ones = sort_direct(np.flatnonzero(used & direct), words, length + 8)
    first = text[sorted_ones]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part, front = [], np.concatenate(waiting[c]) if waiting[c] else None
        while front is not None and len(front):
            part.append(front)
            before = front[~head[front]] - 1
            front = before[induced[before] & (text[before] == c)]
        part.append(sorted_ones[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(part)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[~head[whole]] - 1
        before = before[induced[before] & (text[before] > c)]
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        to = text[before]
        for e in np.unique(to).tolist():
            waiting[e].append(before[np.searchsorted(to, e) : np.searchsorted(to, e, "right")])
    whole = np.concatenate(out) if out else np.zeros(0, np.int64)
    return whole[wanted[whole]]


def common_prefix(sa: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has its first `length` bytes in common with the one before it."""
    last = len(words) - 1
    same = np.ones(len(sa), bool)
    same[:1] = False
    for d in range(0, length, 8):
        here = np.flatnonzero(same)
        spare = U64(max(0, 8 - (length - d)) * 8)
        x, y = words[np.minimum(sa[here] + d, last)], words[np.minimum(sa[here - 1] + d, last)]
        same[here] = (x >> spare) == (y >> spare)
    return same


def lost_in_block(strings: list[bytes], doc, ver, start, count, length: int):
    """(string's number, first offset, offsets in a row) of places whose string also starts earlier."""
    text, at, _ = joined(strings, bytes([GAP]))
    words = eights(text)
    sa = suffix_array(text, at, count, length, words)
    group = np.cumsum(~common_prefix(sa, words, length)) - 1
    own = np.searchsorted(at, sa, "right") - 1
    where = start[own] + sa - at[own]
    order = np.lexsort((where, ver[own], doc[own], group))
    group, own, off = group[order], own[order], (sa - at[own])[order]
    first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    least = doc[own][first][np.cumsum(first) - 1] if len(group) else doc[:0]
    gone = doc[own] > least
    gone[1:] |= ~first[1:] & (doc[own][1:] == doc[own][:-1]) & (ver[own][1:] == ver[own][:-1])
    own, off = own[gone], off[gone]
    order = np.lexsort((off, own))
    own, off = own[order], off[order]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)))) if len(own) else np.zeros(0, int)
    return own[new], off[new], np.diff(np.append(new, len(own)))


def lost_starts(length: int, buckets: int):
    """What a shard's stretches lose: equal ones but the earliest, whole; of the rest, what suffix arrays show."""

    def run(key, t):
        names = ("kind", "codes", "docs", "vers", "starts", "sizes", "bytes")
        rows = list(zip(*(t.column(c).to_pylist() for c in names), strict=True))
        out, strings, parts = [], [], []
        for kind, code, doc, ver, start, size, text in rows:
            doc = get_ints(doc)
            if kind == LOST:
                out.append((int(doc[0] % buckets), LOST, b"", *(put_ints(x) for x in (doc, get_ints(ver), get_ints(start), get_ints(size))), b""))
                continue
            size, text = get_ints(size), zstandard.decompress(text)
            ends = np.cumsum(size + length - 1).tolist()
            strings += [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            parts.append((np.frombuffer(code, "<u8"), doc, get_ints(ver), get_ints(start), size))
        if parts:
            code, doc, ver, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, ver, doc, code)).tolist()
            held: dict[bytes, int] = {}
            keep, gone = [], []
            for k in order:
                f = held.setdefault(strings[k], k)
                if f != k and (doc[f] < doc[k] or (doc[f] == doc[k] and ver[f] == ver[k])):
                    gone.append(k)
                else:
                    keep.append(k)
            lost = [(doc[gone], ver[gone], start[gone], size[gone])]
            a, held_bytes = 0, 0
            for b in range(len(keep) + 1):
                if b < len(keep) and (held_bytes < BLOCK or code[keep[b]] == code[keep[b - 1]]):
                    held_bytes += len(strings[keep[b]])
                    continue
                k = np.array(keep[a:b], np.int64)
                if len(k):
                    own, off, n = lost_in_block([strings[x] for x in k.tolist()], doc[k], ver[k], start[k], size[k], length)
                    lost.append((doc[k][own], ver[k][own], start[k][own] + off, n))
                a, held_bytes = b, len(strings[keep[b]]) if b < len(keep) else 0
            doc, ver, start, size = (np.concatenate(x) for x in zip(*lost, strict=True))
            if len(doc):
                out += lost_rows(doc, ver, start, size, buckets)
        return pa.Table.from_batches([record(out, STRETCH)])

    return run


def remove_bytes(length: int):
    """A bucket's documents without the bytes that lost strings cover."""

    def run(key, docs, lost):
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
        cols = [[get_ints(x) for x in lost.column(c).to_pylist()] for c in ("docs", "vers", "starts", "sizes")]
        doc, ver, start, size = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        order = np.argsort(doc, kind="stable")
        doc, ver, start, size = doc[order], ver[order], start[order], size[order]
        rows = []
        for i, text in zip(ids, texts, strict=True):
            text = text or b""
            x, y = np.searchsorted(doc, [i, i + 1]) if i is not None else (0, 0)
            own = slice(x, y)
            mine = ver[own] == zlib.crc32(text) if y > x else np.zeros(0, bool)
            if not mine.any():
                rows.append((i, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                continue
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, start[own][mine], 1)
            np.add.at(edge, start[own][mine] + size[own][mine] + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((i, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, keep_text: bool = True) -> DataFrame:
    """Each document's UTF-8 bytes without those that a string of `length` bytes covers which also starts earlier, in a
    document of smaller doc_id or further left in the same one. kept may split characters, so it is binary.

    Null text: empty. Null doc_id: the row comes back whole and takes nothing from others. Rows that share a doc_id
    take nothing from each other; equal ones come back equal. Extra columns are ignored."""
    space = Workspace(docs.sparkSession, "suffixes")
    docs = documents_of(docs)
    parts = parts_for(docs)
    shards, buckets = parts, prime_from(parts)
    dealt = docs.filter("doc_id IS NOT NULL").select("*", F.pmod("doc_id", F.lit(buckets)).cast("int").alias("bucket"))

    def known(rows):
        return rows.withColumnRenamed("shard", "bucket").groupBy("bucket")

    found = docs.mapInArrow(anchors(length, shards, buckets), FOUND).groupBy("shard").applyInArrow(repeated(shards, buckets), FOUND)
    cuts = dealt.groupBy("bucket").cogroup(known(found)).applyInArrow(cut_stretches(length, shards, buckets), STRETCH)
    lost = space.save(cuts.groupBy("shard").applyInArrow(lost_starts(length, buckets), STRETCH), "lost")
    del found, cuts
    release(docs.sparkSession)
    out = dealt.groupBy("bucket").cogroup(known(lost)).applyInArrow(remove_bytes(length), RESULT)
    out = out.unionByName(docs.filter("doc_id IS NULL").mapInArrow(whole_rows(remove_bytes(length), ("docs", "vers", "starts", "sizes")), RESULT))
    return out if keep_text else out.drop("kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=100, keep_text=False)
