"""Operators with exact contracts against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from cellweave.llm import decontaminate, packing, pii, simhash, substring_dedup, suffix_dedup, syncmers


def test_window_dedup(corpus, frame):
    for width, batches in ((13, 3), (3, 1)):
        seen, expected = {}, {}
        for i, t in corpus:
            w = t.encode().split()
            gone = [False] * len(w)
            for a in range(len(w) - width + 1):
                k = tuple(w[a : a + width])
                if seen.setdefault(k, i) < i:
                    gone[a : a + width] = [True] * width
            kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
            expected[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(frame(corpus), width, batches).collect()}
        assert got == expected
    assert sum(v[1] for v in expected.values()) > 50


def test_index_is_incremental(spark, corpus, frame):
    """Batches of an index give what one pass gives, also after compaction."""
    one = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(frame(corpus), 5, 1).collect()}
    index, got = substring_dedup.FingerprintIndex(spark, 3, 5, width=5, fanout=2), {}
    for a in range(0, len(corpus), 9):
        got |= {r.doc_id: r.kept_sha256 for r in index.ingest(frame(corpus[a : a + 9])).collect()}
    assert got == one
    assert len(index.runs) < len(range(0, len(corpus), 9))


def brute_suffix(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            k = b[a : a + length]
            if k in seen:
                gone[a : a + length] = b"\x01" * length
            seen.add(k)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(gone[x] and (x == 0 or not gone[x - 1]) for x in range(len(b)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [100, 20])
def test_suffix_dedup(corpus, frame, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(corpus), length).collect()}
    assert got == brute_suffix(corpus, length)


def test_suffix_array_sorts():
    r = random.Random(3)
    for _ in range(30):
        strings = [bytes(r.choice(b"ab" if r.random() < 0.8 else b"abc") for _ in range(r.randint(12, 60))) for _ in range(r.randint(1, 8))]
        length = 12
        text, at, _ = suffix_dedup.joined(strings, b"\xff")
        count = np.array([len(s) - length + 1 for s in strings])
        words = suffix_dedup.eights(text)
        sa = suffix_dedup.suffix_array(text, at, count, length, words)
        wanted = [int(a) + k for a, n in zip(at, count, strict=True) for k in range(n)]
        heads = [text[p : p + length].tobytes() for p in sa]
        assert sorted(sa.tolist()) == wanted and heads == sorted(heads)
        same = suffix_dedup.common_prefix(sa, words, length)
        assert same.tolist() == [k > 0 and heads[k] == heads[k - 1] for k in range(len(heads))]


def test_simhash(corpus, frame):
    import xxhash

    fps = {}
    for i, t in corpus:
        w = t.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[a : a + 4]), 42) for a in range(max(1, len(w) - 3))] if w else []
        fps[i] = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))
    ids, comp = list(fps), {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(corpus)).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in ids}
    assert len(set(comp.values())) < len(ids)


def test_crowded_buckets_keep_components(monkeypatch):
    """Buckets of thousands connect what all pairs would connect."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    center = r.integers(0, 1 << 64, 3, dtype=np.uint64)
    fps = np.unique(np.array([center[k % 3] ^ np.uint64(sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 6)))) for k in range(900)], np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    i, j = np.nonzero(np.triu(near, 1))
    expected = simhash.roots(len(fps), i, j)
    monkeypatch.setattr(simhash, "HOT", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fps), np.int64)), pa.array(fps.view(np.int64))], names=["key", "fp"])
    label = {int(f): int(f) for f in fps}
    for out in simhash.star_links(4, 24)(iter([batch])):
        for a, b in zip(out.column(0).to_numpy().view(np.uint64), out.column(1).to_numpy().view(np.uint64), strict=True):
            label[int(a)] = int(b)
    assert [label[int(f)] for f in fps] == [int(fps[k]) for k in expected]


def test_decontamination(spark, corpus, frame):
    items = [(1, " ".join(corpus[0][1].split()[2:20])), (2, "A B C"), (3, corpus[37][1]), (3, corpus[37][1]), (4, None), (5, "!!"), (None, "a b c"), (6, "zz yy xx ww vv uu tt ss rr qq pp")]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    expected = {}
    for i, t in corpus:
        w, hit, names = cut(t), set(), set()
        for item, s in items:
            v = cut(s)
            n = min(10, len(v))
            wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n and item is not None else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    names.add(str(item))
        expected[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(frame(corpus), df).collect()}
    assert got == expected
    assert sum(v[4] for v in expected.values()) >= 4
    kept = {r.doc_id for r in decontaminate.clean(frame(corpus), df).collect()}
    assert kept == {i for i, v in expected.items() if not v[4]}
    assert "mapInArrow" not in decontaminate.contamination(frame(corpus), df)._jdf.queryExecution().toString()


def test_packing(corpus, frame):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in corpus}
    rows = packing.packed(frame(corpus), 64, with_ids=True).collect()
    spot = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == own
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        for k in range(r.length):
            assert spot.setdefault((r.doc_id, r.start + k), r.sequence_id) == r.sequence_id
    assert len(spot) == sum(map(len, ids.values()))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_words_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    r = random.Random(2)
    t, e = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    alphabet = "aBcÉéßİΣσς .,,..\n\t　'sdon't1½²①<|endoftext|> <|ENDOFTEXT|>é中文ـ٣-_!?$%‍😀"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["", "a<|endoftext|>b"]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_cutting_stock_is_tight():
    r = np.random.default_rng(0)
    sizes = np.arange(1, 41)
    demand = r.integers(1, 60, 40)
    plan = packing.cutting_stock(sizes, demand, 64)
    made = sum((p * n for p, n in plan), np.zeros(40, np.int64))
    assert (made == demand).all() and all((p * sizes).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= np.ceil((sizes * demand).sum() / 64) * 1.02 + 1


KINDS = ("email", "ip", "card", "phone")
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_spans(frame, corpus):
    r = random.Random(9)
    alphabet = ["a", "B", "9", "1", "25", "255", "256", ".", ".", "@", "@", "-", " ", "+", "%", "(", ")", "é", "😀", "4111111111111111", "4111 1111 1111 1111", "+1 555 010 0199", "x@y.z", "1.2.3.4", "\n"]
    rows = [(k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))) for k in range(600)] + [(1000 + i, t) for i, t in corpus] + [(9000, "1" * 30000), (9001, "a" * 30000 + "@")]
    got = {x.doc_id: x for x in pii.detected(frame(rows)).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest(), t[:200]
        assert set(filter(None, base(t).split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [base(t).count(f"{k}:") for k in KINDS]


def plain_features(text: str, s: int, k: int, e: int) -> list[float]:
    t, before, after = text[s:e], text[max(s - 24, 0) : s], text[e : e + 12]
    count = lambda p: len(re.findall(p, t))
    flag = lambda p, at: float(bool(re.search(p, at)))
    d = [int(c) for c in re.sub("[^0-9]", "", t)][::-1]
    passes = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0
    out = [k, len(t), count("[0-9]"), count(" "), count("-"), count(r"\."), count(r"[()\[\]{}]"), count(":"), flag(r"^\(", t), flag("^(19|20)[0-9]{2}[ .-]", t), float(passes and len(t) <= 64), flag(r"^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$", t), flag(r"(?i)[\[({](at|dot)[\])}]", t), flag("(?i) dot ", t), flag("[A-Fa-f]", t)]
    out += [count("[A-Z]") / len(t), count("[0-9]") / len(t), count("[G-Zg-z]") / len(t), count("[+/_=-]"), flag("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$", t)]
    out += [flag(c, before) for c in pii.CUES]
    return out + [flag(r"[0-9$\u20ac\u00a3%/]\s*$", before), flag(r"^\s*[0-9%\u20ac\u00a3/]", after), flag(r"[:=]\s*[\"']?$", before), flag("[\"']$", before), flag("^[\"']", after), flag("[/.@]$", before), flag(r"^\.[A-Za-z0-9]", after)]


def plain_spans(text: str, trees, cuts) -> str:
    """All spans by loops over all candidates and all pairs of them."""
    held = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base(text).split(",") if x)]
    over = lambda x, y: x[0] < y[2] and y[0] < x[2]
    found = [(m.start(), k, m.end()) for k, kind in enumerate(pii.EVERY) for m in re.finditer(pii.MORE[kind], text)]
    found = [x for x in found if x[1] < 4 or (re.search("[0-9]", text[x[0] : x[2]]) and re.search("[A-Za-z]", text[x[0] : x[2]]))]
    found = [x for x in found if not any(over(x, y) for y in held)]
    score = {x: sum(float(pii.leaves(t, np.array([plain_features(text, *x)]))[0]) for t in trees) for x in found}
    good = [x for x in found if 1 / (1 + np.exp(-score[x])) >= cuts[x[1]]]
    kept = [x for x in good if not any(over(x, y) and (-score[y], y[:2]) < (-score[x], x[:2]) for y in good)]
    return ",".join(f"{pii.EVERY[k]}:{a}:{b}" for a, k, b in sorted(held + kept))


def test_pii_spans_by_brute_force(spark, frame):
    trees, cuts = pii.model(spark)
    assert len(set(cuts)) > 2
    r = random.Random(3)
    made = pii.examples(500, seed=77)
    texts = [t for t, _ in made] + [" ".join(r.choice(made)[0] for _ in range(r.randint(2, 60))) for _ in range(60)]
    texts += ["Mail \u00e9 a.b@c.example.com or 555-010-0199-2222 1234 5678 9012 3456 7890abcdefghijkl", "token = 1234-5678-9012-3456-aa x@y.z 1.2.3.4", "\U0001f600 key: '0a1b2c3d4e5f60718293' " * 300]
    got = {x.doc_id: x for x in pii.detected(frame(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i].spans == plain_spans(t, trees, cuts), t[:300]
        assert got[i].n_secret == got[i].spans.count("secret:")


def test_pii_redacted(spark, frame):
    r = random.Random(5)
    made = pii.examples(300, seed=79)
    texts = ["Mail \u00e9 a.b@c.example.com, 10.0.0.1.", 'token = "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c"', "+1 555 010 01994111111111111111 and 4111 1111 1111 1111+49 30 1234567", "plain"]
    texts += [" ".join(r.choice(made)[0] for _ in range(r.randint(2, 400))) for _ in range(20)]
    df = frame([*enumerate(texts), (99, None)])
    spans = {x.doc_id: x.spans for x in pii.detected(df).collect()}
    out = {x.doc_id: x for x in pii.redacted(df).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        groups = []
        for k, a, b in (x.split(":") for x in spans[i].split(",") if x):
            if groups and int(a) < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], int(b))
            else:
                groups.append([int(a), int(b), k])
        for a, b, k in groups:
            want, at = want + t[at:a] + f"[{k.upper()}]", b
        assert out[i].text == want + t[at:]
    assert out[0].text == "Mail \u00e9 [EMAIL], [IP]." and out[1].text == 'token = "[SECRET]"' and out[99].text is None and out[3].text == "plain"
    assert out[0].base_spans == "x16"


def test_syncmers(corpus, frame):
    got = {r.doc_id: r for r in syncmers.fingerprinted(frame(corpus)).collect()}
    down = corpus[::-1]
    for k, (i, t) in enumerate(down):
        n, nxt = len(t) // 3, down[(k + 1) % len(down)][1]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by = dict(corpus)
    for a in by:
        for b in by:
            assert by[a] != by[b] or got[a].fingerprint == got[b].fingerprint
    long = [i for i, t in corpus if len(t) > 300 and " " in t and i < 90]
    assert min(got[i].near_edited for i in long) > 0.35
    assert max(got[i].near_next for i in long if by[i] != by.get(i - 3) and i > 0) < 0.35
    assert "Python" not in syncmers.fingerprinted(frame(corpus))._jdf.queryExecution().executedPlan().toString()
