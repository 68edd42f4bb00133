"""The main text of web pages, by a recurrent labeller of blocks.

A page is cut into its leaf blocks in order; a bidirectional LSTM, written in numpy, reads for each block the mean of
learned vectors of its tag path (tags, classes, ids) and of its hashed words with a few measures of form, and labels it
main text or not in view of the whole page. It is trained here, by numpy, on pages made by rule.

Scale: pages are read in Arrow batches, one pass without a shuffle; blocks of pages of like length are labelled together.
The model is trained once on the driver on a fixed number of pages and has a fixed size.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page and holds no tags.
HIDDEN = frozenset("script style title".split())
#: Elements that end when another of the kinds named opens.
ENDS = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PATHS, WORDS, PD, WD, NUM, H = 1024, 1024, 16, 8, 8, 24
STEPS = 4096


def slot(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, distinct tokens of the whole tag path, share of linked characters) of every leaf block with text, in page
    order."""
    out, stack, parts, within, opened = [], [], [], {}, Counter()
    linked = anchor = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, (*within, f"d{min(len(stack), 12)}"), min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def leave(tokens: list[str]) -> None:
        for t in tokens:
            within[t] -= 1
            if not within[t]:
                del within[t]

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            if anchor:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        if m[1] or m[4]:
            if opened[name]:
                if name in BLOCK:
                    flush()
                while True:
                    tag, tokens = stack.pop()
                    opened[tag] -= 1
                    leave(tokens)
                    anchor -= tag == "a"
                    if tag == name:
                        break
            elif name == "p":
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if name in HIDDEN and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else at if name == "title" else n
            continue
        if name in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if name in ENDS.get(stack[k][0], ()):
                    for tag, tokens in stack[k:]:
                        opened[tag] -= 1
                        leave(tokens)
                        anchor -= tag == "a"
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in ENDS:
                    break
        elif name in ("br", "img", "input"):
            parts.append(" ")
        if name not in VOID and not attributes.endswith("/"):
            tokens = [name] + [f".{w.lower()}" for g in NAMED.findall(attributes) for w in re.findall(r"[a-zA-Z]+", "".join(g))]
            stack.append((name, tokens))
            opened[name] += 1
            for t in tokens:
                within[t] = within.get(t, 0) + 1
            anchor += name == "a"
    flush()
    return out


def measures(text: str, share: float, k: int, n: int) -> list[float]:
    size = len(text)
    return [np.log1p(size) / 6, share, sum(text.count(c) for c in ".,;!?") / size * 10, sum(map(text.count, "0123456789")) / size * 4, k / n, (n - k) / n, min(1.0, text.count(" ") / 30), float(text[-1] in ".!?:")]


def encoded(found: list[tuple[str, tuple[str, ...], float]]):
    """Slots of path tokens and words with their blocks, and measures, of one page."""
    n = len(found)
    paths = [(k, slot(t, PATHS)) for k, (_, path, _) in enumerate(found) for t in path]
    words = [(k, slot(w, WORDS)) for k, (text, _, _) in enumerate(found) for w in set(text.lower().split())]
    return np.array(paths).reshape(-1, 2), np.array(words).reshape(-1, 2), np.array([measures(t, s, k, n) for k, (t, _, s) in enumerate(found)], np.float32).reshape(-1, NUM)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(pages, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """(pages, blocks, PD + WD + NUM) padded, and which are blocks."""
    longest = max(len(m) for _, _, m in pages)
    x, there = np.zeros((len(pages), longest, PD + WD + NUM), np.float32), np.zeros((len(pages), longest), bool)
    for i, (paths, words, m) in enumerate(pages):
        n = len(m)
        for pairs, vectors, a, d in ((paths, w["path"], 0, PD), (words, w["word"], PD, WD)):
            if len(pairs):
                count = np.maximum(np.bincount(pairs[:, 0], minlength=n), 1)[:, None]
                starts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
                x[i, pairs[starts, 0], a : a + d] = np.add.reduceat(vectors[pairs[:, 1]], starts) / count[pairs[starts, 0]]
        x[i, :n, PD + WD :] = m
        there[i, :n] = True
    return x, there


def lstm(x: np.ndarray, there: np.ndarray, u: np.ndarray, v: np.ndarray, b: np.ndarray, keep: bool = False):
    """States of one direction; where a row has no block, its state stays."""
    B, T, _ = x.shape
    h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
    out, held = np.zeros((B, T, H), np.float32), []
    for t in range(T):
        if t % STEPS == 0:  # a part of a long page at a time
            pre = x[:, t : t + STEPS] @ u + b
        z = pre[:, t % STEPS] + h @ v
        i, f, o = sigmoid(z[:, :H]), sigmoid(z[:, H : 2 * H]), sigmoid(z[:, 2 * H : 3 * H])
        g, on = np.tanh(z[:, 3 * H :]), there[:, t, None]
        c2 = np.where(on, f * c + i * g, c)
        h2 = np.where(on, o * np.tanh(c2), h)
        if keep:
            held.append((h, c, i, f, o, g, c2, on))
        h, c = h2, c2
        out[:, t] = h
    return out, held


def lstm_back(d_out: np.ndarray, x: np.ndarray, held: list, u: np.ndarray, v: np.ndarray):
    B, T, _ = x.shape
    dh, dc = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
    dz_all, dv = np.zeros((B, T, 4 * H), np.float32), np.zeros_like(v)
    for t in range(T - 1, -1, -1):
        h, c, i, f, o, g, c2, on = held[t]
        dh = dh + d_out[:, t]
        tc = np.tanh(c2)
        do, dc2 = dh * tc, dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g**2)], axis=1) * on
        dz_all[:, t] = dz
        dv += h.T @ dz
        dc = np.where(on, dc2 * f, dc)
        dh = np.where(on, dz @ v.T, dh)
    flat = dz_all.reshape(-1, 4 * H)
    return dz_all @ u.T, x.reshape(-1, x.shape[2]).T @ flat, dv, flat.sum(axis=0)


def reverse(a: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Each row's blocks from last to first, padding left at the end."""
    n = there.sum(axis=1)
    at = np.arange(a.shape[1])[None, :]
    at = np.where(at < n[:, None], n[:, None] - 1 - at, at)
    return a[np.arange(len(a))[:, None], at]


def forward(x: np.ndarray, there: np.ndarray, w: dict, keep: bool = False):
    one, held1 = lstm(x, there, w["u1"], w["v1"], w["b1"], keep)
    two, held2 = lstm(reverse(x, there), there, w["u2"], w["v2"], w["b2"], keep)
    both = np.concatenate([one, reverse(two, there), x], axis=2)
    return sigmoid(both @ w["out"] + w["bias"]), both, held1, held2


def training_pages(n: int = 480, seed: int = 6) -> list[tuple[str, list[str]]]:
    """Pages made by rule and their main blocks."""
    r = random.Random(seed)
    letters = "etaonrishdlucmfgwpyb"
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    words = lambda a, b: " ".join(r.choice(vocabulary) for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=40: words(a, b).capitalize() + r.choice((".", ".", ".", "", "!", "?"))
    link = lambda: f'<a href="/{r.choice(vocabulary)}">{r.choice((words, sentence))(1, 3)}</a>'
    name = lambda *c: r.choice(c)
    out = []
    for _ in range(n):
        main: list[str] = []

        def content(tag: str, text: str, main=main) -> str:
            main.append(text)
            return f"<{tag}>{text}</{tag}>"

        def noise() -> str:
            return r.choice((
                lambda: f'<div class="{name("ad", "ads", "advert", "banner", "promo", "sponsored")}">{sentence()}</div>',
                lambda: f'<aside class="{name("sidebar", "related", "widget", "")}"><h3>{words(1, 4)}</h3><ul>{"".join(f"<li>{link()}</li>" for _ in range(r.randint(1, 6)))}</ul><p>{sentence()}</p></aside>',
                lambda: f'<div id="{name("cookie", "consent", "notice", "alert", "newsletter", "popup")}"><p>{sentence()}</p><button>{words(1, 2)}</button></div>',
                lambda: f'<form action="/s"><label>{words(1, 3)}</label><input type="text"><select><option>{words(1, 1)}</option></select><button>{words(1, 2)}</button></form>',
                lambda: f'<div class="{name("share", "social", "breadcrumb", "tags", "meta", "byline", "pager")}">{" ".join(link() for _ in range(r.randint(1, 5)))} {words(0, 4)}</div>',
                lambda: f'<section class="{name("sidebar", "related", "recommended")}"><p>{sentence()}</p>{link()}</section>',
            ))()

        def comments() -> str:
            body = "".join(f'<{t} class="comment"><span class="author">{words(1, 2)}</span><p>{sentence()}</p></{t}>' for t in [name("div", "li", "article")] for _ in range(r.randint(1, 4)))
            return f'<{(t := name("section", "div"))} {name("class", "id")}="{name("comments", "discussion", "responses", "comment-list")}"><h3>{words(1, 3)}</h3>{body}</{t}>'

        def article() -> str:
            parts = [content(name("h1", "h1", "h2"), words(3, 14))] if r.random() < 0.9 else []
            for _ in range(r.randint(1, 9)):
                k = r.random()
                if k < 0.6:
                    parts.append(content("p", sentence(1, 60)))
                elif k < 0.72:
                    text = sentence(1, 40)
                    main.append(text)
                    parts.append(f"<p>{name('<b>', '<i>', '')}{text}<br>" if r.random() < 0.5 else f"<p>{text}")
                elif k < 0.78:
                    parts.append(content(name("h2", "h3"), words(1, 8)))
                elif k < 0.84:
                    parts.append(f"<ul>{''.join(content('li', sentence(1, 12)) for _ in range(r.randint(1, 5)))}</ul>")
                elif k < 0.88:
                    parts.append(f"<table>{''.join('<tr>' + content('td', words(1, 3)) + content('td', words(1, 3)) + '</tr>' for _ in range(r.randint(1, 3)))}</table>")
                elif k < 0.92:
                    parts.append(f"<blockquote>{content('p', sentence())}</blockquote>")
                elif k < 0.95:
                    parts.append(content("pre", words(2, 20)))
                else:
                    parts.append(noise())
            return "".join(parts)

        nav = lambda: f'<{(t := name("nav", "nav", "div"))}{name("", " class=menu", " id=nav") if t == "nav" else name(" class=menu", " id=navigation", " class=navbar")}><ul>{"".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))}</ul></{t}>'
        head = f'<header>{name("", f"<h1>{words(1, 4)}</h1>", f"<p>{sentence(2, 8)}</p>", f"<div>{link()}</div>")}</header>' if r.random() < 0.5 else ""
        foot = f'<{(t := name("footer", "footer", "div id=footer"))}>{name("&copy; ", "")}{words(1, 12)}{name("", " " + link(), f"<p>{sentence()}</p>")}</{t.split()[0]}>'
        opening, closing = r.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post-body entry">', "</div>"), ("<main><article>", "</article></main>"), ('<div class="article-text">', "</div>")))
        body = head + nav() + (noise() if r.random() < 0.7 else "") + opening + article() + closing + (comments() if r.random() < 0.4 else "") + (noise() if r.random() < 0.4 else "") + (foot if r.random() < 0.9 else "")
        out.append((f"<html><head><title>{words(1, 5)}</title></head><body>{body}" + "</body></html>" * (r.random() < 0.8), main))
    return out


@cache
def model(rounds: int = 20, rate: float = 0.01, seed: int = 7) -> dict:
    """The labeller's weights, by back-propagation through time with Adam steps; the same on every run."""
    r = np.random.default_rng(seed)
    D = PD + WD + NUM
    init = lambda *shape: r.normal(0, 0.15, shape).astype(np.float32)
    w = {"path": init(PATHS, PD), "word": init(WORDS, WD) * 0.1, "u1": init(D, 4 * H), "v1": init(H, 4 * H), "b1": np.zeros(4 * H, np.float32), "u2": init(D, 4 * H), "v2": init(H, 4 * H), "b2": np.zeros(4 * H, np.float32), "out": init(2 * H + D), "bias": np.zeros(1, np.float32)}
    data = []
    for page, main in training_pages():
        found, left, y = blocks(page), list(main), []
        for text, _, _ in found:
            ok = text in left
            y.append(float(ok))
            if ok:
                left.remove(text)
        if found:
            data.append((encoded(found), np.array(y, np.float32)))
    data.sort(key=lambda d: len(d[1]))
    groups = [data[a : a + 24] for a in range(0, len(data), 24)]
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(rounds):
        for k in r.permutation(len(groups)):
            pages, ys = zip(*groups[k], strict=True)
            x, there = inputs(pages, w)
            y = np.zeros(there.shape, np.float32)
            for i, v in enumerate(ys):
                y[i, : len(v)] = v
            p, both, held1, held2 = forward(x, there, w, keep=True)
            miss = (p - y) * there / there.sum()
            d_both = miss[:, :, None] * w["out"]
            dx1, du1, dv1, db1 = lstm_back(d_both[:, :, :H], x, held1, w["u1"], w["v1"])
            dx2, du2, dv2, db2 = lstm_back(reverse(d_both[:, :, H : 2 * H], there), reverse(x, there), held2, w["u2"], w["v2"])
            dx = dx1 + reverse(dx2, there) + d_both[:, :, 2 * H :]
            grad = {"u1": du1, "v1": dv1, "b1": db1, "u2": du2, "v2": dv2, "b2": db2, "out": both.reshape(-1, both.shape[2]).T @ miss.reshape(-1), "bias": miss.sum(keepdims=True).reshape(1)}
            grad["path"], grad["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
            for i, (paths, words, m) in enumerate(pages):
                for pairs, key, a, d in ((paths, "path", 0, PD), (words, "word", PD, WD)):
                    if len(pairs):
                        share = 1 / np.maximum(np.bincount(pairs[:, 0], minlength=len(m)), 1)
                        np.add.at(grad[key], pairs[:, 1], dx[i, pairs[:, 0], a : a + d] * share[pairs[:, 0], None])
            step += 1
            for key, g in grad.items():
                first[key] += 0.1 * (g - first[key])
                second[key] += 0.01 * (g * g - second[key])
                w[key] -= (rate * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def labelled(pages: list[str], w: dict) -> list[list[tuple[str, float]]]:
    """(text, probability of main text) of every block of every page."""
    found = [blocks(p) if p else [] for p in pages]
    out: list[list[tuple[str, float]]] = [[] for _ in pages]
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 128 and (b - a + 1) * len(found[order[b]]) <= 20_000:
            b += 1
        some = order[a:b]
        p = forward(*inputs([encoded(found[k]) for k in some], w), w)[0]
        for i, k in enumerate(some):
            out[k] = [(t, float(p[i, j])) for j, (t, _, _) in enumerate(found[k])]
        a = b
    return out


def extracted(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null or empty html, and pages without main blocks: empty text. Null ids
    and urls and repeated rows come back as they are. Extra columns are ignored."""
    w = model()

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                texts = ["\n".join(t for t, p in page if p >= threshold) for page in labelled(part.column(2).to_pylist(), w)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
