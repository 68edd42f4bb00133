"""Personal data in texts, by gradient boosting over candidate spans.

Base patterns give spans that always stay. Beside them high-recall generators propose further, overlapping spans
(addresses with a spelled-out at sign, phones without a plus, long digit groups, hexadecimal addresses, and long mixed
runs of letters and digits, which may be secrets such as access tokens, keys and passwords); boosted trees, trained here
by numpy on examples made by rule, judge each from its format and its context; a threshold for each kind, calibrated on
examples held out from training, decides. Trees and features are one DataFrame expression.

Scale: one pass over the texts without a shuffle; patterns are possessive, so that long runs of digits or letters cost
linear time. Spans of one kind never overlap, so neighbours are found by binary search, and texts are read in blocks:
100,000 matches in a text cost about that many steps. The model is trained on a fixed number of examples.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .native import let, up_to

KINDS = ("email", "ip", "card", "phone")
#: What spans are written as; the last kind has no base pattern.
EVERY = (*KINDS, "secret")
#: Code points of a block of a text, and elements of a block of sums.
BLOCK, SUMS = 4096, 256
LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns. Lookbehinds and possessive quantifiers only save time: a match that starts inside a run would have
#: started at the run's first character.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Generators of further candidates.
MORE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot |\.)[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){2,7}(?:[0-9A-Fa-f]{1,4}+|:[0-9A-Fa-f]{1,4}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9]{4}+(?:[ -]?+[0-9]{4}){2}[ -]?+[0-9]{2,7}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){0,2}(?![0-9A-Za-z-])",
    "secret": r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_=-]{16,}+",
}
#: What must be there before a pattern is tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CUES = ("(?i)(e-?mail|mail|contact|write|reach|courriel|correo)", "(?i)(phone|tel|call|mobile|fax|cell|ring|sms)", "(?i)(card|visa|amex|master|credit|debit|account|carte|tarjeta)", "(?i)(ip|host|server|address|login|client|addr)", "(?i)(isbn|order|version|invoice|date|page|part|ref|no\\.|id|serial|price|chapter|figure|score|look|meet|stay)", r"(?i)(token|secret|passw|pwd|key|auth|bearer|credential)[a-z_-]{0,12}[\"' ]*[:= ]\s*[\"']?$", r"(?i)(commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|build|file|etag|revision|image|rev)[a-z_-]{0,8}[\"' ]*[:= ]?\s*[\"']?$")


def sums_before(n: Column, i: Column) -> Column:
    """The sum of the first i of the numbers n, in about SUMS steps: whole blocks were added up before."""
    block = F.floor(i / SUMS).cast("int")
    return F.get(n["b"], block) + total(F.slice(n["n"], block * SUMS + 1, i - block * SUMS))


def total(n: Column) -> Column:
    return F.aggregate(n, F.lit(0), lambda a, v: a + v)


def summed(numbers: Column) -> Column:
    """The numbers as n, and b, the sums before each block of SUMS of them."""

    def of(n: Column) -> Column:
        sizes = F.transform(up_to(F.floor(F.size(n) / SUMS).cast("int")), lambda b: total(F.slice(n, b * SUMS + 1, F.lit(SUMS))))
        return let(sizes, lambda x: F.struct(n.alias("n"), F.transform(up_to(F.size(x) + 1), lambda b: total(F.slice(x, F.lit(1), b))).alias("b")))

    return let(numbers, of)


def found(text: Column, pattern: str, when: Column) -> Column:
    """(s, e, t) of all matches from left to right, in code points."""

    def spans(parts: Column, hits: Column) -> Column:
        # a match starts after as many parts and as many matches as come before it
        lengths = F.struct(summed(F.transform(parts, lambda p: F.length(p))).alias("p"), summed(F.transform(hits, lambda h: F.length(h))).alias("h"), hits.alias("t"))

        def places(x: Column) -> Column:
            start = lambda i: sums_before(x["p"], i + 1) + sums_before(x["h"], i)
            return F.transform(x["t"], lambda t, i: let(start(i), lambda s: F.struct(s.alias("s"), (s + F.length(t)).alias("e"), t.alias("t"))))

        return let(lengths, places)

    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    hits = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return let(hits, lambda h: F.when(F.size(h) > 0, spans(F.split(text, pattern, -1), h)).otherwise(none))


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, n: Column) -> Column:
    """n code points of a text in blocks, from start on (0: its first)."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + n) / BLOCK).cast("int")
    here = lambda b: F.coalesce(F.get(blocks, b), F.lit(""))
    inside = start - first * BLOCK + 1
    across = F.concat(F.substring(here(first), inside, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(here(last), F.lit(1), start + n - last * BLOCK))
    return F.when(first == last, F.substring(here(first), inside, n)).otherwise(across)


def how_many(spans: Column, field: str, value: Column, equal: bool = False) -> Column:
    """Of spans in ascending order of a field, how many are below value (or equal), by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(28, -1, -1)])
    below = lambda x: (x[field] <= value) if equal else (x[field] < value)
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(below(F.get(spans, at + (step - 1))), F.lit(False)), step).otherwise(F.lit(0)))


def by_kind(spans: Column) -> Column:
    """A struct with the spans of each kind; these are in order and don't overlap."""
    own = lambda k: F.filter(spans, lambda x: x["k"] == k)
    return F.struct(*[own(k).alias(f"k{k}") for k in range(len(EVERY))])


def any_kind(kinds: Column, test) -> Column:
    return reduce(lambda a, b: a | b, [test(kinds[f"k{k}"]) for k in range(len(EVERY))])


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def total(d: Column) -> Column:
        n = F.length(d)
        value = lambda i: F.substring(d, n - i, F.lit(1)).cast("int")
        doubled = lambda i: let(value(i) * 2, lambda v: F.when(v > 9, v - 9).otherwise(v))
        return F.aggregate(up_to(n), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(i)).otherwise(value(i)))

    return let(digits(t), lambda d: total(d) % 10 == 0)


def of_kind(k: int, *more):
    """A function of a match that gives (s, k, e, t) and what `more` give."""
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["t"].alias("t"), *[f(x) for f in more])


def base_spans(text: Column) -> Column:
    """(s, e, k, t) of all base spans, k being the kind's number; by s, then k."""
    valid = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x["t"], "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(x["t"], "\\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")), F.lit(999)) <= 255),
        "card": lambda x: F.length(digits(x["t"])).between(14, 19) & luhn(x["t"]),
        "phone": lambda x: F.length(digits(x["t"])).between(10, 15),
    }
    each = []
    for k, kind in enumerate(KINDS):
        when = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9](?:[ -]?+[0-9]){13}")
        hits = F.filter(found(text, BASE[kind], when), valid[kind])
        each.append(F.transform(hits, of_kind(k)))
    return F.sort_array(F.concat(*each))


def candidates(text: Column) -> Column:
    """(s, k, e, t, before, after) of what the generators propose."""
    each = []
    for k, kind in enumerate(EVERY):
        when = text.rlike({"email": "(?i)[\\[({ ]at[\\])} ]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "secret": MORE["secret"]}.get(kind, "[0-9][0-9][) .-]*[0-9]"))
        hits = found(text, MORE[kind], when)
        if kind == "secret":  # long words and long numbers are none
            hits = F.filter(hits, lambda x: x["t"].rlike("[0-9]") & x["t"].rlike("[A-Za-z]"))
        each.append(F.transform(hits, of_kind(k)))

    def around(blocks: Column):
        before = lambda x: piece(blocks, F.greatest(x["s"] - 24, F.lit(0)), F.least(x["s"], F.lit(24))).alias("before")
        after = lambda x: piece(blocks, x["e"], F.lit(12)).alias("after")
        return lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["t"].alias("t"), before(x), after(x))

    none = F.array().cast("array<struct<s:int,k:int,e:int,t:string,before:string,after:string>>")
    return let(F.concat(*each), lambda c: F.when(F.size(c) > 0, let(blocks_of(text), lambda b: F.transform(c, around(b)))).otherwise(none))


def features(x: Column) -> list[Column]:
    """Numbers that describe a candidate's format and context."""
    t, before, after = x["t"], x["before"], x["after"]
    count = lambda c, p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    flag = lambda c: F.when(c, 1).otherwise(0)
    out = [x["k"], F.length(t), count(t, "[0-9]"), count(t, "[ ]"), count(t, "[-]"), count(t, "[.]"), count(t, "[()\\[\\]{}]"), count(t, ":"), flag(t.rlike("^\\(")), flag(t.rlike("^(19|20)[0-9]{2}[ .-]")), flag((F.length(t) <= 64) & luhn(t)), flag(t.rlike("^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}$")), flag(t.rlike("(?i)[\\[({](at|dot)[\\])}]")), flag(t.rlike("(?i) dot ")), flag(t.rlike("[A-Fa-f]"))]
    out += [count(t, "[A-Z]") / F.length(t), count(t, "[0-9]") / F.length(t), count(t, "[G-Zg-z]") / F.length(t), count(t, "[+/_=-]"), flag(t.rlike("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"))]
    out += [flag(before.rlike(c)) for c in CUES]
    out += [flag(before.rlike("[0-9$€£%/]\\s*$")), flag(after.rlike("^\\s*[0-9%€£/]")), flag(before.rlike("[:=]\\s*[\"']?$")), flag(before.rlike("[\"']$")), flag(after.rlike("^[\"']")), flag(before.rlike("[/.@]$")), flag(after.rlike("^\\.[A-Za-z0-9]"))]
    return [c.cast("double") for c in out]


#: How many features() gives.
N_FEATURES = 20 + len(CUES) + 7


def examples(n: int = 3000, seed: int = 8) -> list[tuple[str, int]]:
    """Short texts made by rule, each with one candidate or more, and whether these are personal data or secrets. The
    classes overlap: the last rule of each kind makes the same texts, with either label."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    mixed = lambda k, letters: "".join(r.choice(letters) for _ in range(k - 2)) + d(1) + r.choice("abcdef")
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
    lower, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names, hosts = ("anna", "j.smith", "info", "marc_b", "sales", "lee99"), ("mail", "example", "web-post", "uni")
    filler = ("the results of the day", "as was said before", "and then we went on", "see below for more", "il y avait hier", "die Antwort war")
    case = lambda t: t.upper() if r.random() < 0.15 else t
    is_ = lambda: r.choice((" = ", "=", ": ", ":", " "))

    def quoted(cue: str, value: str) -> tuple[str, str]:
        q = r.choice(('"', '"', "'", ""))
        return cue, f"{q}{value}{q}"

    random_run = lambda: r.choice((lambda: mixed(r.choice((32, 40, 64)), lower), lambda: mixed(r.randint(16, 48), both), lambda: mixed(r.randint(20, 44), both + "_-")))()
    unsure = (
        lambda: ("", f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: ("", f"{d(4)} {d(4)} {d(4)} {d(4)}"),
        lambda: quoted("", random_run()),
        lambda: ("", f"{r.choice(names)} at {r.choice(hosts)}.{r.choice(('com', 'org'))}"),
    )
    yes = (
        lambda: (r.choice(("mail: ", "contact ", "write to ", "reach me: ", "")), f"{r.choice(names)}{r.choice(('[at]', ' [at] ', '(at)', ' (at) '))}{r.choice(hosts)}{r.choice(('.', '[dot]', ' [dot] ', ' (dot) '))}{r.choice(('com', 'org', 'net'))}"),
        lambda: (r.choice(("email ", "contact: ", "reach me: ")), f"{r.choice(names)} at {r.choice(hosts)} dot {r.choice(('com', 'org'))}"),
        lambda: (r.choice(("call ", "tel: ", "phone ", "mobile: ", "")), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (r.choice(("call ", "tel: ", "phone ", "fax: ")), f"{d(3)}{r.choice('-.')}{d(3)}{r.choice('-.')}{d(4)}"),
        lambda: (r.choice(("call ", "tel ", "phone: ", "mobile ")), f"0{d(2)} {d(3)} {d(2)} {d(2)}"),
        lambda: (r.choice(("card ", "visa: ", "credit card ", "account ")), f"{d(4)} {d(4)} {d(4)} {d(4)}"),
        lambda: (r.choice(("card ", "visa ", "debit card: ")), f"{d(16)}"),
        lambda: (r.choice(("ip ", "host ", "from server ", "client: ")), ":".join(hexes() for _ in range(8))),
        *[lambda: quoted(case(r.choice(("token", "api_key", "apikey", "secret", "access_token", "auth-token", "password", "client_secret", "private key", "SECRET_KEY"))) + is_(), case(random_run()))] * 4,
        lambda: ("Authorization: Bearer ", random_run()),
        *unsure,
    )
    no = (
        lambda: (r.choice(("look ", "we meet ", "stay ", "they were ")), f"{r.choice(('home', 'noon', 'work'))} at {r.choice(('the', 'this', 'that'))}.{r.choice(('Then', 'But', 'And'))}"),
        lambda: (r.choice(("on ", "date: ", "since ", "")), f"{r.choice(('19', '20'))}{d(2)}-{d(2)}-{d(2)}"),
        lambda: (r.choice(("on ", "am ", "le ", "")), f"{d(2)}.{d(2)}.{d(4)}"),
        lambda: (r.choice(("isbn ", "order ", "ref ", "invoice ")), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(("version ", "part ", "page ", "score ")), f"{d(2)}.{d(2)}.{d(3)}"),
        lambda: (r.choice(("order ", "id ", "serial ", "invoice no. ", "")), f"{d(16)}"),
        lambda: (r.choice(("values ", "rows ", "sums ", "price ")), f"{d(4)} {d(4)} {d(4)} {d(4)}"),
        lambda: (r.choice(("at ", "time ", "ran ", "")), f"{d(2)}:{d(2)}:{d(2)}"),
        lambda: (r.choice(("rows ", "counts ", "of ")), f"{d(3)} {d(3)} {d(3)}"),
        *[lambda: quoted(case(r.choice(("commit", "sha1", "md5", "checksum", "digest", "hash", "etag", "revision", "build", "image sha256"))) + is_(), mixed(r.choice((32, 40, 64)), lower))] * 3,
        lambda: quoted(r.choice(("uuid ", "id = ", "guid: ", "request ")), "-".join(mixed(k, lower) for k in (8, 4, 4, 4, 12))),
        lambda: (r.choice(("see ", "file ", "")), f"{r.choice(('IMG', 'report', 'scan', 'chapter'))}_{d(8)}_{d(6)}.{r.choice(('jpg', 'pdf'))}"),
        lambda: (r.choice(("see /", "/posts/", "at www.site.org/")), f"the-{r.choice(('ten', 'best', 'new'))}-things-of-{d(4)}-{r.choice(('part', 'again'))}"),
        *unsure,
    )
    out = []
    for k in range(n):
        label = k % 2
        cue, body = r.choice(yes if label else no)()
        out.append((f"{r.choice(filler)} {cue}{body} {r.choice(filler)}", label))
    return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, depth: int = 3, l2: float = 1.0) -> list[dict]:
    """Regression trees on the gradients of the logistic loss, as nested dicts."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> dict:
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if left else ():
            v = x[rows, f]
            for c in np.unique(v)[:-1]:
                low = rows[v <= c]
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                if gain > best[0]:
                    best = (gain, f, float(c))
        if best[1] is None:
            return {"leaf": round(float(-rate * G / (H + l2)), 6)}
        v = x[rows, best[1]]
        return {"f": best[1], "c": best[2], "low": grow(rows[v <= best[2]], g, h, left - 1), "high": grow(rows[v > best[2]], g, h, left - 1)}

    trees, logit = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
        logit += leaves(trees[-1], x)
    return trees


def leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    if "leaf" in tree:
        return np.full(len(x), tree["leaf"])
    return np.where(x[:, tree["f"]] <= tree["c"], leaves(tree["low"], x), leaves(tree["high"], x))


def tree_column(tree: dict, f: list[Column]) -> Column:
    if "leaf" in tree:
        return F.lit(tree["leaf"])
    return F.when(f[tree["f"]] <= tree["c"], tree_column(tree["low"], f)).otherwise(tree_column(tree["high"], f))


_model: dict[int, tuple[list[dict], list[float]]] = {}


def model(spark: SparkSession, precision: float = 0.9) -> tuple[list[dict], list[float]]:
    """Trees and, for each kind, the least threshold at which held-out examples reach the precision. The features come
    from the same expressions that score documents, over the fixed examples."""
    if 0 not in _model:
        made = examples()
        rows = spark.range(1).select(F.posexplode(F.split(F.lit("\x01".join(t for t, _ in made)), "\x01")).alias("n", "text"))
        rows = rows.select("n", F.explode(candidates(F.col("text"))).alias("x"))
        got = rows.select("n", F.array(*features(F.col("x"))).alias("f")).orderBy("n", "f").collect()  # a few per example
        x, y = np.array([r.f for r in got]), np.array([made[r.n][1] for r in got], float)
        train = np.array([r.n % 10 < 7 for r in got])
        trees = boosted(x[train], y[train])
        score = 1 / (1 + np.exp(-sum(leaves(t, x) for t in trees)))
        cuts = []
        for k in range(len(EVERY)):
            own = ~train & (x[:, 0] == k)
            good = [c for c in np.linspace(0.02, 0.98, 97) if (score[own] >= c).any() and y[own][score[own] >= c].mean() >= precision]
            cuts.append(float(good[0]) if good else 2.0)
        _model[0] = trees, cuts
    return _model[0]


def added_spans(text: Column, base: Column, trees: list[dict], cuts: list[float]) -> Column:
    """Candidates over their kind's threshold that overlap no base span and no better candidate (of higher score, then
    further left, then of the kind listed first)."""

    def scored(x: Column) -> Column:
        def of(f: Column) -> Column:
            own = [F.get(f, i) for i in range(N_FEATURES)]
            return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["t"].alias("t"), (1 / (1 + F.exp(-reduce(lambda a, b: a + b, [tree_column(t, own) for t in trees])))).alias("p"))

        return let(F.array(*features(x)), of)

    cut = F.array(*map(F.lit, cuts))
    better = lambda x, y: (y["p"] > x["p"]) | ((y["p"] == x["p"]) & (F.struct(y["s"], y["k"]) < F.struct(x["s"], x["k"])))

    def chosen(c: Column) -> Column:
        def beaten(x: Column, own: Column) -> Column:
            return let(how_many(own, "e", x["s"], equal=True), lambda a: F.exists(F.slice(own, a + 1, how_many(own, "s", x["e"]) - a), lambda y: better(x, y)))

        return let(by_kind(c), lambda kinds: F.filter(c, lambda x: ~any_kind(kinds, lambda own: beaten(x, own))))

    def free(c: Column) -> Column:
        over = lambda x, own: F.coalesce(F.get(own, how_many(own, "s", x["e"]) - 1)["e"] > x["s"], F.lit(False))
        apart = let(by_kind(base), lambda kinds: F.filter(c, lambda x: ~any_kind(kinds, lambda own: over(x, own))))
        return F.filter(F.transform(apart, scored), lambda x: x["p"] >= F.get(cut, x["k"]))

    none = F.array().cast("array<struct<s:int,k:int,e:int,t:string>>")
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["t"].alias("t"))
    return let(candidates(text), lambda c: F.when(F.size(c) > 0, F.transform(let(free(c), chosen), plain)).otherwise(none))


def with_spans(docs: DataFrame, base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """docs with two more columns, base and all spans as arrays of (s, k, e, t) by s, then k. Null text: none. The names
    must be new to docs."""
    trees, cuts = model(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = let(base_spans(text), lambda b: F.struct(b.alias("b"), added_spans(text, b, trees, cuts).alias("a")))
    held = unused(docs, "both")
    return docs.withColumn(held, both).withColumn(base, F.col(f"{held}.b")).withColumn(every, F.sort_array(F.concat(f"{held}.b", f"{held}.a"))).drop(held)


def unused(docs: DataFrame, stem: str) -> str:
    """A column name that docs hasn't."""
    taken, name = {c.lower() for c in docs.columns}, f"_{stem}"
    while name in taken:
        name += "_"
    return name


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, EVERY))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every document, n_added and, of these, n_secret. Null doc_ids and repeated rows
    come back as they are; null text is empty. Extra columns are ignored."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"), (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_added"), F.size(F.filter("all_spans", lambda x: x["k"] == len(KINDS))).cast("long").alias("n_secret"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in square brackets; overlapping spans are one, of the kind that
    starts first. Null text stays null; other columns are as they are, n_chars is counted anew."""
    columns, base, every = docs.columns, unused(docs, "base"), unused(docs, "every")
    rows = with_spans(docs, base, every)

    def merged(spans: Column) -> Column:
        """(s, k, e) of runs of overlapping spans. Spans of one kind don't overlap, so whether a span goes on with an
        earlier one is seen from the last of each kind that starts before it."""

        def starts(kinds: Column) -> Column:
            def goes_on(x: Column, own: Column) -> Column:
                before = lambda n: F.coalesce(F.get(own, n - 1)["e"] > x["s"], F.lit(False))
                same = lambda n: F.coalesce((F.get(own, n)["s"] == x["s"]) & (F.get(own, n)["k"] < x["k"]), F.lit(False))
                return let(how_many(own, "s", x["s"]), lambda n: before(n) | same(n))

            return F.filter(F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), i.alias("i"))), lambda x: ~any_kind(kinds, lambda own: goes_on(x, own)))

        def ended(heads: Column) -> Column:
            until = lambda j: F.coalesce(F.get(heads, j + 1)["i"], F.size(spans))
            end = lambda h, j: F.array_max(F.transform(F.slice(spans, h["i"] + 1, until(j) - h["i"]), lambda x: x["e"]))
            return F.transform(heads, lambda h, j: F.struct(h["s"].alias("s"), h["k"].alias("k"), end(h, j).alias("e")))

        return let(let(by_kind(spans), starts), ended)

    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in EVERY])

    def rebuilt(m: Column) -> Column:
        at = lambda i: F.coalesce(F.get(m, i - 1)["e"], F.lit(0))
        parts = lambda blocks: F.transform(m, lambda x, i: F.concat(piece(blocks, at(i), x["s"] - at(i)), F.get(kinds, x["k"])))
        return let(blocks_of(F.col("text")), lambda blocks: F.concat(F.array_join(parts(blocks), ""), piece(blocks, F.get(m, F.size(m) - 1)["e"], F.length("text"))))

    text = F.when(F.size(every) > 0, let(merged(F.col(every)), rebuilt)).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"))
