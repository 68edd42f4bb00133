"""Verdicts on URLs: host and path rules, and beyond them logistic regression on hashed character n-grams.

The regression is trained here, by numpy, from the small labelled table below: its features are the shares of hashed
n-grams of the host and of the path. Scoring is a DataFrame expression over the weights, one array literal.

Scale: one pass without a shuffle; nothing is gathered, and the model's size is fixed.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .native import let, lower_ascii, up_to

SLOTS, GRAMS = 4096, (3, 4)
#: (host and path prefix, verdict): a rule fits its host and all subdomains; the longest that fits wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Labelled URLs, 1 to block: made up for training; hosts and paths of both kinds share subdomains, languages and forms.
BLOCKED = """
best-casino.test/en/12 www.casino-royal.test/en/310 casino-online.test/de/44.html m.win-casino.test/fr/9 casino-win-big.test/en/700
super-slots.test/en/15 www.slots-jackpot.test/es/220 jackpot-win.test/en/3 m.lucky-win.test/en/412 poker-win.test/fr/71.html
cheap-meds.test/en/100 www.cheap-pills-shop.test/en/208 pills-online.test/de/33 m.buy-pills.test/en/77 blog.cheap-drugs.test/es/5
cheap-watches.test/en/91 www.cheap-replica.test/fr/620 discount-pills.test/en/18 cheap-loans.test/en/540 m.fast-cheap-loans.test/de/2
free-bets-now.test/en/61 www.free-bet.test/en/902 bets-today.test/fr/14 m.sports-bets.test/en/350 blog.free-spins.test/en/28
free-bets-club.test/es/800 bet-free.test/de/19.html www.bets-win.test/en/47 free-money.test/en/6 m.free-prizes.test/en/231
ads-click.test/en/10 www.ads-tracker.test/en/113 track-ads.test/fr/56 m.ad-track.test/en/420 blog.click-track.test/de/75
ads-server.test/es/301 www.pixel-track.test/en/8 popup-ads.test/en/66 m.banner-ads.test/fr/98.html ads-track-pixel.test/en/505
spam-links.test/en/40 www.link-farm.test/en/270 spam-mail.test/de/11 m.seo-farm.test/en/690 blog.spam-farms.test/es/84
content-farm.test/en/13 www.spam-seo.test/fr/330 buy-links-farm.test/en/29 m.spam-bots.test/en/57 farm-links.test/en/900
adult-cams.test/en/21 www.hot-cams.test/de/140 cracked-warez.test/en/36 m.free-warez.test/en/480 keygen-crack.test/fr/7
"""
ALLOWED = """
garden-notes.test/en/12 www.city-library.test/en/310 riverside.test/de/44.html m.mountain-hut.test/fr/9 thelantern.test/en/700
history-club.test/en/15 www.university.test/es/220 museum.test/en/3 m.weather-report.test/en/412 local-news.test/fr/71.html
theorem.test/en/100 www.other-lands.test/en/208 nation-press.test/de/33 m.thereading.test/en/77 blog.station.test/es/5
thoughts.test/en/91 www.theanswer.test/fr/620 orchestra.test/en/18 heritage.test/en/540 m.theatre.test/de/2
blog.northern.test/en/61 www.thousand.test/en/902 tionhouse.test/fr/14 m.entering.test/en/350 blog.thinning.test/en/28
recipes.test/es/800 cooking.test/de/19.html www.handbook.test/en/47 thistle.test/en/6 m.sharing.test/en/231
encyclopedia.test/en/10 www.open-data.test/en/113 science-daily.test/fr/56 m.school.test/en/420 blog.astronomy.test/de/75
therapy.test/es/301 www.thermal.test/en/8 threshold.test/en/66 m.thunder.test/fr/98.html thanks.test/en/505
parliament.test/en/40 www.football-club.test/en/270 chess.test/de/11 m.painting.test/en/690 blog.ethics.test/es/84
rating.test/en/13 www.ontheroad.test/fr/330 inthehills.test/en/29 m.sheeting.test/en/57 bleachers.test/en/900
edition.test/en/21 www.relation.test/de/140 standing.test/en/36 m.tidings.test/en/480 orations.test/fr/7
"""

#: What a training host may have between its name and its last label, of either kind.
LABELS = ("", ".example", ".co")


def grams(text: str, mark: str) -> list[int]:
    import xxhash

    text = f"{mark}{text}$"
    out = []
    for n in GRAMS:
        for a in range(len(text) - n + 1):
            h = xxhash.xxh64_intdigest(text[a : a + n].encode(), 42)
            out.append((h - (h >> 63 << 64)) % SLOTS)
    return out


def plain(n: int = 200, seed: int = 5) -> list[str]:
    """Further URLs to allow, made of frequent pairs of letters, so that a name never seen is one to allow."""
    r = random.Random(seed)
    pairs = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
    return [f"{r.choice(('', '', 'www.', 'blog.', 'm.'))}{''.join(r.choice(pairs) for _ in range(r.randint(2, 6)))}.test/{r.choice(('en', 'fr', 'de', 'es'))}/{r.randint(1, 999)}{r.choice(('', '', '/', '.html'))}" for _ in range(n)]


def pushy(n: int = 200, seed: int = 6) -> list[str]:
    """Further URLs to block: stems of such sites, decorated."""
    r = random.Random(seed)
    stems = "casino slots jackpot poker pills meds pharma viagra replica loans bets betting spins prizes ads adserver tracker popup banner clicks spam linkfarm seo warez cracks keygen cams".split()
    before, after = ("", "", "mega", "best", "cheap", "free", "super", "my", "e"), ("", "", "4u", "-online", "-win", "-shop", "-club", "24", "-now", "-links", "-zone")
    return [f"{r.choice(('', '', 'www.', 'blog.', 'm.'))}{r.choice(before)}{r.choice(('', '-'))}{r.choice(stems)}{r.choice(after)}.test/{r.choice(('en', 'fr', 'de', 'es'))}/{r.randint(1, 999)}{r.choice(('', '', '/', '.html'))}".replace("//", "/") for _ in range(n)]


@cache
def model(steps: int = 3000, rate: float = 200.0, decay: float = 2e-5) -> tuple[tuple[float, ...], float]:
    """Weights and intercept by full-batch gradient descent; no randomness."""
    urls = [(u, 1.0) for u in [*BLOCKED.split(), *pushy()]] + [(u, 0.0) for u in [*ALLOWED.split(), *plain()]]
    urls = [(u.replace(".test/", f"{label}/"), k) for u, k in urls for label in LABELS]
    x, y = np.zeros((len(urls), SLOTS)), np.array([k for _, k in urls])
    for r, (url, _) in enumerate(urls):
        host, _, path = url.partition("/")
        got = grams(host, "^") + grams("/" + path, "|")
        np.add.at(x[r], got, 1 / len(got))
    w, b = np.zeros(SLOTS), 0.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ miss / len(y) + decay * w)
        b -= rate / 50 * miss.mean()
    return tuple(float(f"{v:.6g}") for v in w), float(b)


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1), "/", 1)
    return lower_ascii(F.regexp_extract(rest, "^[^?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site(host: Column) -> Column:
    """The host without its last label: a suffix such as com says nothing about a page."""
    return F.regexp_replace(host, "\\.[^.]*$", "")


def score(host: Column, path: Column) -> Column:
    """The probability that a page is one to block."""
    weights, intercept = model()
    held = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")

    def total(text: Column, mark: str) -> Column:
        def of(t: Column) -> Column:
            weight = lambda n: lambda i: F.get(held, F.pmod(F.xxhash64(F.substring(t, i + 1, F.lit(n))), F.lit(SLOTS)).cast("int"))
            return F.concat(*[F.transform(up_to(F.length(t) - (n - 1)), weight(n)) for n in GRAMS])

        return let(F.concat(F.lit(mark), text, F.lit("$")), of)

    every = F.concat(total(site(host), "^"), total(path, "|"))
    mean = let(every, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0))
    return 1 / (1 + F.exp(-(mean + intercept)))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page. Null urls and urls without :// have an empty host and
    path and the method's verdict on these; null page_ids and repeated rows come back as they are. Extra columns are
    ignored."""
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"), score(F.col("host"), F.col("path")).alias("score"))
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
