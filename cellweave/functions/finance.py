"""Money over time: annuities, depreciation, cash flows, securities."""

from __future__ import annotations

import math

from .dates import coupon, day_count, days_360, leap, month_length, parts, serial_of, year_fraction
from .registry import scalar
from .values import DIV0, NUM, VALUE


def growth(rate: float, n: float) -> tuple[float, float]:
    g = (1 + rate) ** n
    return g, (g - 1) / rate if rate else n


def fv(rate, n, pmt=0.0, pv=0.0, due=0.0):
    g, s = growth(rate, n)
    return -(pv * g + pmt * (1 + rate * (1 if due else 0)) * s)


def pmt(rate, n, pv, fv_=0.0, due=0.0):
    g, s = growth(rate, n)
    return -(pv * g + fv_) / ((1 + rate * (1 if due else 0)) * s)


scalar("FV", "nn|nnn")(lambda r, n, p=0.0, v=0.0, d=0.0: fv(r, n, p, v, d))


@scalar("PV", "nn|nnn")
def pv(rate, n, p=0.0, f=0.0, due=0.0):
    g, s = growth(rate, n)
    return -(f + p * (1 + rate * (1 if due else 0)) * s) / g


scalar("PMT", "nnn|nn")(lambda r, n, v, f=0.0, d=0.0: pmt(r, n, v, f, d) if n else NUM)


@scalar("NPER", "nnn|nn")
def nper(rate, p, v, f=0.0, due=0.0):
    if not rate:
        return -(v + f) / p if p else NUM
    k = p * (1 + rate * (1 if due else 0)) / rate
    ratio = (k - f) / (v + k)
    return math.log(ratio) / math.log1p(rate) if ratio > 0 else NUM


def solve(f, guess: float, tries: int = 200):
    """A root by Newton's steps with a numeric slope, then by bisection between changes of sign."""
    x = guess
    for _ in range(tries):
        try:
            y = f(x)
            h = max(1e-7, abs(x) * 1e-7)
            slope = (f(x + h) - f(x - h)) / (2 * h)
            if not slope:
                break
            nxt = x - y / slope
            if nxt <= -1:
                nxt = (x - 1) / 2
            if abs(nxt - x) < 1e-14 * max(1, abs(nxt)):
                return nxt
            x = nxt
        except (OverflowError, ZeroDivisionError, ValueError, TypeError):
            break
    else:
        if abs(f(x)) < 1e-7:
            return x
    grid = [-0.99 + 0.01 * k for k in range(99)] + [0.0001] + [0.01 * 1.15**k for k in range(80)]
    last = None
    for x in grid:
        try:
            y = f(x)
        except (OverflowError, ZeroDivisionError, ValueError):
            continue
        if last is not None and last[1] * y <= 0:
            a, b, ya = last[0], x, last[1]
            for _ in range(200):
                m = (a + b) / 2
                ym = f(m)
                if ya * ym <= 0:
                    b = m
                else:
                    a, ya = m, ym
            return (a + b) / 2
        last = (x, y)
    return NUM


@scalar("RATE", "nnn|nnnn")
def rate(n, p, v, f=0.0, due=0.0, guess=0.1):
    def left(r):
        g, s = growth(r, n)
        return v * g + p * (1 + r * (1 if due else 0)) * s + f

    return solve(left, guess)


@scalar("IPMT", "nnnn|nn")
def ipmt(r, k, n, v, f=0.0, due=0.0):
    if not 1 <= k <= n:
        return NUM
    if due and k == 1:
        return 0.0
    p = pmt(r, n, v, f, due)
    out = fv(r, k - 1, p, v, due) * r
    return out / (1 + r) if due else out


@scalar("PPMT", "nnnn|nn")
def ppmt(r, k, n, v, f=0.0, due=0.0):
    i = ipmt(r, k, n, v, f, due)
    return i if i is NUM else pmt(r, n, v, f, due) - i


def cumulated(r, n, v, a, b, due, principal):
    a, b = int(a), int(b)
    if r <= 0 or n <= 0 or v <= 0 or not 1 <= a <= b <= n or due not in (0, 1):
        return NUM
    return math.fsum((ppmt if principal else ipmt)(r, k, n, v, 0.0, due) for k in range(a, b + 1))


scalar("CUMIPMT", "nnnnnn")(lambda r, n, v, a, b, d: cumulated(r, n, v, a, b, d, False))
scalar("CUMPRINC", "nnnnnn")(lambda r, n, v, a, b, d: cumulated(r, n, v, a, b, d, True))
scalar("ISPMT", "nnnn")(lambda r, k, n, v: v * r * (k / n - 1))


def npv(r, flows):
    return math.fsum(x / (1 + r) ** (k + 1) for k, x in enumerate(flows))


def irr(flows, guess=0.1):
    if not any(x > 0 for x in flows) or not any(x < 0 for x in flows):
        return NUM
    return solve(lambda r: math.fsum(x / (1 + r) ** k for k, x in enumerate(flows)), guess)


def xnpv(r, flows, days):
    if len(flows) != len(days) or r <= -1 or any(d < days[0] for d in days):
        return NUM
    return math.fsum(x / (1 + r) ** ((math.floor(d) - math.floor(days[0])) / 365) for x, d in zip(flows, days, strict=True))


def xirr(flows, days, guess=0.1):
    if len(flows) != len(days) or not any(x > 0 for x in flows) or not any(x < 0 for x in flows):
        return NUM
    return solve(lambda r: math.fsum(x / (1 + r) ** ((math.floor(d) - math.floor(days[0])) / 365) for x, d in zip(flows, days, strict=True)), guess)


def mirr(flows, finance, reinvest):
    n = len(flows)
    out = npv(finance, [min(x, 0) for x in flows])
    into = npv(reinvest, [max(x, 0) for x in flows])
    return DIV0 if not out or not into else (-into * (1 + reinvest) ** n / (out * (1 + finance))) ** (1 / (n - 1)) - 1


scalar("SLN", "nnn")(lambda c, s, n: (c - s) / n if n else DIV0)
scalar("SYD", "nnnn")(lambda c, s, n, k: (c - s) * (n - k + 1) * 2 / (n * (n + 1)) if 1 <= k <= n else NUM)


@scalar("DB", "nnnn|n")
def db(cost, salvage, life, period, month=12.0):
    if cost < 0 or salvage < 0 or life <= 0 or period <= 0 or not 1 <= month <= 12:
        return NUM
    if not cost:
        return 0.0
    r = round(1 - (salvage / cost) ** (1 / life), 3)
    total, out = 0.0, 0.0
    last = int(life) + (month < 12)
    if int(period) > last:
        return NUM
    for k in range(1, int(period) + 1):
        if k == 1:
            out = cost * r * month / 12
        elif k == int(life) + 1:
            out = (cost - total) * r * (12 - month) / 12
        else:
            out = (cost - total) * r
        total += out
    return out


def ddb(cost, salvage, life, period, factor=2.0):
    r = min(factor / life, 1.0)
    before = cost if period == 1 and r == 1 else cost * (1 - r) ** (period - 1)
    after = cost * (1 - r) ** period
    return max(before - max(after, salvage), 0.0)


@scalar("DDB", "nnnn|n")
def ddb_(cost, salvage, life, period, factor=2.0):
    return ddb(cost, salvage, life, period, factor) if cost >= 0 and salvage >= 0 and 0 < period <= life and factor > 0 else NUM


@scalar("VDB", "nnnnn|nb")
def vdb(cost, salvage, life, start, end, factor=2.0, no_switch=False):
    if cost < 0 or salvage < 0 or life <= 0 or start < 0 or end < start or end > life or factor <= 0:
        return NUM
    total, left = 0.0, cost
    for k in range(math.ceil(end)):
        remaining = life - k
        out = min(left * factor / life, max(left - salvage, 0.0))
        if not no_switch:
            out = max(out, max(left - salvage, 0.0) / remaining) if left > salvage else 0.0
        share = min(end, k + 1) - max(start, k)
        if share > 0:
            total += out * share
        left -= out
    return total


@scalar("AMORLINC", "nnnnnn|n")
def amorlinc(cost, purchased, first, salvage, period, r, basis=0.0):
    head = cost * r * year_fraction(purchased, first, int(basis))
    one, whole = cost * r, int((cost - salvage - head) / (cost * r))
    if period == 0:
        return head
    return one if period <= whole else cost - salvage - head - one * whole if period == whole + 1 else 0.0


@scalar("AMORDEGRC", "nnnnnn|n")
def amordegrc(cost, purchased, first, salvage, period, r, basis=0.0):
    life = 1 / r
    factor = 1.5 if 3 <= life <= 4 else 2.0 if 5 <= life <= 6 else 2.5 if life > 6 else 1.0
    r *= factor
    out = math.floor(cost * r * year_fraction(purchased, first, int(basis)) + 0.5)
    left, rest = cost - out, cost - out - salvage
    for k in range(int(period)):
        out = math.floor(r * left + 0.5)
        rest -= out
        if rest < 0:
            return math.floor(left * 0.5 + 0.5) if int(period) - k in (1, 2) and k >= 0 and int(period) - k <= 2 else 0.0
        left -= out
    return out


scalar("EFFECT", "nn")(lambda r, n: (1 + r / int(n)) ** int(n) - 1 if r > 0 and n >= 1 else NUM)
scalar("NOMINAL", "nn")(lambda r, n: ((1 + r) ** (1 / int(n)) - 1) * int(n) if r > 0 and n >= 1 else NUM)
scalar("RRI", "nnn")(lambda n, v, f: (f / v) ** (1 / n) - 1 if n > 0 and v else NUM)
scalar("PDURATION", "nnn")(lambda r, v, f: math.log(f / v) / math.log1p(r) if r > 0 and v > 0 and f > 0 else NUM)


def dollar(x, f, back):
    f = int(f)
    if f < 0:
        return NUM
    if f < 1:
        return DIV0
    whole, rest = math.trunc(x), x - math.trunc(x)
    ten = 10.0 ** math.ceil(math.log10(f)) if f > 1 else 10.0
    return whole + (rest * f / ten if back else rest * ten / f)


scalar("DOLLARDE", "nn")(lambda x, f: dollar(x, f, False))
scalar("DOLLARFR", "nn")(lambda x, f: dollar(x, f, True))

#: Units of national currency to one euro, and their decimals.
EURO = {"EUR": (1.0, 2), "ATS": (13.7603, 2), "BEF": (40.3399, 0), "DEM": (1.95583, 2), "ESP": (166.386, 0), "FIM": (5.94573, 2), "FRF": (6.55957, 2), "GRD": (340.75, 0), "IEP": (0.787564, 2), "ITL": (1936.27, 0), "LUF": (40.3399, 0), "NLG": (2.20371, 2), "PTE": (200.482, 0), "SIT": (239.64, 2), "MTL": (0.4293, 2), "CYP": (0.585274, 2), "SKK": (30.126, 2), "EEK": (15.6466, 2), "LVL": (0.702804, 2), "LTL": (3.4528, 2)}


@scalar("EUROCONVERT", "ntt|bn")
def euroconvert(x, a, b, full=False, digits=None):
    if a.upper() not in EURO or b.upper() not in EURO:
        return VALUE
    (one, _), (two, places) = EURO[a.upper()], EURO[b.upper()]
    if a.upper() == b.upper():
        return x
    euro = x / one
    if digits is not None and one != 1.0:
        euro = round(euro, int(digits))
    out = euro * two
    return out if full else math.copysign(math.floor(abs(out) * 10**places + 0.5) / 10**places, out)


# Coupons and securities.
def basis_of(b) -> int:
    if not 0 <= int(b) <= 4:
        raise NUM
    return int(b)


def coupon_days(s, m, f, basis) -> float:
    if basis == 1:
        a, b, _ = coupon(s, m, f)
        return b - a
    return (365 if basis == 3 else 360) / f


def days_to_coupon(s, m, f, basis) -> float:
    a, b, _ = coupon(s, m, f)
    return coupon_days(s, m, f, basis) - day_count(a, s, basis) if basis in (0, 4) else b - s


def cleaned(f):
    return lambda s, m, q, b=0.0: f(math.floor(s), math.floor(m), int(q), basis_of(b))


scalar("COUPPCD", "nnn|n")(cleaned(lambda s, m, f, b: coupon(s, m, f)[0]))
scalar("COUPNCD", "nnn|n")(cleaned(lambda s, m, f, b: coupon(s, m, f)[1]))
scalar("COUPNUM", "nnn|n")(cleaned(lambda s, m, f, b: coupon(s, m, f)[2]))
scalar("COUPDAYBS", "nnn|n")(cleaned(lambda s, m, f, b: day_count(coupon(s, m, f)[0], s, b)))
scalar("COUPDAYS", "nnn|n")(cleaned(coupon_days))
scalar("COUPDAYSNC", "nnn|n")(cleaned(days_to_coupon))


def price(s, m, r, y, redemption, f, basis):
    n = coupon(s, m, f)[2]
    e, dsc = coupon_days(s, m, f, basis), days_to_coupon(s, m, f, basis)
    a = day_count(coupon(s, m, f)[0], s, basis)
    c = 100 * r / f
    if n == 1:
        return (redemption + c) / (1 + dsc / e * y / f) - c * a / e
    g = 1 + y / f
    return redemption / g ** (n - 1 + dsc / e) + math.fsum(c / g ** (k + dsc / e) for k in range(n)) - c * a / e


@scalar("PRICE", "nnnnnn|n")
def price_(s, m, r, y, redemption, f, b=0.0):
    if r < 0 or y < 0 or redemption <= 0:
        return NUM
    return price(math.floor(s), math.floor(m), r, y, redemption, int(f), basis_of(b))


@scalar("YIELD", "nnnnnn|n")
def yield_(s, m, r, pr, redemption, f, b=0.0):
    if r < 0 or pr <= 0 or redemption <= 0:
        return NUM
    s, m, f, b = math.floor(s), math.floor(m), int(f), basis_of(b)
    if coupon(s, m, f)[2] == 1:
        e, dsc, a = coupon_days(s, m, f, b), days_to_coupon(s, m, f, b), day_count(coupon(s, m, f)[0], s, b)
        paid = pr / 100 + a / e * r / f
        return (redemption / 100 + r / f - paid) / paid * f * e / dsc
    return solve(lambda y: price(s, m, r, y, redemption, f, b) - pr, r or 0.05)


def duration(s, m, r, y, f, b):
    n, e, dsc = coupon(s, m, f)[2], coupon_days(s, m, f, b), days_to_coupon(s, m, f, b)
    c, g = 100 * r / f, 1 + y / f
    times = [k + dsc / e for k in range(n)]
    flows = [c + (100 if k == n - 1 else 0) for k in range(n)]
    worth = math.fsum(x / g**t for x, t in zip(flows, times, strict=True))
    return math.fsum(x * t / g**t for x, t in zip(flows, times, strict=True)) / worth / f


@scalar("DURATION", "nnnnn|n")
def duration_(s, m, r, y, f, b=0.0):
    return duration(math.floor(s), math.floor(m), r, y, int(f), basis_of(b)) if r >= 0 and y >= 0 else NUM


@scalar("MDURATION", "nnnnn|n")
def mduration(s, m, r, y, f, b=0.0):
    return duration(math.floor(s), math.floor(m), r, y, int(f), basis_of(b)) / (1 + y / int(f)) if r >= 0 and y >= 0 else NUM


def share(a, b, basis):
    return year_fraction(a, b, basis_of(basis)) if a < b else _num()


def _num():
    raise NUM


scalar("PRICEDISC", "nnnn|n")(lambda s, m, d, red, b=0.0: red - d * red * share(s, m, b))
scalar("DISC", "nnnn|n")(lambda s, m, pr, red, b=0.0: (red - pr) / red / share(s, m, b))
scalar("INTRATE", "nnnn|n")(lambda s, m, inv, red, b=0.0: (red - inv) / inv / share(s, m, b))
scalar("RECEIVED", "nnnn|n")(lambda s, m, inv, d, b=0.0: inv / (1 - d * share(s, m, b)))
scalar("YIELDDISC", "nnnn|n")(lambda s, m, pr, red, b=0.0: (red - pr) / pr / share(s, m, b))
scalar("ACCRINTM", "nnn|nn")(lambda i, s, r, par=1000.0, b=0.0: par * r * share(i, s, b))


@scalar("PRICEMAT", "nnnnn|n")
def pricemat(s, m, i, r, y, b=0.0):
    held, left = share(i, s, b) if i < s else 0.0, share(s, m, b)
    return (100 + share(i, m, b) * r * 100) / (1 + left * y) - held * r * 100


@scalar("YIELDMAT", "nnnnn|n")
def yieldmat(s, m, i, r, pr, b=0.0):
    held, left = share(i, s, b) if i < s else 0.0, share(s, m, b)
    return ((1 + share(i, m, b) * r) / (pr / 100 + held * r) - 1) / left


@scalar("ACCRINT", "nnnnnn|nb")
def accrint(issue, first, settlement, r, par, f, b=0.0, whole=True):
    if r <= 0 or par <= 0 or int(f) not in (1, 2, 4) or issue >= settlement:
        return NUM
    f, b, total = int(f), basis_of(b), 0.0
    step = 12 // f
    y, m, d = parts(first)
    k = 0
    begin = issue if whole or settlement <= first else first

    def date(n: int) -> int:
        yy, mm = divmod(y * 12 + m - 1 + n * step, 12)
        return serial_of(yy, mm + 1, min(d, month_length(yy, mm + 1)))

    while date(k) > begin:
        k -= 1
    while date(k) < settlement:
        a, e = max(date(k), begin), min(date(k + 1), settlement)
        if e > a:
            length = date(k + 1) - date(k) if b == 1 else (365 if b == 3 else 360) / f
            total += day_count(a, e, b) / length
        k += 1
    return par * r / f * total


def bill(s, m):
    d = math.floor(m) - math.floor(s)
    if d <= 0 or d > 366:
        raise NUM
    return d


scalar("TBILLPRICE", "nnn")(lambda s, m, d: 100 * (1 - d * bill(s, m) / 360))
scalar("TBILLYIELD", "nnn")(lambda s, m, pr: (100 - pr) / pr * 360 / bill(s, m))


@scalar("TBILLEQ", "nnn")
def tbilleq(s, m, d):
    n = bill(s, m)
    if n <= 182:
        return 365 * d / (360 - d * n)
    p = (100 - d * 100 * n / 360) / 100
    x = n / (366 if leap(parts(s)[0]) or n == 366 else 365)
    return (-2 * x + 2 * math.sqrt(x * x - (2 * x - 1) * (1 - 1 / p))) / (2 * x - 1)


def quasi(anchor: float, f: int, low: float, high: float) -> list[int]:
    """Coupon dates in steps from the anchor that reach from low to high."""
    y, m, d = parts(anchor)
    end, step = d == month_length(y, m), 12 // f

    def date(n: int) -> int:
        yy, mm = divmod(y * 12 + m - 1 + n * step, 12)
        return serial_of(yy, mm + 1, month_length(yy, mm + 1) if end else min(d, month_length(yy, mm + 1)))

    a = 0
    while date(a) > low:
        a -= 1
    while date(a + 1) <= low:
        a += 1
    out = [date(a)]
    while out[-1] < high:
        a += 1
        out.append(date(a))
    return out


def spans(dates: list[int], a: float, b: float, basis: int, f: int) -> float:
    """The time from a to b in coupon periods."""
    total = 0.0
    for low, high in zip(dates[:-1], dates[1:], strict=True):
        x, y = max(a, low), min(b, high)
        if y > x:
            total += day_count(x, y, basis) / (high - low if basis == 1 else (365 if basis == 3 else 360) / f)
    return total


def odd_last(s, m, last, r, basis, f):
    dates = quasi(last, f, last, m)
    return spans(dates, last, m, basis, f), spans(dates, last, s, basis, f), spans(dates, s, m, basis, f)


@scalar("ODDLPRICE", "nnnnnnn|n")
def oddlprice(s, m, last, r, y, red, f, b=0.0):
    f, b = int(f), basis_of(b)
    dc, a, dsc = odd_last(s, m, last, r, b, f)
    return (red + dc * 100 * r / f) / (1 + dsc * y / f) - a * 100 * r / f


@scalar("ODDLYIELD", "nnnnnnn|n")
def oddlyield(s, m, last, r, pr, red, f, b=0.0):
    f, b = int(f), basis_of(b)
    dc, a, dsc = odd_last(s, m, last, r, b, f)
    paid = pr + a * 100 * r / f
    return (red + dc * 100 * r / f - paid) / paid * f / dsc


def odd_first(s, m, issue, first, r, y, red, f, b):
    c, g = 100 * r / f, 1 + y / f
    dates = quasi(first, f, issue, first)
    dfc, a = spans(dates, issue, first, b, f), spans(dates, issue, s, b, f)
    to_first = spans(quasi(first, f, s, first), s, first, b, f)
    n = coupon(first, m, f)[2] if first < m else 0
    out = red / g ** (n + to_first) + c * dfc / g**to_first - c * a
    return out + math.fsum(c / g ** (k + to_first) for k in range(1, n + 1))


@scalar("ODDFPRICE", "nnnnnnnn|n")
def oddfprice(s, m, issue, first, r, y, red, f, b=0.0):
    return odd_first(s, m, issue, first, r, y, red, int(f), basis_of(b)) if m > first > s > issue else NUM


@scalar("ODDFYIELD", "nnnnnnnn|n")
def oddfyield(s, m, issue, first, r, pr, red, f, b=0.0):
    if not m > first > s > issue:
        return NUM
    return solve(lambda y: odd_first(s, m, issue, first, r, y, red, int(f), basis_of(b)) - pr, r or 0.05)


assert days_360
