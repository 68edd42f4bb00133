"""Special functions and distributions, from series and continued fractions."""

from __future__ import annotations

import math
from statistics import NormalDist

from .registry import scalar
from .values import DIV0, NA, NUM

NORMAL = NormalDist()


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    return 1 - gamma_fraction(a, x) * front


def gamma_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def gamma_q(a: float, x: float) -> float:
    if x < a + 1:
        return 1 - gamma_p(a, x)
    return gamma_fraction(a, x) * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * beta_fraction(b, a, 1 - x) / b
    return front * beta_fraction(a, b, x) / a


def beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def inverse(cdf, p: float, low: float, high: float) -> float:
    """Where a growing function reaches p, by bisection; high is widened as needed."""
    while cdf(high) < p and high < 1e300:
        low, high = high, high * 2 + 1
    for _ in range(400):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def positive(*values) -> None:
    if any(v <= 0 for v in values):
        raise NUM


def probability(p: float, open_: bool = True) -> None:
    if not (0 < p < 1 if open_ else 0 <= p <= 1):
        raise NUM


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_pdf(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


@scalar("NORM.DIST NORMDIST", "nnnb")
def norm_dist(x, mean, dev, cumulative):
    positive(dev)
    z = (x - mean) / dev
    return norm_cdf(z) if cumulative else norm_pdf(z) / dev


@scalar("NORM.S.DIST NORMSDIST", "n|b")
def norm_s_dist(z, cumulative=True):
    return norm_cdf(z) if cumulative else norm_pdf(z)


@scalar("NORM.INV NORMINV", "nnn")
def norm_inv(p, mean, dev):
    probability(p)
    positive(dev)
    return mean + dev * normal_quantile(p)


def normal_quantile(p: float) -> float:
    z = NORMAL.inv_cdf(p)
    for _ in range(2):  # to the last bits
        z -= (norm_cdf(z) - p) / norm_pdf(z)
    return z


@scalar("NORM.S.INV NORMSINV", "n")
def norm_s_inv(p):
    probability(p)
    return normal_quantile(p)


scalar("GAUSS", "n")(lambda z: norm_cdf(z) - 0.5)
scalar("PHI", "n")(norm_pdf)


@scalar("CONFIDENCE CONFIDENCE.NORM", "nnn")
def confidence(alpha, dev, size):
    probability(alpha)
    positive(dev)
    return normal_quantile(1 - alpha / 2) * dev / math.sqrt(int(size)) if size >= 1 else NUM


@scalar("CONFIDENCE.T", "nnn")
def confidence_t(alpha, dev, size):
    probability(alpha)
    positive(dev)
    return DIV0 if int(size) == 1 else t_inv_2t(alpha, int(size) - 1) * dev / math.sqrt(int(size))


@scalar("LOGNORM.DIST LOGNORMDIST", "nnn|b")
def lognorm_dist(x, mean, dev, cumulative=True):
    positive(x, dev)
    z = (math.log(x) - mean) / dev
    return norm_cdf(z) if cumulative else norm_pdf(z) / (dev * x)


@scalar("LOGNORM.INV LOGINV", "nnn")
def lognorm_inv(p, mean, dev):
    return math.exp(norm_inv(p, mean, dev))


@scalar("GAMMA", "n")
def gamma(x):
    return NUM if x <= 0 and x == int(x) else math.gamma(x)


@scalar("GAMMALN GAMMALN.PRECISE", "n")
def gammaln(x):
    positive(x)
    return math.lgamma(x)


@scalar("GAMMA.DIST GAMMADIST", "nnnb")
def gamma_dist(x, alpha, beta, cumulative):
    positive(alpha, beta)
    if x < 0:
        return NUM
    if cumulative:
        return gamma_p(alpha, x / beta)
    if x == 0:
        return 1 / beta if alpha == 1 else 0.0 if alpha > 1 else NUM
    return math.exp((alpha - 1) * math.log(x) - x / beta - alpha * math.log(beta) - math.lgamma(alpha))


@scalar("GAMMA.INV GAMMAINV", "nnn")
def gamma_inv(p, alpha, beta):
    positive(alpha, beta)
    if not 0 <= p < 1:
        return NUM
    return inverse(lambda x: gamma_p(alpha, x), p, 0.0, alpha + 10) * beta if p else 0.0


@scalar("CHISQ.DIST", "nnb")
def chisq_dist(x, d, cumulative):
    return gamma_dist(x, int(d) / 2, 2.0, cumulative)


@scalar("CHISQ.DIST.RT CHIDIST", "nn")
def chisq_dist_rt(x, d):
    return NUM if x < 0 or d < 1 else gamma_q(int(d) / 2, x / 2) if x else 1.0


@scalar("CHISQ.INV", "nn")
def chisq_inv(p, d):
    return NUM if d < 1 else gamma_inv(p, int(d) / 2, 2.0)


@scalar("CHISQ.INV.RT CHIINV", "nn")
def chisq_inv_rt(p, d):
    if not 0 < p <= 1 or d < 1:
        return NUM
    return inverse(lambda x: -gamma_q(int(d) / 2, x / 2) if x else -1.0, -p, 0.0, d + 10)


def t_cdf(x: float, d: int) -> float:
    tail = 0.5 * beta_i(d / 2, 0.5, d / (d + x * x))
    return 1 - tail if x > 0 else tail


@scalar("T.DIST", "nnb")
def t_dist(x, d, cumulative):
    d = int(d)
    if d < 1:
        return NUM
    if cumulative:
        return t_cdf(x, d)
    return math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2)) / math.sqrt(d * math.pi) * (1 + x * x / d) ** (-(d + 1) / 2)


@scalar("T.DIST.RT", "nn")
def t_dist_rt(x, d):
    return NUM if d < 1 else t_cdf(-x, int(d))


@scalar("T.DIST.2T", "nn")
def t_dist_2t(x, d):
    return NUM if x < 0 or d < 1 else 2 * t_cdf(-x, int(d))


@scalar("TDIST", "nnn")
def tdist(x, d, tails):
    return NUM if x < 0 or d < 1 or int(tails) not in (1, 2) else int(tails) * t_cdf(-x, int(d))


@scalar("T.INV", "nn")
def t_inv(p, d):
    probability(p)
    if d < 1:
        return NUM
    return -t_inv_2t(2 * p, d) if p < 0.5 else t_inv_2t(2 * (1 - p), d) if p > 0.5 else 0.0


@scalar("T.INV.2T TINV", "nn")
def t_inv_2t(p, d):
    d = int(d)
    if not 0 < p <= 1 or d < 1:
        raise NUM
    return inverse(lambda x: -2 * t_cdf(-x, d), -p, 0.0, 10.0)


def f_cdf(x: float, a: int, b: int) -> float:
    return beta_i(a / 2, b / 2, a * x / (a * x + b)) if x > 0 else 0.0


def f_tail(x: float, a: int, b: int) -> float:
    return beta_i(b / 2, a / 2, b / (a * x + b)) if x > 0 else 1.0


@scalar("F.DIST", "nnnb")
def f_dist(x, a, b, cumulative):
    a, b = int(a), int(b)
    if x < 0 or a < 1 or b < 1:
        return NUM
    if cumulative:
        return f_cdf(x, a, b)
    return math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2) + a / 2 * math.log(a / b) + (a / 2 - 1) * math.log(x) - (a + b) / 2 * math.log1p(a * x / b)) if x else 0.0


@scalar("F.DIST.RT FDIST", "nnn")
def f_dist_rt(x, a, b):
    return NUM if x < 0 or a < 1 or b < 1 else f_tail(x, int(a), int(b))


@scalar("F.INV", "nnn")
def f_inv(p, a, b):
    if not 0 <= p < 1 or a < 1 or b < 1:
        return NUM
    return inverse(lambda x: f_cdf(x, int(a), int(b)), p, 0.0, 10.0) if p else 0.0


@scalar("F.INV.RT FINV", "nnn")
def f_inv_rt(p, a, b):
    if not 0 < p <= 1 or a < 1 or b < 1:
        return NUM
    return inverse(lambda x: -f_tail(x, int(a), int(b)), -p, 0.0, 10.0)


@scalar("BETA.DIST", "nnnb|nn")
def beta_dist(x, a, b, cumulative, low=0.0, high=1.0):
    positive(a, b)
    if not low <= x <= high or low == high:
        return NUM
    z = (x - low) / (high - low)
    if cumulative:
        return beta_i(a, b, z)
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(z) + (b - 1) * math.log1p(-z)) / (high - low)


@scalar("BETADIST", "nnn|nn")
def betadist(x, a, b, low=0.0, high=1.0):
    return beta_dist(x, a, b, True, low, high)


@scalar("BETA.INV BETAINV", "nnn|nn")
def beta_inv(p, a, b, low=0.0, high=1.0):
    positive(a, b)
    if not 0 < p <= 1:
        return NUM
    return low + (high - low) * inverse(lambda z: beta_i(a, b, z), p, 0.0, 1.0)


@scalar("EXPON.DIST EXPONDIST", "nnb")
def expon_dist(x, rate, cumulative):
    positive(rate)
    return NUM if x < 0 else -math.expm1(-rate * x) if cumulative else rate * math.exp(-rate * x)


@scalar("WEIBULL.DIST WEIBULL", "nnnb")
def weibull(x, a, b, cumulative):
    positive(a, b)
    if x < 0:
        return NUM
    return -math.expm1(-((x / b) ** a)) if cumulative else a / b**a * x ** (a - 1) * math.exp(-((x / b) ** a))


@scalar("POISSON.DIST POISSON", "nnb")
def poisson(x, mean, cumulative):
    k = int(x)
    if k < 0 or mean < 0:
        return NUM
    if cumulative:
        return gamma_q(k + 1, mean) if mean else 1.0
    return math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean else float(k == 0)


def binom_pmf(k: int, n: int, p: float) -> float:
    if p in (0, 1):
        return float(k == n * p)
    if n <= 1000:
        return math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


@scalar("BINOM.DIST BINOMDIST", "nnnb")
def binom_dist(k, n, p, cumulative):
    k, n = int(k), int(n)
    probability(p, False)
    if not 0 <= k <= n:
        return NUM
    return math.fsum(binom_pmf(i, n, p) for i in range(k + 1)) if cumulative else binom_pmf(k, n, p)


@scalar("BINOM.DIST.RANGE", "nnn|n")
def binom_range(n, p, low, high=None):
    n, low = int(n), int(low)
    high = low if high is None else int(high)
    probability(p, False)
    return math.fsum(binom_pmf(i, n, p) for i in range(low, high + 1)) if 0 <= low <= high <= n else NUM


@scalar("BINOM.INV CRITBINOM", "nnn")
def binom_inv(n, p, alpha):
    n, total = int(n), 0.0
    probability(p)
    probability(alpha)
    for k in range(n + 1):
        total += binom_pmf(k, n, p)
        if total >= alpha - 1e-15:
            return float(k)
    return float(n)


@scalar("NEGBINOM.DIST NEGBINOMDIST", "nnn|b")
def negbinom(f, s, p, cumulative=False):
    f, s = int(f), int(s)
    probability(p, False)
    if f < 0 or s < 1:
        return NUM
    return beta_i(s, f + 1, p) if cumulative else math.comb(f + s - 1, s - 1) * p**s * (1 - p) ** f


@scalar("HYPGEOM.DIST HYPGEOMDIST", "nnnn|b")
def hypgeom(k, draws, good, total, cumulative=False):
    k, draws, good, total = int(k), int(draws), int(good), int(total)
    if not 0 <= draws <= total or not 0 <= good <= total or k < 0 or k > min(draws, good):
        return NUM
    one = lambda i: math.comb(good, i) * math.comb(total - good, draws - i) / math.comb(total, draws) if draws - i <= total - good else 0.0
    return math.fsum(one(i) for i in range(k + 1)) if cumulative else one(k)


@scalar("ERF ERF.PRECISE", "n|n")
def erf(a, b=None):
    return math.erf(a) if b is None else math.erf(b) - math.erf(a)


scalar("ERFC ERFC.PRECISE", "n")(math.erfc)


@scalar("FISHER", "n")
def fisher(x):
    return math.atanh(x) if -1 < x < 1 else NUM


scalar("FISHERINV", "n")(math.tanh)


@scalar("STANDARDIZE", "nnn")
def standardize(x, mean, dev):
    positive(dev)
    return (x - mean) / dev


def integrate(f, a: float, b: float, n: int = 4000) -> float:
    """Simpson's rule."""
    h = (b - a) / n
    return h / 3 * math.fsum(f(a + i * h) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1))


def bessel(kind: str, x: float, n: float):
    """Bessel functions of whole order from their integral forms."""
    n = int(n)
    if n < 0:
        return NUM
    if kind == "J":
        return integrate(lambda t: math.cos(n * t - x * math.sin(t)), 0, math.pi) / math.pi
    if kind == "I":
        return integrate(lambda t: math.exp(x * math.cos(t)) * math.cos(n * t), 0, math.pi) / math.pi
    if x <= 0:
        return NUM
    top = math.asinh(750 / max(x, 1e-9))
    if kind == "K":
        return integrate(lambda t: math.exp(-x * math.cosh(t)) * math.cosh(n * t) if x * math.cosh(t) < 700 else 0.0, 0, top, 20000)
    second = integrate(lambda t: (math.exp(n * t) + (-1) ** n * math.exp(-n * t)) * math.exp(-x * math.sinh(t)), 0, top, 40000)
    return (integrate(lambda t: math.sin(x * math.sin(t) - n * t), 0, math.pi) - second) / math.pi


for _k in "JIKY":
    scalar(f"BESSEL{_k}", "nn")(lambda x, n, kind=_k: bessel(kind, x, n))


# Complex numbers are text such as 3+4i.
def parse_complex(s) -> tuple[complex, str]:
    if isinstance(s, (int, float)) and not isinstance(s, bool):
        return complex(s), "i"
    s = str(s or "0").strip()
    unit = s[-1] if s[-1:] in ("i", "j") else ""
    if not unit:
        return complex(float(s)), "i"
    body = s[:-1]
    k = max((p for p in range(1, len(body)) if body[p] in "+-" and body[p - 1] not in "eE"), default=0)
    real, imaginary = (body[:k], body[k:]) if k else ("", body)
    return complex(float(real or 0), float(imaginary + "1" if imaginary in ("", "+", "-") else imaginary)), unit


def show_complex(z: complex, unit: str = "i"):
    from .values import general

    if not (math.isfinite(z.real) and math.isfinite(z.imag)):
        return NUM
    re_, im = general(z.real), general(z.imag)
    if im == "0":
        return re_
    part = ("" if im == "1" else "-" if im == "-1" else im) + unit
    return part if re_ == "0" else f"{re_}{'' if part.startswith('-') else '+'}{part}"


@scalar("COMPLEX", "nn|t")
def complex_(a, b, unit="i"):
    from .values import VALUE

    return show_complex(complex(a, b), unit or "i") if unit in ("i", "j", "") else VALUE


def of_complex(names: str, f) -> None:
    def body(s):
        z, unit = parse_complex(s)
        out = f(z)
        return show_complex(out, unit) if isinstance(out, complex) else out

    scalar(names, "a")(body)


import cmath  # noqa: E402

of_complex("IMREAL", lambda z: z.real)
of_complex("IMAGINARY", lambda z: z.imag)
of_complex("IMABS", abs)
of_complex("IMARGUMENT", lambda z: cmath.phase(z) if z else DIV0)
of_complex("IMCONJUGATE", lambda z: z.conjugate())
for _name, _f in (("IMEXP", cmath.exp), ("IMLN", cmath.log), ("IMLOG10", cmath.log10), ("IMSQRT", cmath.sqrt), ("IMSIN", cmath.sin), ("IMCOS", cmath.cos), ("IMSINH", cmath.sinh), ("IMCOSH", cmath.cosh), ("IMTAN", cmath.tan)):
    of_complex(_name, _f)
of_complex("IMLOG2", lambda z: cmath.log(z) / math.log(2))
of_complex("IMCOT", lambda z: 1 / cmath.tan(z))
of_complex("IMSEC", lambda z: 1 / cmath.cos(z))
of_complex("IMCSC", lambda z: 1 / cmath.sin(z))
of_complex("IMSECH", lambda z: 1 / cmath.cosh(z))
of_complex("IMCSCH", lambda z: 1 / cmath.sinh(z))


@scalar("IMPOWER", "an")
def impower(s, n):
    z, unit = parse_complex(s)
    return show_complex(cmath.rect(abs(z) ** n, cmath.phase(z) * n) if z else (0j if n > 0 else _fail()), unit)


def _fail():
    raise NUM


@scalar("IMSUB", "aa")
def imsub(a, b):
    return show_complex(parse_complex(a)[0] - parse_complex(b)[0], parse_complex(a)[1])


@scalar("IMDIV", "aa")
def imdiv(a, b):
    return show_complex(parse_complex(a)[0] / parse_complex(b)[0], parse_complex(a)[1])


def complex_all(values, product: bool):
    z, unit = (1 + 0j if product else 0j), "i"
    for v in values:
        w, unit = parse_complex(v)
        z = z * w if product else z + w
    return show_complex(z, unit)


#: Units by kind with their size in the first one's terms.
UNITS = {
    "mass": {"g": 1.0, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.66053100460465e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "uk_cwt": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "length": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.46073047258e15, "pc": 3.08567758128155e16, "Picapt": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.34721869444},
    "time": {"sec": 1.0, "s": 1.0, "mn": 60.0, "min": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.75729316836, "Torr": 133.322368421053},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176487e-19, "ev": 1.602176487e-19, "HPh": 2684519.53769617, "hh": 2684519.53769617, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1.0, "w": 1.0, "HP": 745.69987158227, "h": 745.69987158227, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "tsp": 0.00492892159375, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "uk_qt": 1.1365225, "gal": 3.785411784, "uk_gal": 4.54609, "m3": 1000.0, "in3": 0.016387064, "ft3": 28.316846592, "yd3": 764.554857984, "barrel": 158.987294928, "bushel": 35.23907016688},
    "area": {"m2": 1.0, "uk_acre": 4046.8564224, "us_acre": 4046.87260987425, "ar": 100.0, "ft2": 0.09290304, "ha": 10000.0, "in2": 0.00064516, "mi2": 2589988.110336, "Morgen": 2500.0, "yd2": 0.83612736},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"m/s": 1.0, "m/sec": 1.0, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.514773333333333},
    "temperature": {"C": 1.0, "cel": 1.0, "F": 1.0, "fah": 1.0, "K": 1.0, "kel": 1.0, "Rank": 1.0, "Reau": 1.0},
}
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "e": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
BINARY = {"Yi": 2.0**80, "Zi": 2.0**70, "Ei": 2.0**60, "Pi": 2.0**50, "Ti": 2.0**40, "Gi": 2.0**30, "Mi": 2.0**20, "ki": 2.0**10}
METRIC = set("g u m ang ly pc s sec Pa p atm at mmHg Torr N dyn dy pond J e c cal eV ev Wh wh W w T ga l L lt m2 m3 ar bit byte m/s m/h K kel".split())


def unit(name: str) -> tuple[str, str, float]:
    for kind, units in UNITS.items():
        if name in units:
            return kind, name, units[name]
    for prefixes in (BINARY, PREFIXES):
        for p, size in prefixes.items():
            rest = name.removeprefix(p)
            if rest != name and rest in METRIC and (prefixes is PREFIXES or rest in ("bit", "byte")):
                kind, base, one = unit(rest)
                return kind, base, one * size ** (2 if rest == "m2" else 3 if rest == "m3" else 1)
    raise NA


@scalar("CONVERT", "ntt")
def convert(x, a, b):
    kind, from_, one = unit(a)
    other, to, two = unit(b)
    if kind != other:
        return NA
    if kind != "temperature":
        return x * one / two
    x *= one
    kelvin = {"C": lambda t: t + 273.15, "cel": lambda t: t + 273.15, "F": lambda t: (t + 459.67) / 1.8, "fah": lambda t: (t + 459.67) / 1.8, "Rank": lambda t: t / 1.8, "Reau": lambda t: t * 1.25 + 273.15}.get(from_, lambda t: t)(x)
    return {"C": lambda t: t - 273.15, "cel": lambda t: t - 273.15, "F": lambda t: t * 1.8 - 459.67, "fah": lambda t: t * 1.8 - 459.67, "Rank": lambda t: t * 1.8, "Reau": lambda t: (t - 273.15) / 1.25}.get(to, lambda t: t)(kelvin) / two
