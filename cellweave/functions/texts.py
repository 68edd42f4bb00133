"""Text, number formats, regular expressions, JSON and URLs."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from functools import lru_cache
from urllib.parse import quote

from .dates import parts, read_value
from .maths import away
from .registry import ranged, scalar
from .values import CALC, ERRORS, MAX_TEXT, MISSING, NA, NUM, VALUE, Arr, Err, arr, boolean, general, num, parse_number, single, text, wildcard


def limited(s: str):
    return s if len(s) <= MAX_TEXT else VALUE


@ranged("CONCAT CONCATENATE")
def concat(args):
    out = []
    for a in args:
        for v in arr(a).flat():
            out.append(text(v))
    return limited("".join(out))


scalar("LEN LENB", "t")(len)
scalar("UPPER", "t")(str.upper)
scalar("LOWER", "t")(str.lower)
scalar("TRIM", "t")(lambda s: re.sub(" +", " ", s.strip(" ")))
scalar("PROPER", "t")(lambda s: re.sub(r"[^\W\d_]+", lambda m: m[0][0].upper() + m[0][1:].lower(), s))
scalar("CLEAN", "t")(lambda s: "".join(c for c in s if ord(c) >= 32))
scalar("EXACT", "tt")(lambda a, b: a == b)
scalar("LEFT LEFTB", "t|n")(lambda s, n=1.0: s[: int(n)] if n >= 0 else VALUE)
scalar("RIGHT RIGHTB", "t|n")(lambda s, n=1.0: (s[-int(n) :] if int(n) else "") if n >= 0 else VALUE)
scalar("MID MIDB", "tnn")(lambda s, a, n: s[int(a) - 1 : int(a) - 1 + int(n)] if a >= 1 and n >= 0 else VALUE)
scalar("REPT", "tn")(lambda s, n: VALUE if n < 0 or len(s) * int(n) > MAX_TEXT else s * int(n))
scalar("CHAR", "n")(lambda x: chr(int(x)) if 1 <= x < 256 else VALUE)
scalar("UNICHAR", "n")(lambda x: chr(int(x)) if 1 <= x < 0x110000 and not 0xD800 <= x < 0xE000 else VALUE)
scalar("CODE", "t")(lambda s: VALUE if not s else float(ord(s[0])) if ord(s[0]) < 256 else 63.0)
scalar("UNICODE", "t")(lambda s: float(ord(s[0])) if s else VALUE)
scalar("T", "a")(lambda v: v if isinstance(v, (str, Err)) else "")
scalar("ENCODEURL", "t")(lambda s: quote(s, safe="-_.~"))
scalar("PHONETIC", "t")(lambda s: s)


@scalar("FIND FINDB", "tt|n")
def find(needle, hay, start=1.0):
    if start < 1 or start > len(hay) + 1:
        return VALUE
    k = hay.find(needle, int(start) - 1)
    return k + 1.0 if k >= 0 else VALUE


@scalar("SEARCH SEARCHB", "tt|n")
def search(needle, hay, start=1.0):
    if start < 1 or start > len(hay) + 1:
        return VALUE
    p = wildcard(needle)
    m = re.compile(p.pattern, re.I | re.S).search(hay, int(start) - 1)
    return m.start() + 1.0 if m else VALUE


@scalar("SUBSTITUTE", "ttt|n")
def substitute(s, old, new, k=None):
    if not old:
        return s
    if k is None:
        return limited(s.replace(old, new))
    if k < 1:
        return VALUE
    at = -len(old)
    for _ in range(int(k)):
        at = s.find(old, at + len(old))
        if at < 0:
            return s
    return s[:at] + new + s[at + len(old) :]


@scalar("REPLACE REPLACEB", "tnnt")
def replace(s, a, n, new):
    return s[: int(a) - 1] + new + s[int(a) - 1 + int(n) :] if a >= 1 and n >= 0 else VALUE


@scalar("VALUE", "a")
def value(v):
    if isinstance(v, Err):
        return v
    if isinstance(v, bool):
        return VALUE
    if not isinstance(v, str):
        return num(v)
    got = read_value(v)
    return VALUE if got is None else got


@scalar("NUMBERVALUE", "t|tt")
def numbervalue(s, decimal=".", group=","):
    s = "".join(s.split())
    if not s:
        return 0.0
    if not decimal or decimal[0] == group[:1]:
        return VALUE
    head, dot, tail = s.partition(decimal[0])
    if decimal[0] in tail or (group and group[0] in tail):
        return VALUE
    got = parse_number(head.replace(group[0], "") + ("." + tail if dot else "") if group else head + ("." + tail if dot else ""))
    return VALUE if got is None else got


def grouped(x: float, digits: int, commas: bool = True) -> str:
    if digits < 0:
        x, digits = away(x / 10**-digits) * 10**-digits, 0
    x = away(abs(x) * 10**digits) / 10**digits * (1 if x >= 0 else -1)
    out = f"{x:,.{digits}f}" if commas else f"{x:.{digits}f}"
    return out.lstrip("-") if float(out.replace(",", "")) == 0 else out


scalar("FIXED", "n|nb")(lambda x, d=2.0, plain=False: grouped(x, int(d), not plain) if d <= 127 else VALUE)


@scalar("DOLLAR", "n|n")
def dollar(x, d=2.0):
    s = grouped(abs(x), int(d))
    return f"(${s})" if x < 0 and float(s.replace(",", "")) else f"${s}"


@ranged("TEXTJOIN")
def textjoin(args):
    if len(args) < 3:
        return VALUE
    delimiters = [text(v) for v in arr(args[0]).flat()]
    skip, out = boolean(args[1]), []
    for a in args[2:]:
        for v in arr(a).flat():
            s = text(v)
            if s or not skip:
                out.append(s)
    joined = ""
    for k, s in enumerate(out):
        joined += (delimiters[(k - 1) % len(delimiters)] if k else "") + s
    return limited(joined)


def around(s, delimiter, instance, mode, to_end, missing, before):
    if not instance or not delimiter:
        return VALUE
    spots = [m.span() for m in re.finditer(re.escape(delimiter), s, re.I if mode else 0)]
    if to_end:
        spots = [*spots, (len(s), len(s))] if instance > 0 else [(0, 0), *spots]
    k = int(instance)
    if abs(k) > len(spots):
        return NA if missing is None else missing
    a, b = spots[k - 1] if k > 0 else spots[k]
    return s[:a] if before else s[b:]


scalar("TEXTBEFORE", "tt|nnna")(lambda s, d, k=1.0, m=0.0, e=0.0, x=None: around(s, d, k, m, e, x, True))
scalar("TEXTAFTER", "tt|nnna")(lambda s, d, k=1.0, m=0.0, e=0.0, x=None: around(s, d, k, m, e, x, False))


def split_by(s: str, delimiters: list[str], ignore: bool, fold: bool) -> list[str]:
    out = re.split("|".join(re.escape(d) for d in sorted(delimiters, key=len, reverse=True)), s, flags=re.I if fold else 0)
    return [x for x in out if x] if ignore else out


@ranged("TEXTSPLIT")
def textsplit(args):
    args = [*args, *[MISSING] * (6 - len(args))]
    s = text(args[0])
    names = lambda a: [] if a is MISSING or a is None else [text(v) for v in arr(a).flat()]
    cols, rows = names(args[1]), names(args[2])
    if not cols and not rows or "" in cols or "" in rows:
        return VALUE
    ignore, fold = boolean(args[3]), bool(num(args[4]))
    pad = NA if args[5] is MISSING else single(args[5])
    lines = split_by(s, rows, ignore, fold) if rows else [s]
    cells = [split_by(line, cols, ignore, fold) if cols else [line] for line in lines]
    w = max((len(c) for c in cells), default=0)
    return Arr([c + [pad] * (w - len(c)) for c in cells]) if w else CALC


def shown(v, strict: bool) -> str:
    if isinstance(v, Err):
        return v.code
    if strict and isinstance(v, str):
        return '"' + v.replace('"', '""') + '"'
    return text(v)


@ranged("ARRAYTOTEXT")
def arraytotext(args):
    strict = len(args) > 1 and num(args[1]) == 1
    a = arr(args[0])
    if strict:
        return "{" + ";".join(",".join(shown(v, True) for v in row) for row in a.rows) + "}"
    return ", ".join(shown(v, False) for v in a.flat())


@ranged("VALUETOTEXT")
def valuetotext(args):
    return shown(single(args[0]), len(args) > 1 and num(args[1]) == 1)


# Widths: ASCII and the full-width forms 0xFEE0 above it; katakana in three fixed rows.
WIDE_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
VOICED = dict(zip("カキクケコサシスセソタチツテトハヒフヘホウ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ", strict=True))
HALF_VOICED = dict(zip("ハヒフヘホ", "パピプペポ", strict=True))


@scalar("DBCS JIS", "t")
def dbcs(s):
    out = []
    for c in s:
        if c == " ":
            out.append("\u3000")
        elif 0x21 <= ord(c) <= 0x7E:
            out.append(chr(ord(c) + 0xFEE0))
        elif 0xFF61 <= ord(c) <= 0xFF9F:
            w = WIDE_KANA[ord(c) - 0xFF61]
            if out and w in "゛゜" and out[-1] in (VOICED if w == "゛" else HALF_VOICED):
                out[-1] = (VOICED if w == "゛" else HALF_VOICED)[out[-1]]
            else:
                out.append(w)
        else:
            out.append(c)
    return "".join(out)


@scalar("ASC", "t")
def asc(s):
    voiced, half = {v: k for k, v in VOICED.items()}, {v: k for k, v in HALF_VOICED.items()}
    one = lambda c: chr(0xFF61 + WIDE_KANA.index(c)) if c in WIDE_KANA else c
    out = []
    for c in s:
        if c == "\u3000":
            out.append(" ")
        elif 0xFF01 <= ord(c) <= 0xFF5E:
            out.append(chr(ord(c) - 0xFEE0))
        elif c in voiced:
            out.append(one(voiced[c]) + "\uff9e")
        elif c in half:
            out.append(one(half[c]) + "\uff9f")
        else:
            out.append(one(c))
    return "".join(out)


THAI = "๐๑๒๓๔๕๖๗๘๙"
scalar("THAIDIGIT", "t")(lambda s: s.translate({48 + k: c for k, c in enumerate(THAI)}))
scalar("ISTHAIDIGIT", "t")(lambda s: bool(s) and all(c in THAI for c in s if c.isdigit()) and any(c in THAI for c in s))
scalar("ROUNDBAHTUP", "n")(math.ceil)
scalar("ROUNDBAHTDOWN", "n")(math.trunc)
#: Thai words for digits and powers of ten.
THAI_DIGITS = "ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า".split()
THAI_POWERS = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]


def thai_number(n: int) -> str:
    if n >= 1_000_000:
        return thai_number(n // 1_000_000) + "ล้าน" + (thai_number(n % 1_000_000) if n % 1_000_000 else "")
    out, digits = "", str(n)
    for k, c in enumerate(digits):
        p, d = len(digits) - 1 - k, int(c)
        if not d:
            continue
        if p == 1 and d == 1:
            out += "สิบ"
        elif p == 1 and d == 2:
            out += "ยี่สิบ"
        elif p == 0 and d == 1 and n > 10:
            out += "เอ็ด"
        else:
            out += THAI_DIGITS[d] + THAI_POWERS[p]
    return out or THAI_DIGITS[0]


@scalar("BAHTTEXT", "n")
def bahttext(x):
    satang = int(away(abs(x) * 100))
    baht, satang = divmod(satang, 100)
    out = "ลบ" if x < 0 else ""
    if baht or not satang:
        out += thai_number(baht) + "บาท"
    return out + (thai_number(satang) + "สตางค์" if satang else "ถ้วน")


# Regular expressions.
def pattern_of(p: str, fold) -> re.Pattern:
    try:
        return re.compile(p, re.I if fold else 0)
    except re.error as e:
        raise VALUE from e


scalar("REGEXTEST", "tt|n")(lambda s, p, f=0.0: pattern_of(p, f).search(s) is not None)


@scalar("REGEXEXTRACT", "tt|nn")
def regexextract(s, p, mode=0.0, fold=0.0):
    hits = list(pattern_of(p, fold).finditer(s))
    if not hits:
        return NA
    if mode == 1:
        return Arr([[m[0]] for m in hits])
    if mode == 2:
        return Arr([[g or "" for g in hits[0].groups()]]) if hits[0].groups() else VALUE
    return hits[0][0] if mode == 0 else VALUE


@scalar("REGEXREPLACE", "ttt|nn")
def regexreplace(s, p, new, k=0.0, fold=0.0):
    compiled = pattern_of(p, fold)
    new = re.sub(r"\$(\d+)", r"\\g<\1>", new.replace("\\", "\\\\"))
    if not k:
        return limited(compiled.sub(new, s))
    hits = list(compiled.finditer(s))
    n = int(k) - 1 if k > 0 else len(hits) + int(k)
    if not 0 <= n < len(hits):
        return s
    m = hits[n]
    return limited(s[: m.start()] + m.expand(new) + s[m.end() :])


# JSON.
@scalar("PARSEJSON", "t|tb")
def parsejson(s, path="", flatten=False):
    if len(s) > MAX_TEXT:
        return VALUE
    try:
        tree = json.loads(s, parse_int=float)
    except (ValueError, RecursionError):
        return VALUE
    for step in re.findall(r"[^.\[\]]+|\[\d+\]", re.sub(r"^\$\.?", "", path)):
        if step.startswith("["):
            k = int(step[1:-1])
            if not isinstance(tree, list) or k >= len(tree):
                return NA
            tree = tree[k]
        elif isinstance(tree, dict) and step in tree:
            tree = tree[step]
        elif isinstance(tree, list) and step.isdigit() and int(step) < len(tree):
            tree = tree[int(step)]
        else:
            return NA
    return grid_of(tree, flatten)


def cell_of(v):
    if isinstance(v, (dict, list)):
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def grid_of(tree, flatten: bool):
    if isinstance(tree, dict):
        return Arr([[k, cell_of(v)] for k, v in tree.items()]) if tree else CALC
    if isinstance(tree, list):
        if not tree:
            return CALC
        if flatten and all(isinstance(x, dict) for x in tree):
            names = list(dict.fromkeys(k for x in tree for k in x))
            return Arr([names] + [[cell_of(x.get(k)) for k in names] for x in tree])
        if all(isinstance(x, list) for x in tree):
            w = max(len(x) for x in tree)
            return Arr([[cell_of(v) for v in x] + [None] * (w - len(x)) for x in tree])
        return Arr([[cell_of(x)] for x in tree])
    return cell_of(tree)


# Number formats.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
PIECE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|General|AM/PM|A/P|[yY]+|[mM]+|[dD]+|[hH]+|[sS]+(?:\.0+)?|E[+-]|e[+-]|.', re.S)


@lru_cache(1024)
def sections(code: str) -> list[list[str]]:
    out, own = [], []
    for p in PIECE.findall(code):
        if p == ";":
            out.append(own)
            own = []
        else:
            own.append(p)
    return [*out, own]


def is_date(pieces: list[str]) -> bool:
    return has_date(tuple(pieces))


@lru_cache(1024)
def has_date(pieces: tuple[str, ...]) -> bool:
    return any(p[0] in "yYdDhHsSmM" and p[0] not in '"\\' for p in pieces if p not in ("General",)) or any(re.fullmatch(r"\[[hms]+\]", p, re.I) for p in pieces) or "AM/PM" in pieces


def condition(pieces: list[str]):
    for p in pieces:
        if p[0] != "[":
            continue
        m = re.fullmatch(r"\[(<=|>=|<>|<|>|=)(-?[\d.]+)\]", p)
        if m:
            v = float(m[2])
            return {"<": lambda x: x < v, ">": lambda x: x > v, "=": lambda x: x == v, "<=": lambda x: x <= v, ">=": lambda x: x >= v, "<>": lambda x: x != v}[m[1]]
    return None


def literal(p: str) -> str | None:
    if p.startswith('"'):
        return p[1:-1]
    if p.startswith("\\"):
        return p[1:]
    if p.startswith("_"):
        return " "
    if p.startswith("*"):
        return ""
    if p.startswith("["):
        m = re.match(r"\[\$([^\]-]*)", p)
        return m[1] if m else ""
    return None


@lru_cache(1024)
def plain(code: str) -> tuple[int, bool, int, int] | None:
    """Of a format of digits only, such as #,##0.00 or 00%: zeros before the point, whether thousands are parted, digits
    after the point, and the factor; None for other formats."""
    m = re.fullmatch(r"([#0](?:[#0,]*[#0])?)(?:\.(0+))?(%?)", code)
    if not m or not re.fullmatch("#*0*", m[1].replace(",", "")):
        return None
    return m[1].count("0"), "," in m[1], len(m[2] or ""), 100 if m[3] else 1


def render_plain(x: float, zeros: int, commas: bool, places: int, factor: int) -> str | None:
    """What render_number gives for a plain format; None for numbers too large to be rounded as such."""
    y = abs(x) * factor * 10**places
    if not y < 1e15:
        return None
    n = math.floor(y + 0.5)
    whole, rest = divmod(n, 10**places)
    s = (str(whole) if whole else "").rjust(zeros, "0")
    if commas and len(s) > 3:
        head = len(s) % 3
        s = ",".join([s[:head]] * bool(head) + [s[k : k + 3] for k in range(head, len(s), 3)])
    return ("-" if x < 0 and n else "") + s + ("." + str(rest).rjust(places, "0") if places else "") + ("%" if factor > 1 else "")


def render(v, code: str) -> str:
    """A value through a cell format."""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    shape = plain(code)
    if shape and not isinstance(v, str):
        out = render_plain(num(v), *shape)
        if out is not None:
            return out
    parts_ = sections(code)
    if isinstance(v, str):
        own = parts_[3] if len(parts_) > 3 else parts_[-1] if "@" in parts_[-1] else None
        if own is None:
            return v
        return "".join(v if p == "@" else literal(p) if literal(p) is not None else p for p in own)
    x = num(v)
    tests = [condition(p) for p in parts_[:2]]
    if any(tests):
        own = next((p for p, t in zip(parts_, tests, strict=False) if t and t(x)), parts_[min(len(parts_) - 1, sum(t is not None for t in tests))])
        sign = x < 0 and own is not parts_[0]
        return ("-" if sign else "") + render_number(abs(x), own)
    if len(parts_) == 1:
        return render_number(x, parts_[0], "-" if x < 0 else "")
    if x > 0 or (x == 0 and len(parts_) < 3):
        return render_number(x, parts_[0])
    if x < 0:
        return render_number(-x, parts_[1])
    return render_number(0.0, parts_[2])


def render_number(x: float, pieces: list[str], sign: str = "") -> str:
    if not pieces:
        return sign
    if is_date(pieces):
        return render_date(x, pieces)
    if "General" in pieces:
        return sign + "".join(general_width(abs(x)) if p == "General" else literal(p) if literal(p) is not None else p for p in pieces)
    x = abs(x)
    digits = [p for p in pieces if p in "0#?"]
    if not digits:
        return sign + "".join(text(x) if p == "@" else literal(p) if literal(p) is not None else p for p in pieces)
    x *= 100 ** pieces.count("%")
    if "/" in pieces:
        return sign + render_fraction(x, pieces)
    exp = next((k for k, p in enumerate(pieces) if p in ("E+", "E-", "e+", "e-")), None)
    last = max(k for k, p in enumerate(pieces) if p in "0#?" and (exp is None or k < exp))
    trailing = 0
    while last + 1 + trailing < len(pieces) and pieces[last + 1 + trailing] == ",":
        trailing += 1
    x /= 1000**trailing
    dot = next((k for k, p in enumerate(pieces) if p == "." and (exp is None or k < exp)), None)
    before = [k for k, p in enumerate(pieces) if p in "0#?" and (dot is None or k < dot) and (exp is None or k < exp)]
    after = [k for k, p in enumerate(pieces) if p in "0#?" and dot is not None and k > dot and (exp is None or k < exp)]
    power = 0
    if exp is not None and x:
        power = math.floor(math.log10(x))
        step = max(len(before), 1)
        power = math.floor(power / step) * step if step > 1 else power
        if away(x / 10.0**power * 10 ** len(after)) >= 10 ** (step + len(after)):
            power += step if step > 1 else 1
        x /= 10.0**power
    body = f"{away(x * 10 ** len(after)):.0f}" if x * 10 ** len(after) < 1e15 else f"{x * 10 ** len(after):.0f}"
    body = body.rjust(len(after) + 1, "0")
    whole, decimals = (body[: -len(after)], body[-len(after) :]) if after else (body, "")
    whole = whole.lstrip("0")
    commas = any(p == "," and before and before[0] < k < (before[-1] if before else 0) for k, p in enumerate(pieces))
    if all(c in "0" for c in whole + decimals) and sign and not power:
        sign = ""
    out, k_digit = {}, len(whole)
    need = len(before)
    shown_ = []
    for n, k in enumerate(reversed(before)):
        c = whole[-1 - n] if n < len(whole) else {"0": "0", "#": "", "?": " "}[pieces[k]]
        if n == need - 1 and len(whole) > need:
            rest = whole[: len(whole) - n]
            shown_ = [*reversed(rest)]
            out[k] = list(shown_)
        else:
            out[k] = [c]
    count = 0
    for k in reversed(before):
        made = []
        for c in out[k]:
            if c and commas and count and count % 3 == 0 and c != " ":
                made.append(",")
            made.append(c)
            count += bool(c)
        out[k] = "".join(reversed(made))
    tail = list(decimals)
    for k in reversed(after):
        n = after.index(k)
        if pieces[k] == "0" or any(c != "0" for c in tail[n:]):
            break
        tail[n] = "" if pieces[k] == "#" else " "
    for n, k in enumerate(after):
        out[k] = tail[n]
    exp_at = [k for k, p in enumerate(pieces) if exp is not None and k > exp and p in "0#?"]
    result = ""
    for k, p in enumerate(pieces):
        if k in out:
            result += out[k]
        elif exp is not None and k == exp:
            mark = "-" if power < 0 else "+" if p[1] == "+" else ""
            result += p[0].upper() + mark + str(abs(power)).rjust(sum(pieces[q] == "0" for q in exp_at), "0")
        elif k in exp_at or (p == "," and before and k > before[0]):
            continue
        elif literal(p) is not None:
            result += literal(p)
        else:
            result += p
    assert k_digit >= 0
    return sign + result


def general_width(x: float) -> str:
    s = general(x)
    if len(s.replace(".", "").replace("-", "")) > 10 and "E" not in s:
        if abs(x) >= 1e11 or 0 < abs(x) < 1e-9:
            m, e = f"{x:.5E}".split("E")
            return f"{m.rstrip('0').rstrip('.')}E{e[0]}{e[1:].lstrip('0').rjust(2, '0')}"
        places = max(0, 10 - len(str(int(abs(x)))))
        s = f"{x:.{places}f}"
        return s.rstrip("0").rstrip(".") if "." in s else s
    return s


def render_fraction(x: float, pieces: list[str]) -> str:
    from fractions import Fraction

    slash = pieces.index("/")
    first = slash
    while first > 0 and pieces[first - 1] in "0#?":
        first -= 1
    denominator = "".join(p for p in pieces[slash + 1 :] if p.isdigit() or p in "#?")
    mixed = any(p in "0#?" for p in pieces[:first])
    whole = math.floor(x) if mixed else 0
    rest = x - whole
    if denominator.isdigit() and denominator.strip("0"):
        d = int(denominator)
        n = int(away(rest * d))
    else:
        f = Fraction(rest).limit_denominator(10 ** max(1, len(denominator)) - 1)
        n, d = f.numerator, f.denominator
    if mixed and n == d:
        whole, n = whole + 1, 0
    width = slash - first
    if mixed and n == 0:
        return (str(whole) if whole or True else "") + " " * (width + 1 + len(denominator) + 1)
    head = f"{whole} " if mixed and whole else ("0 " if mixed and "0" in pieces[:first] else "" if not mixed else "")
    return head + str(n).rjust(width) + "/" + (str(d) if denominator.isdigit() else str(d).ljust(len(denominator)))


SHORT = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
LONG = "January February March April May June July August September October November December".split()
WEEK = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()


def render_date(x: float, pieces: list[str]) -> str:
    if x < 0:
        raise VALUE
    places = max((len(p.partition(".")[2]) for p in pieces if p[0] in "sS" and "." in p), default=0)
    scale = 86400 * 10**places
    ticks = math.floor(x * scale + 0.5)
    day, tick = divmod(ticks, scale)
    y, m, d = parts(float(day))
    seconds, fraction = divmod(tick, 10**places)
    h, mi, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    half = "AM/PM" in pieces or "A/P" in pieces
    out, time_like = "", None
    for k, p in enumerate(pieces):
        low = p.lower()
        nxt = next((q.lower() for q in pieces[k + 1 :] if q[0] in "yYdDhHsSmM" or q.startswith("[")), "")
        if re.fullmatch(r"\[h+\]", low):
            out += str(day * 24 + h).rjust(len(low) - 2, "0")
            time_like = "h"
        elif re.fullmatch(r"\[m+\]", low):
            out += str((day * 86400 + seconds) // 60).rjust(len(low) - 2, "0")
            time_like = "m"
        elif re.fullmatch(r"\[s+\]", low):
            out += str(day * 86400 + seconds).rjust(len(low) - 2, "0")
        elif p == "AM/PM":
            out += "AM" if h < 12 else "PM"
        elif p == "A/P":
            out += "A" if h < 12 else "P"
        elif literal(p) is not None:
            out += literal(p)
        elif low[0] == "y":
            out += f"{y:04d}" if len(p) > 2 else f"{y % 100:02d}"
        elif low[0] == "d":
            name = WEEK[(day - 1) % 7]
            out += str(d) if len(p) == 1 else f"{d:02d}" if len(p) == 2 else name[:3] if len(p) == 3 else name
        elif low[0] == "h":
            v = (h % 12 or 12) if half else h
            out += str(v) if len(p) == 1 else f"{v:02d}"
            time_like = "h"
        elif low[0] == "s":
            whole = p.partition(".")[0]
            out += (str(s) if len(whole) == 1 else f"{s:02d}") + (f".{fraction:0{places}d}"[: 1 + len(p.partition(".")[2])] if "." in p else "")
            time_like = None
        elif low[0] == "m":
            if time_like == "h" or nxt[:1] == "s" or nxt.startswith("[s"):
                out += str(mi) if len(p) == 1 else f"{mi:02d}"
                time_like = None
            else:
                out += str(m) if len(p) == 1 else f"{m:02d}" if len(p) == 2 else SHORT[m - 1] if len(p) == 3 else LONG[m - 1][0] if len(p) == 5 else LONG[m - 1]
        else:
            out += p
    return out


@scalar("TEXT", "at")
def text_(v, code):
    if isinstance(v, Err):
        return v
    if isinstance(v, str):
        got = read_value(v)
        v = v if got is None else got
    return render(v, code)


assert dt and ERRORS and NUM
