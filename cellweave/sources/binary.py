"""Binary workbooks: xls (BIFF8 in a compound file) and xlsb (BIFF12 in a package), values and cached results; and a
writer of plain xls and ods files."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from ..functions.values import ERRORS, Err

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
#: Error codes in binary files.
CODES = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Encrypted(ValueError):
    pass


def compound_streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file, by name."""
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size, mini = 1 << shift, 1 << mini_shift
    first_dir, = struct.unpack_from("<I", data, 48)
    cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    table = [k for k in struct.unpack_from("<109I", data, 76) if k < END]
    while first_difat < END and n_difat:
        more = struct.unpack(f"<{size // 4}I", sector(first_difat))
        table += [k for k in more[:-1] if k < END]
        first_difat, n_difat = more[-1], n_difat - 1
    fat = [x for k in table for x in struct.unpack(f"<{size // 4}I", sector(k))]

    def chain(k: int, links: list[int]) -> Iterator[int]:
        seen = 0
        while k < END and seen <= len(links):
            yield k
            k, seen = links[k], seen + 1

    whole = lambda k: b"".join(sector(s) for s in chain(k, fat))
    minis = [x for k in chain(first_mini, fat) for x in struct.unpack(f"<{size // 4}I", sector(k))] if first_mini < END else []
    entries, root, out = whole(first_dir), b"", {}
    for at in range(0, len(entries), 128):
        e = entries[at : at + 128]
        n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
        name = e[: max(n - 2, 0)].decode("utf-16-le")
        start, length = struct.unpack_from("<IQ", e, 116)
        length &= 0xFFFFFFFF
        if kind == 5:
            root = whole(start) if start < END else b""
        elif kind == 2:
            body = b"".join(root[s * mini : (s + 1) * mini] for s in chain(start, minis)) if length < cutoff else whole(start)
            out[name] = body[:length]
    return out


def rk(v: int) -> float:
    x = float(v >> 2 if v < 0x80000000 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


class Continued:
    """The bytes of a record and those that continue it; texts may change their width where a part begins."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            here = self.parts[self.k][self.at : self.at + n]
            out, self.at, n = out + here, self.at + len(here), n - len(here)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.at == len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 1
                wide = self.parts[self.k][0] & 1
            width = 2 if wide else 1
            here = min(n, (len(self.parts[self.k]) - self.at) // width)
            out += self.take(here * width).decode("utf-16-le" if wide else "latin-1")
            n -= here
        self.take(runs * 4 + extra)
        return out


def unicode_text(data: bytes, at: int, wide_count: bool = True) -> str:
    n = struct.unpack_from("<H", data, at)[0] if wide_count else data[at]
    at += 2 if wide_count else 1
    wide = data[at] & 1
    return data[at + 1 : at + 1 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1")


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        yield at, kind, data[at + 4 : at + 4 + n]
        at += 4 + n


def read_xls(data: bytes):
    streams = compound_streams(data)
    if "EncryptedPackage" in streams:
        raise Encrypted("encrypted workbooks are not read")
    book = streams.get("Workbook") or streams.get("Book") or b""
    sheets, texts, parts = [], [], []
    for _, kind, body in records(book):
        if kind == 0x2F:
            raise Encrypted("encrypted workbooks are not read")
        if kind == 0x85:
            if body[5] == 0:
                sheets.append((struct.unpack_from("<I", body)[0], unicode_text(body, 6, False)))
        elif kind == 0xFC or (kind == 0x3C and parts):
            parts.append(body)
        elif parts:
            source = Continued(parts)
            _, n = struct.unpack("<II", source.take(8))
            texts, parts = [source.text() for _ in range(n)], []
        if kind == 0x0A:
            break
    for k, (start, title) in enumerate(sheets):
        waiting = None
        for _, kind, body in records(book, start):
            if kind == 0x0A:
                break
            if kind == 0x207 and waiting:
                yield k, title, *waiting, unicode_text(body, 0), None
                waiting = None
                continue
            if kind not in (0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x205, 0x06):
                continue
            r, c = struct.unpack_from("<HH", body)
            r, c = r + 1, c + 1
            if kind == 0xFD:
                yield k, title, r, c, texts[struct.unpack_from("<I", body, 6)[0]], None
            elif kind == 0x203:
                yield k, title, r, c, struct.unpack_from("<d", body, 6)[0], None
            elif kind == 0x27E:
                yield k, title, r, c, rk(struct.unpack_from("<I", body, 6)[0]), None
            elif kind == 0xBD:
                for q in range((len(body) - 6) // 6):
                    yield k, title, r, c + q, rk(struct.unpack_from("<I", body, 6 + 6 * q)[0]), None
            elif kind == 0x204:
                yield k, title, r, c, unicode_text(body, 6), None
            elif kind == 0x205:
                yield k, title, r, c, ERRORS[CODES[body[6]]] if body[7] else bool(body[6]), None
            else:  # a formula's cached result
                if body[12:14] != b"\xff\xff":
                    yield k, title, r, c, struct.unpack_from("<d", body, 6)[0], None
                elif body[6] == 0:
                    waiting = (r, c)
                elif body[6] in (1, 2):
                    yield k, title, r, c, bool(body[8]) if body[6] == 1 else ERRORS[CODES[body[8]]], None


def records12(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        kind, at = data[at], at + 1
        if kind & 0x80:
            kind, at = (kind & 0x7F) | (data[at] & 0x7F) << 7, at + 1
        n = shift = 0
        for _ in range(4):
            b, at = data[at], at + 1
            n, shift = n | (b & 0x7F) << shift, shift + 7
            if not b & 0x80:
                break
        yield kind, data[at : at + n]
        at += n


def wide_text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    if n == FREE:
        return "", at + 4
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le"), at + 4 + 2 * n


def read_xlsb(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        rels = {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
        texts, sheets = [], []
        if "xl/sharedStrings.bin" in names:
            texts = [wide_text(body, 1)[0] for kind, body in records12(z.read("xl/sharedStrings.bin")) if kind == 19]
        for kind, body in records12(z.read("xl/workbook.bin")):
            if kind == 156:
                rel, at = wide_text(body, 8)
                sheets.append((wide_text(body, at)[0], rels[rel]))
        for k, (title, target) in enumerate(sheets):
            r = 0
            for kind, body in records12(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))):
                if kind == 0:
                    r = struct.unpack_from("<I", body)[0] + 1
                elif 2 <= kind <= 11:
                    c = struct.unpack_from("<I", body)[0] + 1
                    v = {
                        2: lambda b: rk(struct.unpack_from("<I", b, 8)[0]), 3: lambda b: ERRORS.get(CODES.get(b[8], ""), Err("#N/A")), 4: lambda b: bool(b[8]), 5: lambda b: struct.unpack_from("<d", b, 8)[0], 6: lambda b: wide_text(b, 8)[0], 7: lambda b: texts[struct.unpack_from("<I", b, 8)[0]],
                        8: lambda b: wide_text(b, 8)[0], 9: lambda b: struct.unpack_from("<d", b, 8)[0], 10: lambda b: bool(b[8]), 11: lambda b: ERRORS.get(CODES.get(b[8], ""), Err("#N/A")),
                    }[kind](body)
                    yield k, title, r, c, v, None


# Writers.
def compound(name: str, body: bytes) -> bytes:
    """A compound file of one stream."""
    body = body.ljust(max(4096, -(-len(body) // 512) * 512), b"\0")
    n = len(body) // 512
    n_fat = 1
    while (n + 1 + n_fat) > n_fat * 128:
        n_fat += 1
    fat = [*range(1, n), END, END, *[0xFFFFFFFD] * n_fat]
    fat += [FREE] * (n_fat * 128 - len(fat))
    if n_fat > 109:
        raise OverflowError("more than 7 MB a file need further tables")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, n_fat, n, 0, 4096, END, 0, END, 0, n + 1)
    head += struct.pack("<108I", *[n + 1 + k if k < n_fat else FREE for k in range(1, 109)])

    def entry(title: str, kind: int, child: int, start: int, size: int) -> bytes:
        raw = (title + "\0").encode("utf-16-le") if title else b""
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, FREE, FREE, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 1, END, 0) + entry(name, 2, FREE, 0, len(body)) + entry("", 0, FREE, 0, 0) * 2
    return head + body + directory + struct.pack(f"<{len(fat)}I", *fat)


def xls_bytes(sheets: dict[str, Iterator[tuple[int, int, object]]]) -> bytes:
    """BIFF8 sheets from (row, column, value), at most 65,536 rows by 256 columns."""
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    string = lambda s, wide=True: struct.pack("<H" if wide else "<B", len(s)) + b"\1" + s.encode("utf-16-le")
    back = {v: k for k, v in CODES.items()}
    bodies = []
    for cells in sheets.values():
        out = rec(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 1997, 0, 6))
        for r, c, v in cells:
            if r > 65536 or c > 256:
                raise OverflowError("the sheet is too large for this format")
            at = struct.pack("<HHH", r - 1, c - 1, 0)
            if isinstance(v, bool):
                out += rec(0x205, at + bytes([v, 0]))
            elif isinstance(v, Err):
                out += rec(0x205, at + bytes([back.get(v.code, 0x2A), 1]))
            elif isinstance(v, (int, float)):
                out += rec(0x203, at + struct.pack("<d", float(v)))
            elif v is not None:
                out += rec(0x204, at + string(str(v)[:4000]))
        bodies.append(out + rec(0x0A, b""))
    first = rec(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 1997, 0, 6))
    listed = [struct.pack("<BB", 0, 0) + string(t[:31], False) for t in sheets]
    at = len(first) + sum(4 + 4 + len(x) for x in listed) + 4
    globals_ = first
    for x, body in zip(listed, bodies, strict=True):
        globals_ += rec(0x85, struct.pack("<I", at) + x)
        at += len(body)
    return compound("Workbook", globals_ + rec(0x0A, b"") + b"".join(bodies))


def ods_bytes(sheets: dict[str, Iterator[tuple[int, list[tuple[int, object, str | None]]]]]) -> bytes:
    """An OpenDocument spreadsheet from rows of (column, value, formula)."""
    from html import escape

    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    reference = re.compile(r"(?<![\w.$\"])(?:([A-Za-z_]\w*)!)?(\$?[A-Z]{1,3}\$?\d+)(?::(\$?[A-Z]{1,3}\$?\d+))?(?![\w(])")
    odf = lambda f: reference.sub(lambda m: f"[{m[1] or ''}.{m[2]}{':.' + m[3] if m[3] else ''}]", f)

    def cell(v, f) -> str:
        formula = f' table:formula="of:={escape(odf(f))}"' if f else ""
        if isinstance(v, bool):
            return f'<table:table-cell{formula} office:value-type="boolean" office:boolean-value="{str(v).lower()}"/>'
        if isinstance(v, (int, float)):
            return f'<table:table-cell{formula} office:value-type="float" office:value="{float(v)!r}"/>'
        return f'<table:table-cell{formula} office:value-type="string"><text:p>{escape(str(v))}</text:p></table:table-cell>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/vnd.oasis.opendocument.spreadsheet")
        with z.open("content.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {ns} office:version="1.2"><office:body><office:spreadsheet>'.encode())
            for title, rows in sheets.items():
                f.write(f'<table:table table:name="{escape(title)}">'.encode())
                at = 1
                for r, cells in rows:
                    if r > at:
                        f.write(f'<table:table-row table:number-rows-repeated="{r - at}"><table:table-cell/></table:table-row>'.encode())
                    line, c_at = "", 1
                    for c, v, x in cells:
                        if c > c_at:
                            line += f'<table:table-cell table:number-columns-repeated="{c - c_at}"/>'
                        line, c_at = line + ("<table:table-cell/>" if v is None and not x else cell(v, x)), c + 1
                    f.write(f"<table:table-row>{line}</table:table-row>".encode())
                    at = r + 1
                f.write(b"</table:table>")
            f.write(b"</office:spreadsheet></office:body></office:document-content>")
        z.writestr("META-INF/manifest.xml", '<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.spreadsheet"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')
    return buffer.getvalue()
