"""Text of PDF files by page: objects through cross-reference tables and streams, Flate
streams, fonts with ToUnicode maps, text operators. Scans and encrypted files have none."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that one stream may inflate to.
MOST = 256_000_000
_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|[\[\]{}]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name object."""


class Word(str):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes


class Lexer:
    """Objects of a piece of PDF syntax, one after another."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        m = _TOKEN.match(self.data, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[1]

    def _string(self) -> bytes:
        out, depth, i, d = bytearray(), 1, self.at, self.data
        while i < len(d):
            c = d[i : i + 1]
            if c == b"\\":
                m = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S).match(d, i)
                if not m:
                    break
                x = m[1]
                out += bytes([int(x, 8) & 255]) if x[:1].isdigit() and x[0] < 56 else b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)
                i = m.end()
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                break
            out += c
        self.at = i
        return bytes(out)

    def value(self) -> Any:
        t = self.token()
        if t is None:
            raise EOFError
        if t == b"<<":
            out, key = {}, None
            while True:
                x = self.value()
                if x == Word(">>") and isinstance(x, Word):
                    return out
                if key is None:
                    key = x
                else:
                    out[str(key)], key = x, None
        if t == b"[":
            items: list = []
            while not (isinstance(x := self.value(), Word) and x == "]"):
                items.append(x)
            return items
        if t == b"(":
            return self._string()
        if t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if t[:1] == b"/":
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), t[1:].decode("latin-1")))
        if re.fullmatch(rb"[+-]?\d+", t):
            m = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(int(t))
            return int(t)
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", t):
            return float(t)
        return {b"true": True, b"false": False, b"null": None}.get(t, Word(t.decode("latin-1")))


class Document:
    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.inside, self.known, self.trailer = data, {}, {}, {}, {}
        try:
            start = int(re.findall(rb"startxref\s+(\d+)", data)[-1])
            self._section(start, set())
            self._catalogue()
        except (IndexError, ValueError, KeyError, TypeError, EOFError, zlib.error, AttributeError):
            self._recover()
        self.encrypted = "Encrypt" in self.trailer

    def _catalogue(self) -> dict:
        pages = self.get(self.get(self.trailer["Root"])["Pages"])
        return pages if isinstance(pages, dict) else {}[0]

    def _section(self, at: int, seen: set[int]) -> None:
        """A cross-reference table or stream, then those before it; the first entry of an
        object counts."""
        if at in seen:
            return
        seen.add(at)
        lex = Lexer(self.data, at)
        if lex.token() == b"xref":
            while (t := lex.token()) != b"trailer":
                first, n = int(t), int(lex.token())
                for k in range(n):
                    offset, _, kind = lex.token(), lex.token(), lex.token()
                    if kind == b"n":
                        self.places.setdefault(first + k, int(offset))
            info = lex.value()
        else:
            s = self._object(at)
            info, body = s.info, self.decoded(s)
            w, size = info["W"], sum(info["W"])
            index = info.get("Index") or [0, info["Size"]]
            numbers = [n for a, b in zip(index[::2], index[1::2]) for n in range(a, a + b)]
            for k, n in enumerate(numbers):
                row = body[k * size : (k + 1) * size]
                kind, x, y = (int.from_bytes(row[sum(w[:i]) : sum(w[: i + 1])], "big") if w[i] else int(i == 0) for i in range(3))
                if kind == 1 and n not in self.inside:
                    self.places.setdefault(n, x)
                elif kind == 2 and n not in self.places:
                    self.inside.setdefault(n, (x, y))
        self.trailer = {**info, **self.trailer}
        for key in ("XRefStm", "Prev"):
            if isinstance(info.get(key), int):
                self._section(info[key], seen)

    def _recover(self) -> None:
        """Without a usable cross-reference: all objects that are found, the last of a number."""
        self.inside, self.known = {}, {}
        self.places = {int(m[1]): m.start() for m in re.finditer(rb"(?<!\d)(\d+)[ \t\r\n]+\d+[ \t\r\n]+obj\b", self.data)}
        for n in list(self.places):
            try:
                x = self.get(Ref(n))
            except (EOFError, ValueError, zlib.error):
                continue
            info = x.info if isinstance(x, Stream) else x
            if isinstance(info, dict) and info.get("Type") == "ObjStm":
                for k, number in enumerate(self._numbers(x)):
                    self.inside.setdefault(number, (n, k))
            if isinstance(info, dict) and info.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(n)
        for m in re.finditer(rb"trailer\s*", self.data):
            try:
                self.trailer = {**self.trailer, **Lexer(self.data, m.end()).value()}
            except (EOFError, ValueError, TypeError):
                continue

    def _object(self, at: int) -> Any:
        lex = Lexer(self.data, at)
        lex.token(), lex.token()
        if lex.token() != b"obj":
            raise ValueError("no object")
        x = lex.value()
        if isinstance(x, dict) and (m := re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, lex.at)):
            n = self.get(x.get("Length"))
            end = m.end() + n if isinstance(n, int) else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                end = self.data.find(b"endstream", m.end())
            return Stream(x, self.data[m.end() : end if end >= 0 else len(self.data)])
        return x

    def _numbers(self, s: Stream) -> list[int]:
        lex = Lexer(self.decoded(s))
        return [int(lex.token()) for _ in range(2 * self.get(s.info["N"]))][::2]

    def get(self, x: Any) -> Any:
        """What a reference refers to; all else as it is."""
        hops = 0
        while isinstance(x, Ref) and hops < 32:
            hops += 1
            if x.number not in self.known:
                self.known[x.number] = None  # a reference to itself is null
                if x.number in self.places:
                    self.known[x.number] = self._object(self.places[x.number])
                elif x.number in self.inside:
                    holder, k = self.inside[x.number]
                    s = self.get(Ref(holder))
                    body = self.decoded(s)
                    lex = Lexer(body)
                    offsets = [int(lex.token()) for _ in range(2 * self.get(s.info["N"]))][1::2]
                    self.known[x.number] = Lexer(body, self.get(s.info["First"]) + offsets[k]).value()
            x = self.known[x.number]
        return x

    def decoded(self, s: Stream) -> bytes:
        filters = self.get(s.info.get("Filter")) or []
        parms = self.get(s.info.get("DecodeParms")) or {}
        data = s.raw
        for k, f in enumerate(filters if isinstance(filters, list) else [filters]):
            p = self.get(parms[k] if isinstance(parms, list) else parms) or {}
            if f in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data, MOST)
                if (self.get(p.get("Predictor")) or 1) >= 10:
                    data = _unpredicted(data, self.get(p.get("Columns")) or 1, self.get(p.get("Colors")) or 1)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return b""  # images
        return data

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Pages and their resources, in order."""
        todo, seen = [(self._catalogue(), {})], set()
        while todo:
            node, given = todo.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = self.get(node.get("Resources")) or given
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(self.get(k), own) for k in reversed(kids)]
            else:
                yield node, own

    def text(self, page: dict, resources: dict) -> str:
        parts = self.get(page.get("Contents"))
        streams = [self.get(p) for p in parts] if isinstance(parts, list) else [parts]
        body = b"\n".join(self.decoded(s) for s in streams if isinstance(s, Stream))
        fonts = self.get(resources.get("Font")) or {}
        maps: dict[str, Any] = {}
        lex, stack, font, out = Lexer(body), [], None, []

        def show(s: bytes) -> None:
            if font not in maps:
                f = self.get(fonts.get(font)) if font is not None else None
                m = self.get(f.get("ToUnicode")) if isinstance(f, dict) else None
                maps[font] = unicode_map(self.decoded(m)) if isinstance(m, Stream) else None
            out.append(mapped(s, maps[font]))

        while True:
            try:
                x = lex.value()
            except EOFError:
                break
            if not isinstance(x, Word):
                stack.append(x)
                continue
            if x == "Tf" and len(stack) > 1:
                font = str(stack[-2])
            elif x in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
                if x != "Tj":
                    out.append("\n")
                show(stack[-1])
            elif x == "TJ" and stack and isinstance(stack[-1], list):
                for y in stack[-1]:
                    if isinstance(y, bytes):
                        show(y)
                    elif isinstance(y, (int, float)) and y < -200:
                        out.append(" ")
            elif x in ("Td", "TD") and len(stack) > 1:
                out.append("\n" if stack[-1] else " ")
            elif x in ("T*", "Tm", "ET"):
                out.append("\n")
            elif x == "ID":  # an image within the page
                end = re.compile(rb"\sEI(?=\s)").search(body, lex.at)
                lex.at = end.end() if end else len(body)
            stack.clear()
        lines = [" ".join(line.split()) for line in "".join(out).split("\n")]
        return "\n".join(line for line in lines if line)


def _unpredicted(data: bytes, columns: int, colors: int) -> bytes:
    """PNG rows: each byte on the one before it, above it, or both."""
    width, out, above = columns * colors, bytearray(), bytearray(columns * colors)
    for k in range(0, len(data), width + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        for i in range(len(row)):
            a, b, c = (row[i - colors] if i >= colors else 0), above[i], (above[i - colors] if i >= colors else 0)
            p = a + b - c
            paeth = min((a, b, c), key=lambda z: abs(p - z))
            row[i] = (row[i] + (0, a, b, (a + b) // 2, paeth)[min(kind, 4)]) & 255
        out += row
        above = row + bytearray(width - len(row))
    return bytes(out)


def unicode_map(cmap: bytes) -> tuple[list[int], dict[bytes, str]]:
    """Lengths of codes, shortest first, and what codes stand for."""
    lex, stack, lengths, found = Lexer(cmap), [], set(), {}
    wide = lambda b: b.decode("utf-16-be", "replace")
    while True:
        try:
            x = lex.value()
        except EOFError:
            break
        if not isinstance(x, Word):
            stack.append(x)
            continue
        if x == "endcodespacerange":
            lengths |= {len(b) for b in stack if isinstance(b, bytes)}
        elif x == "endbfchar":
            found |= {a: wide(b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif x == "endbfrange":
            for low, high, to in zip(stack[::3], stack[1::3], stack[2::3]):
                for k in range(min(int.from_bytes(high, "big") - int.from_bytes(low, "big") + 1, 65536)):
                    code = (int.from_bytes(low, "big") + k).to_bytes(len(low), "big")
                    if isinstance(to, list):
                        found[code] = wide(to[k]) if k < len(to) else ""
                    else:
                        found[code] = wide(to[:-2] + (int.from_bytes(to[-2:], "big") + k & 0xFFFF).to_bytes(2, "big"))
        stack.clear()
    return sorted(lengths | {len(c) for c in found}) or [1], found


def mapped(s: bytes, known: tuple[list[int], dict[bytes, str]] | None) -> str:
    """Text of a string; without a map its bytes are those of the usual Latin encoding."""
    if known is None:
        return s.decode("cp1252", "replace")
    lengths, table = known
    out, i = [], 0
    while i < len(s):
        n = next((n for n in lengths if s[i : i + n] in table), lengths[-1])
        out.append(table.get(s[i : i + n], ""))
        i += n
    return "".join(out)


def page_texts(content: bytes) -> list[str] | None:
    """Texts by page; None of what is no PDF, or is encrypted."""
    if b"%PDF-" not in content[:1024]:
        return None
    d = Document(content)
    if d.encrypted:
        return None
    try:
        return [d.text(p, r) for p, r in d.pages()]
    except (KeyError, TypeError, ValueError, EOFError, AttributeError, zlib.error):
        return None


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of the PDF files below a path, pages from 1; a file that cannot
    be read is one row with page 0 and a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1)):
                texts = page_texts(content.as_py())
                rows = [(p, 0, None)] if texts is None else [(p, k, t) for k, t in enumerate(texts, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int32(), pa.string()))], ["path", "page", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, page int, text string")
