"""PDF files that the tests write, in several forms, read back."""

from __future__ import annotations

import zlib

import pytest

from spindrift.sources import pdf, readers

WORDS = "Điều 1. Phạm vi điều chỉnh (một) \\ hai; ba"


def cmap(chars):
    """Codes of two bytes, the first half as single ones, the rest as ranges."""
    some, rest = chars[: len(chars) // 2], chars[len(chars) // 2 :]
    u = lambda c: c.encode("utf-16-be").hex()
    single = "\n".join(f"<{k:04x}> <{u(c)}>" for k, c in enumerate(some, 1))
    ranges = "\n".join(f"<{k:04x}> <{k:04x}> <{u(c)}>" if k % 2 else f"<{k:04x}> <{k:04x}> [<{u(c)}>]" for k, c in enumerate(rest, 1 + len(some)))
    return f"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange {len(some)} beginbfchar\n{single}\nendbfchar {len(rest)} beginbfrange\n{ranges}\nendbfrange endcmap".encode()


def page_body(lines, codes):
    shown = lambda t: "<" + "".join(f"{codes[c]:04x}" for c in t) + ">"
    out = ["BT /F1 12 Tf 1 0 0 1 50 700 Tm"]
    for k, line in enumerate(lines):
        half = len(line) // 2
        out.append(("0 -14 Td " if k else "") + (f"{shown(line)} Tj" if k % 2 else f"[{shown(line[:half])} -20 {shown(line[half:])}] TJ"))
    return ("\n".join(out) + " ET").encode()


def write(pages, form="stream", packed=True):
    """pages: lists of lines. form: ``table``, ``stream`` (with objects inside a stream
    and PNG rows) or ``broken`` (no cross-reference)."""
    chars = sorted({c for p in pages for line in p for c in line})
    codes = {c: k for k, c in enumerate(chars, 1)}
    plain, streams = {}, {}

    def stream(n, body):
        data = zlib.compress(body) if packed else body
        streams[n] = f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream"

    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    plain[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    plain[2] = f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    plain[3] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>"
    stream(4, cmap(chars))
    for k, lines in enumerate(pages):
        plain[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        stream(11 + 2 * k, page_body(lines, codes))
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\n"), {}

    def put(n, body):
        places[n] = len(out)
        out.extend(f"{n} 0 obj\n".encode() + body + b"\nendobj\n")

    for n, body in streams.items():
        put(n, body)
    size = 20 + 2 * len(pages)
    if form == "stream":
        head, body = [], b""
        for n, x in plain.items():
            head.append(f"{n} {len(body)}")
            body += x + b" "
        first = " ".join(head).encode() + b" "
        data = zlib.compress(first + body)
        put(size - 2, f"<< /Type /ObjStm /N {len(plain)} /First {len(first)} /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream")
        start, rows, above = len(out), [], bytes(7)
        inside = {n: k for k, n in enumerate(plain)}
        for n in range(size):
            row = bytes([2]) + (size - 2).to_bytes(4, "big") + inside[n].to_bytes(2, "big") if n in inside else bytes([1]) + (start if n == size - 1 else places[n]).to_bytes(4, "big") + b"\0\0" if n in places or n == size - 1 else bytes(7)
            rows.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above)))  # each on the one above
            above = row
        data = zlib.compress(b"".join(rows))
        put(size - 1, f"<< /Type /XRef /Size {size} /W [1 4 2] /Root 1 0 R /Length {len(data)} /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> >>\nstream\n".encode() + data + b"\nendstream")
    else:
        for n, x in plain.items():
            put(n, x)
        start = len(out)
        if form == "table":
            out.extend(f"xref\n0 {size}\n".encode() + b"".join(f"{places.get(n, 0):010d} 00000 {'n' if n in places else 'f'} \n".encode() for n in range(size)))
        out.extend(f"trailer\n<< /Size {size} /Root 1 0 R >>\n".encode())
    out.extend(f"startxref\n{start if form != 'broken' else 7}\n%%EOF\n".encode())
    return bytes(out)


@pytest.mark.parametrize("form", ["table", "stream", "broken"])
@pytest.mark.parametrize("packed", [True, False])
def test_forms(form, packed):
    pages = [[WORDS, "second line"], ["一二三 🙂 x"], []]
    assert pdf.page_texts(write(pages, form, packed)) == [f"{WORDS}\nsecond line", "一二三 🙂 x", ""]


def test_strings_and_hard_cases():
    lex = pdf.Lexer(rb"(a\(b\)\\ (c) \101\n\
d) <48 65 6> /A#42 [1 -2.5 3 0 R true null] % note")
    assert lex.value() == b"a(b)\\ (c) A\nd" and lex.value() == b"He`" and lex.value() == "AB" and lex.value() == [1, -2.5, pdf.Ref(3), True, None]
    assert pdf.page_texts(b"no file") is None and pdf.page_texts(b"") is None and pdf.page_texts(b"%PDF-1.4\nrubbish") is None
    good = write([["text"]], "table")
    assert pdf.page_texts(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")) is None
    for cut in range(0, len(good), 37):  # whatever is missing, no crash
        pdf.page_texts(good[:cut])
        pdf.page_texts(good[:cut] + b"\0\0" + good[cut:])
    later = good + b"4 0 obj << /Length 5 >> stream\nendob endstream endobj"
    assert pdf.page_texts(later) == ["text"]  # what no cross-reference names does not count


def test_documents_as_pdf(spark, tmp_path):
    """Texts of the tables, a file each, come back page by page; scans go to the engine."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 20000").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        lines = [x for x in (" ".join(line.split()) for line in r.text.split("\n")) if x]
        pages = [lines[k : k + 40] for k in range(0, len(lines), 40)] or [[]]
        (tmp_path / f"{r.doc_id}.pdf").write_bytes(write(pages, ("stream", "table", "broken")[r.doc_id % 3], r.doc_id % 2 == 0))
        want |= {(r.doc_id, k): "\n".join(p) for k, p in enumerate(pages, 1)}
    got = {(int(r.path.rpartition("/")[2][:-4]), r.page): r.text for r in pdf.pdf_pages(spark, str(tmp_path)).collect()}
    assert got == want and len(rows) > 100
    (tmp_path / "scan.pdf").write_bytes(write([[]], "table"))
    out = {r.path.rpartition("/")[2]: (r.text, r.confidence) for r in readers.uploaded_files(spark, str(tmp_path), lambda content, kind: ("seen", 0.5)).collect()}
    assert out["scan.pdf"] == ("seen", 0.5) and out[f"{rows[0].doc_id}.pdf"][1] == 1.0
