"""Text of simple PDF files, and a writer of such files for tests and plans.

The reader takes the content streams in the order of the file, plain or deflated,
and the strings that are shown in them; a line starts at each of the operators
that move to one. Fonts with encodings of their own, encrypted files and object
streams aren't supported: their text is empty or as it is stored.
"""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|[A-Za-z'\"*]+|\[|\]|[-+.0-9]+", re.S)
# Escapes in strings, operators that show text and that move to a line.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_SHOW, _MOVE = (b"Tj", b"TJ", b"'", b'"'), (b"Td", b"TD", b"T*", b"'", b'"')


def _unescaped(body: bytes) -> bytes:
    one = lambda m: _ESCAPES.get(m[1], b"" if m[1] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, body, flags=re.S)


def _shown(content: bytes) -> str:
    out, held = [], []
    for token in _TOKEN.findall(content):
        if token[:1] == b"(":
            held.append(_unescaped(token[1:-1]))
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        else:
            if token in _MOVE and out:
                out.append("\n")
            if token in _SHOW:
                out.append(b"".join(held).decode("cp1252", "replace"))
            if token.isalpha() or token in _SHOW or token in _MOVE:
                held = []
    return "".join(out)


def pdf_text(data: bytes | None) -> str | None:
    """The shown text, pages one below the other; None for what is no PDF."""
    if data is None or data[:5] != b"%PDF-":
        return None
    pages = []
    for head, body in _STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" in body:
            pages.append(_shown(body))
    return "\n".join(pages)


def write_pdf(text: str, lines_of_page: int = 50) -> bytes:
    """A PDF file that shows the lines of ``text``; letters outside CP1252 become ``?``."""
    lines = text.split("\n")
    out, offsets = [b"%PDF-1.4\n"], []
    count = -(-len(lines) // lines_of_page)

    def add(body: bytes) -> None:
        offsets.append(sum(map(len, out)))
        out.append(b"%d 0 obj\n%s\nendobj\n" % (len(offsets), body))

    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (count, b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(count))))
    add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    for i in range(count):
        shown = []
        for line in lines[i * lines_of_page : (i + 1) * lines_of_page]:
            plain = re.sub(rb"([()\\])", rb"\\\1", line.encode("cp1252", "replace")).replace(b"\r", b"\\r")
            shown.append(b"(" + plain + b") Tj")
        body = zlib.compress(b"BT /F1 10 Tf 40 800 Td 12 TL " + b" T* ".join(shown) + b" ET")
        add(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        add(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream")
    at = sum(map(len, out))
    table = b"".join(b"%010d 00000 n \n" % o for o in offsets)
    out.append(b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, table, len(offsets) + 1, at))
    return b"".join(out)
