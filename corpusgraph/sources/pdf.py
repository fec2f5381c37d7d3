"""Text of PDF files, from their page streams: two readers, the second for what the first finds nothing in.

Streams are inflated where they are deflated. The first reader follows text objects and their positions; the second takes
every string that is shown, in the order of the file. Fonts with own character codes are read through their ToUnicode
maps. Files without text (scans) are an error, as a column null text and a message.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sections

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
SHOWN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/]+|[-+]?[\d.]+|[A-Za-z'\"*]+", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
NO_TEXT = "no text in the PDF: it may be a scan"


def inflated(head: bytes, body: bytes) -> bytes | None:
    """A stream's bytes; None if it is packed in a way that isn't known here."""
    if b"FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(body)
        except zlib.error:
            return None
    return None if b"/Filter" in head else body


def objects(data: bytes) -> dict[int, bytes]:
    """Bodies of objects by number, those in object streams too."""
    found = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    for body in list(found.values()):
        m = STREAM.search(body)
        if m and b"/ObjStm" in m[1] and (plain := inflated(m[1], m[2])):
            first, n = (int(x[1]) if (x := re.search(rb"/" + k + rb"\s+(\d+)", m[1])) else 0 for k in (b"First", b"N"))
            index = [int(x) for x in plain[:first].split()[: 2 * n]]
            places = [*index[1::2], len(plain) - first]
            for number, begin, end in zip(index[::2], places, places[1:], strict=False):
                found.setdefault(number, plain[first + begin : first + end])
    return found


def unescaped(raw: bytes) -> bytes:
    """The bytes of a string in parentheses."""
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n") else ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.DOTALL)


def unicode_map(stream: bytes) -> dict[int, str]:
    """Characters by code of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.DOTALL):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low, high, first = int(a, 16), int(b, 16), text(c)
            for k in range(min(high - low + 1, 1 << 16)):
                out[low + k] = first[:-1] + chr(ord(first[-1]) + k)
    return out


def fonts(page: bytes, found: dict[int, bytes]) -> dict[bytes, dict[int, str]]:
    """ToUnicode maps of a page's fonts by name."""
    where = page
    if m := re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page):
        where = found.get(int(m[1]), b"")
    m = re.search(rb"/Font\s*(<<.*?>>|\d+\s+\d+\s+R)", where, re.DOTALL)
    table = m[1] if m else b""
    if r := REFERENCE.fullmatch(table.strip()):
        table = found.get(int(r[1]), b"")
    out = {}
    for name, number in re.findall(rb"(/[^\s/<>]+)\s+(\d+)\s+\d+\s+R", table):
        if (u := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", found.get(int(number), b""))) and (s := STREAM.search(found.get(int(u[1]), b""))):
            out[name] = unicode_map(inflated(s[1], s[2]) or b"")
    return out


def decoded(token: bytes, table: dict[int, str] | None) -> str:
    raw = unescaped(token) if token[:1] == b"(" else bytes.fromhex((h := re.sub(rb"\s", b"", token[1:-1]).decode()) + "0" * (len(h) % 2))
    if not table:
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = 2 if max(table) > 255 or token[:1] == b"<" and len(raw) % 2 == 0 and any(k > 255 for k in table) else 1
    return "".join(table.get(int.from_bytes(raw[i : i + width]), "") for i in range(0, len(raw), width))


def shown(stream: bytes, known: dict[bytes, dict[int, str]]) -> str:
    """Text of a content stream: a new line where the position moves down, a space where a gap is wide."""
    out: list[str] = []
    stack: list[bytes] = []
    table: dict[int, str] | None = None
    row: float | None = None
    inside = False
    for token in SHOWN.findall(stream):
        if token[:1] in b"(<" and token[:1]:
            stack.append(token)
        elif re.fullmatch(rb"[-+]?[\d.]+|[\[\]]|/.*", token, re.DOTALL):
            stack.append(token)
        else:
            if token == b"BT":
                inside, row = True, None
                out.append("\n")
            elif token == b"ET":
                inside = False
            elif token == b"Tf":
                table = known.get(next((t for t in reversed(stack) if t[:1] == b"/"), b""))
            elif token in (b"Td", b"TD", b"Tm") and inside:
                numbers = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
                now = numbers[-1] if numbers else 0.0
                moved = (row is not None and now != row) if token == b"Tm" else now != 0
                row = now if token == b"Tm" else row
                out.append("\n" if moved else " ")
            elif token in (b"T*", b"'", b'"') and inside:
                out.append("\n")
            if token in (b"Tj", b"'", b'"', b"TJ"):
                for t in stack:
                    if t[:1] in (b"(", b"<"):
                        out.append(decoded(t, table))
                    elif token == b"TJ" and re.fullmatch(rb"-\d*\.?\d+", t) and float(t) < -200:
                        out.append(" ")
            stack = []
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x)


def by_pages(data: bytes) -> str:
    """Text of each page in the order of the page tree."""
    found = objects(data)
    pages: list[bytes] = []

    def walk(number: int, seen: frozenset[int]) -> None:
        body = found.get(number, b"")
        if number in seen:
            return
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL):
            for k in REFERENCE.findall(kids[1]):
                walk(int(k), seen | {number})
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(body)

    root = next((b for b in found.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    if m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root):
        walk(int(m[1]), frozenset())
    out = []
    for page in pages:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.DOTALL)
        parts = [s for k in REFERENCE.findall(m[1] if m else b"") if (s := STREAM.search(found.get(int(k), b"")))]
        body = b"\n".join(inflated(s[1], s[2]) or b"" for s in parts)
        if words := shown(body, fonts(page, found)).strip():
            out.append(words)
    return "\n\n".join(out)


def by_streams(data: bytes) -> str:
    """What any stream of the file shows, for files whose page tree can't be followed."""
    bodies = (inflated(m[1], m[2]) for m in STREAM.finditer(data))
    return "\n\n".join(t for b in bodies if b and b"BT" in b and (t := shown(b, {})))


def cleaned(text: str) -> str:
    """As functions.text.clean."""
    text = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", text)
    text = re.sub(r" +\n", "\n", re.sub(r"[ \t]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def text_of(data: bytes) -> str:
    """The file's text; ValueError without any."""
    for way in (by_pages, by_streams):
        if (text := way(data)).strip():
            return cleaned(text)
    raise ValueError(NO_TEXT)


def documents(content: Column) -> Column:
    """struct<text, headings, error> of a file's bytes, headings by the lines' looks; null bytes have null text and no error."""

    @F.pandas_udf("text string, headings array<struct<level:int,text:string>>, error string")
    def run(files: pd.Series) -> pd.DataFrame:
        def one(data: bytes | None) -> tuple:
            if data is None:
                return None, None, None
            try:
                text = text_of(bytes(data))
            except ValueError as e:
                return None, None, str(e)
            return text, [{"level": a, "text": b} for a, b in sections.text_headings(text)], None

        return pd.DataFrame([one(x) for x in files], columns=["text", "headings", "error"], dtype=object)

    return run(content)
