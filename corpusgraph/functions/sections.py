"""Sections of long texts and source files: cutting at boundaries, packing to a budget, size bounds, headings of plain text.

Plain functions on one text, and Arrow-batched column forms of them. A text is whole in memory; nothing is shared between rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import MAX_CHARS, MIN_CHARS, PIECES

Piece = tuple[str, str, str]
# Headings and numbered lines that begin a section; declarations; types; blocks of styles.
HEADING_LINE = re.compile(r"^#{1,6}\s+.+$")
NUMBERED_LINE = re.compile(r"^\s*\d+(\.\d+)*\.?\s+[A-Z\u0080-\uFFFF]")
DECLARATION = re.compile(
    r"^(?:export\s+(?:default\s+)?)?(?P<kw>const|let|var|function|class)\s+"
    r"(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)",
    re.MULTILINE,
)
TYPE = re.compile(r"^(?:export\s+)?(?:interface|type|enum)\s+(?P<name>\w+)", re.MULTILINE)
STYLE_BLOCK = re.compile(r"[^{}]+\{(?:[^{}]|\{[^{}]*\})*\}")
WHOLE_JSON = 3000
LEAST_TOKENS, MOST_PARTS = 300, 10


def quarter(text: str) -> int:
    """A quarter of the characters, one at least."""
    return max(1, len(text) // 4)


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, re.split(r"\n{2,}", text)) if p]


def sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+", text)


def begins_section(line: str) -> bool:
    return bool(HEADING_LINE.match(line) or NUMBERED_LINE.match(line))


def outline(text: str) -> list[str]:
    """Lines gathered under Markdown headings and numbered lines; paragraphs where there is one such part at most."""
    parts: list[str] = []
    for line in text.splitlines(keepends=True):
        if not parts or begins_section(line.rstrip()):
            parts.append(line)
        else:
            parts[-1] += line
    parts = [p for p in parts if p.strip()]
    return parts if len(parts) > 1 else paragraphs(text) or [text]


def packed(text: str, budget: int, size: Callable[[str], int] = quarter) -> list[str]:
    """Sections gathered while they fit the budget. What alone exceeds it is packed by paragraphs, then by sentences; a longer sentence stays whole."""
    ways = ((outline, "\n\n"), (paragraphs, "\n\n"), (sentences, " "))

    def pack(whole: str, way: int) -> Iterator[str]:
        split, glue = ways[way]
        held: list[str] = []
        room = budget
        for part in split(whole):
            n = size(part)
            deeper = n > budget and way + 1 < len(ways)
            if held and (deeper or n > room):
                yield glue.join(held)
                held, room = [], budget
            if deeper:
                yield from pack(part, way + 1)
            else:
                held.append(part)
                room -= n
        if held:
            yield glue.join(held)

    return list(pack(text, 0))


def module_parts(text: str, budget: int, name: str, least: int = LEAST_TOKENS, most: int | None = MOST_PARTS, size: Callable[[str], int] = quarter) -> list[str]:
    """Packed parts with a line that names the part; a small one joins the part before it. `most` is a feature of the operator: parts beyond it go (None: all stay)."""
    parts: list[str] = []
    for part in packed(text, budget, size):
        if parts and size(part) < least:
            parts[-1] += "\n\n" + part
        else:
            parts.append(part)
    parts = parts[:most]
    return [f"[Part {i}/{len(parts)} of module '{name}']\n\n{p}" for i, p in enumerate(parts, 1)]


def bounded(chunks: list[Piece], least: int = MIN_CHARS, most: int = MAX_CHARS) -> list[Piece]:
    """Chunks under `least` characters join the next one, which names them (the last is kept); those over `most` are cut
    at the last blank line before it, else at the last line end, else kept."""
    joined: list[Piece] = []
    front = ""
    for i, (text, name, kind) in enumerate(chunks, 1):
        text = f"{front}\n\n{text}".strip() if front else text
        front = text if len(text) < least and i < len(chunks) else ""
        if not front:
            joined.append((text, name, kind))
    return [(part, name, kind) for text, name, kind in joined for part in cut(text, most)]


def cut(text: str, most: int = MAX_CHARS) -> Iterator[str]:
    while len(text) > most and (at := max(text.rfind("\n\n", 0, most), 0) or max(text.rfind("\n", 0, most), 0)):
        if head := text[:at].strip():
            yield head
        text = text[at:].strip()
    if text:
        yield text


def starts(pattern: re.Pattern, source: str) -> list[tuple[re.Match, str]]:
    """Matches and the text from each to the next."""
    found = list(pattern.finditer(source))
    ends = [m.start() for m in found[1:]] + [len(source)]
    return [(m, source[m.start() : end].strip()) for m, end in zip(found, ends, strict=False)]


def declaration_kind(name: str, keyword: str) -> str:
    if keyword == "class":
        return "class"
    return "hook" if re.match("use[A-Z]", name) else "function_component" if name[:1].isupper() else "utility"


def code_chunks(source: str, stem: str) -> list[Piece]:
    """A chunk for each declaration at the start of a line, what precedes the first one with it; without any, the file."""
    found = starts(DECLARATION, source)
    if not found:
        return bounded([(source.strip(), stem, "module")])
    chunks = [(text, m["name"], declaration_kind(m["name"], m["kw"])) for m, text in found]
    if before := source[: found[0][0].start()].rstrip():
        chunks[0] = (f"{before}\n\n{chunks[0][0]}", *chunks[0][1:])
    return bounded(chunks)


def type_chunks(source: str, stem: str) -> list[Piece]:
    """A chunk for each interface, type and enum; none without any."""
    return bounded([(text, m["name"], "interface") for m, text in starts(TYPE, source)])


def style_chunks(source: str, stem: str) -> list[Piece]:
    """A chunk for each block of at most one nested level, named by its first word."""
    blocks = [b.strip() for b in STYLE_BLOCK.findall(source)]
    name = lambda b: m[0] if (m := re.match(r"[.#@\w][\w\-]*", b)) else stem
    return bounded([(b, name(b), "style") for b in blocks]) if blocks else [(source.strip(), stem, "style")]


def json_chunks(source: str, stem: str) -> list[Piece]:
    """One chunk, or one for each key of an object whose text has WHOLE_JSON characters or more."""
    try:
        data = json.loads(source)
    except ValueError:
        data = None
    if not isinstance(data, dict) or len(source) < WHOLE_JSON:
        return [(source.strip(), stem, "json_config")]
    return bounded([(json.dumps({k: v}, indent=2), k, "json_config") for k, v in data.items()])


CHUNKERS: dict[str, Callable[[str, str], list[Piece]]] = {"code": code_chunks, "types": type_chunks, "style": style_chunks, "config": json_chunks}


def file_chunks(source: Column, stem: Column, kind: Column) -> Column:
    """PIECES of a file by its kind (a key of CHUNKERS; null for others and for null files)."""

    @F.pandas_udf(PIECES)
    def run(texts: pd.Series, stems: pd.Series, kinds: pd.Series) -> pd.Series:
        def one(t: str | None, s: str, k: str) -> list[dict] | None:
            make = CHUNKERS.get(k)
            return None if t is None or make is None else [dict(zip(("text", "name", "type"), c, strict=True)) for c in make(t, s or "")]

        return pd.Series([one(*x) for x in zip(texts, stems, kinds, strict=True)], dtype=object)

    return run(source, stem, kind)


def parts_of(text: Column, budget: int, name: Column, least: int = LEAST_TOKENS, most: int | None = MOST_PARTS) -> Column:
    """module_parts of each text; null for null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else module_parts(t, budget, n or "", least, most) for t, n in zip(texts, names, strict=True)], dtype=object)

    return run(text, name)


# The rules that make a line of plain text a heading.
MARKDOWN = re.compile(r"(#{1,6})\s+(.+)")
NUMBERED = re.compile(r"\d+(\.|\d+)*\.?\s+[A-Z\u0080-￿]")
NAMED = re.compile(r"(chapter|section|part|module)\s+\d+", re.IGNORECASE)
RULE = re.compile(r"[=\-]{3,}")


def line_level(line: str, following: str | None) -> tuple[int, str, bool] | None:
    """Level and text of a heading, and whether the following line underlines it. Both lines come trimmed; None ends the text."""
    if m := MARKDOWN.match(line):
        return len(m[1]), m[2].strip(), False
    if NUMBERED.match(line) or NAMED.match(line):
        return 2, line, False
    if following and RULE.fullmatch(following) and len(following) >= max(3, len(line) // 2):
        return 1, line, True
    if len(line) >= 10 and line == line.upper() and re.search(r"[A-Z]{3}", line):
        return 1, line, False
    short = 2 <= len(line.split()) <= 12 and len(line) <= 80
    if short and following == "" and line[-1] not in ".,;:" and not re.search(r"\w\.\s+\w", line):
        return 2, line, False
    return None


def text_headings(text: str) -> list[tuple[int, str]]:
    """Headings of a text without styles, in order; an underline is no heading itself."""
    lines, out = [x.strip() for x in text.splitlines()], []
    pairs = iter(zip(lines, [*lines[1:], None], strict=False))
    for line, following in pairs:
        if line and (found := line_level(line, following)):
            out.append(found[:2])
            if found[2]:
                next(pairs, None)
    return out


def headings_of(text: Column) -> Column:
    """text_headings as array<struct<level, text>>; null for null."""

    @F.pandas_udf("array<struct<level:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"level": a, "text": b} for a, b in text_headings(t)] for t in texts], dtype=object)

    return run(text)
