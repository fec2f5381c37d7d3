"""Word documents (DOCX): text with Markdown marks, tables, and the headings by style, outline or looks.

The archive's XML is read directly. A file that can't be read has null text and headings, and its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sections import text_headings

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes of one part of the archive, unpacked: files beyond it are errors, not memory.
MOST_BYTES = 256 << 20
#: Points from which short bold text is a heading.
LARGE = 14
FOUND = "struct<text:string,headings:array<struct<level:int,text:string>>,error:string>"


def attribute(node: ElementTree.Element | None, path: str) -> str | None:
    """The value of a descendant, "" if it has none; None without the descendant."""
    at = None if node is None else node.find("/".join(W + p for p in path.split("/")))
    return None if at is None else at.get(W + "val", "")


def run_text(node: ElementTree.Element) -> str:
    """Of a paragraph or a run: its text, tabs and line breaks."""
    out = []
    for x in node:
        match x.tag.removeprefix(W):
            case "t":
                out.append(x.text or "")
            case "tab":
                out.append("\t")
            case "cr":
                out.append("\n")
            case "br" if x.get(W + "type", "textWrapping") == "textWrapping":
                out.append("\n")
            case "noBreakHyphen":
                out.append("-")
            case "r" | "hyperlink":
                out.append(run_text(x))
    return "".join(out)


class Paragraph:
    def __init__(self, node: ElementTree.Element, styles: dict[str, str]):
        self.node, self.text = node, run_text(node).strip()
        self.style = styles.get(attribute(node, "pPr/pStyle") or "", "").lower()
        self.runs = [(r, t) for r in node.findall(W + "r") if (t := run_text(r)).strip()]

    def level(self) -> int | None:
        """By style: 0 for a title, 1 to 6 for headings."""
        if self.style == "title":
            return 0
        if "heading" in self.style:
            return min(int(m[0]), 6) if (m := re.search(r"\d+", self.style)) else 1
        return None

    def bold(self) -> bool:
        marks = [attribute(r, "rPr/b") for r, _ in self.runs]
        return bool(marks) and all(m is not None and m not in ("0", "false", "off") for m in marks)

    def points(self) -> float:
        """Of the first run that has a size; 0 without."""
        return next((float(s) / 2 for r, _ in self.runs if (s := attribute(r, "rPr/sz"))), 0.0)

    def look(self) -> int | None:
        """The level by outline, by a number before bold text, or by large, short and bold text."""
        outline = attribute(self.node, "pPr/outlineLvl") or ""
        if outline.isdecimal() and int(outline) <= 8:
            return min(int(outline) + 1, 6)
        if not self.bold():
            return None
        if m := re.match(r"(\d+(?:\.\d+)*)\.?\s+\S", self.text):
            return min(m[1].count(".") + 2, 6)
        return 2 if self.points() >= LARGE and len(self.text.split()) <= 12 and len(self.text) <= 100 else None

    def line(self) -> str:
        level = self.level()
        if level is not None:
            return f"\n{'#' * max(level, 1)} {self.text}"
        listed = "list" in self.style or attribute(self.node, "pPr/numPr") is not None
        return f"  - {self.text}" if listed else self.text


def table_lines(table: ElementTree.Element) -> Iterator[str]:
    """Rows as Markdown; a cell merged downward is repeated, one merged sideways isn't."""
    above: dict[int, str] = {}
    yield ""
    for i, row in enumerate(table.findall(W + "tr")):
        at, cells = 0, []
        for cell in row.findall(W + "tc"):
            merged = attribute(cell, "tcPr/vMerge")
            text = "\n".join(run_text(p) for p in cell.findall(W + "p")).strip().replace("\n", " ")
            if merged is not None and merged != "restart":
                text = above.get(at, text)
            for _ in range(int(attribute(cell, "tcPr/gridSpan") or 1)):
                above[at] = text
                at += 1
            cells.append(text)
        yield f"| {' | '.join(cells)} |"
        if not i:
            yield "|" + " --- |" * len(cells)
    yield ""


def tidy(text: str) -> str:
    """Without control characters; blanks as one, none at line ends, one empty line at most."""
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    text = re.sub(r" +(?=\n|\Z)", "", re.sub(r"[^\S\n]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def opened(data: bytes) -> tuple[ElementTree.Element, dict[str, str]]:
    """The body, and the names of the styles by id."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:

        def part(name: str) -> ElementTree.Element:
            if z.getinfo(name).file_size > MOST_BYTES:
                raise ValueError(f"{name} is too large")
            return ElementTree.fromstring(z.read(name))

        body = part("word/document.xml").find(W + "body")
        sheet = part("word/styles.xml") if "word/styles.xml" in z.namelist() else ()
    if body is None:
        raise ValueError("no body")
    return body, {s.get(W + "styleId", ""): attribute(s, "name") or "" for s in sheet if s.tag == W + "style"}


def read_document(data: bytes) -> tuple[str, list[tuple[int, str]]]:
    """Text and headings. Headings by style and by looks, in order (looks count unless a style gave the same text before); else those of the plain text."""
    body, styles = opened(data)
    lines, headings, styled = [], [], set()
    for node in body:
        if node.tag == W + "tbl":
            lines += table_lines(node)
        elif node.tag == W + "p" and (p := Paragraph(node, styles)).text:
            lines.append(p.line())
            level = p.level()
            if level is not None:
                styled.add(p.text)
            elif p.text not in styled:
                level = p.look()
            if level is not None:
                headings.append((level, p.text))
    text = tidy("\n".join(lines))
    return text, headings or text_headings(text)


def documents(content: Column) -> Column:
    """FOUND of a file's bytes; null bytes have null text and no error."""

    @F.pandas_udf(FOUND)
    def run(files: pd.Series) -> pd.DataFrame:
        def one(data: bytes | None) -> tuple:
            if data is None:
                return None, None, None
            try:
                text, headings = read_document(data)
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                return None, None, f"{type(e).__name__}: {e}"
            return text, [{"level": a, "text": b} for a, b in headings], None

        return pd.DataFrame([one(x) for x in files], columns=["text", "headings", "error"], dtype=object)

    return run(content)
