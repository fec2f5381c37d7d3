"""Top-level declarations of TypeScript sources, read by a small scanner, and the chunks made of them.

The scanner knows comments, strings, templates, regular expressions and brackets. A statement ends at a semicolon, after
the block of a function, class, interface or enum, or at a line end that no operator carries on. One text at a time.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sections

TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|===?|!==?|[<>]=|\.\.\.|.)""", re.DOTALL
)
REGEX = re.compile(r"/(?![/*>])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
OPEN, CLOSE = "([{", ")]}"
#: A line that ends or begins with one of these goes on.
CARRIES = frozenset("= => ( [ { , . ? : + - * / % & | ^ < === == !== != <= >= extends implements from as of in new return typeof keyof".split())
CARRIED = frozenset("= => , . ? : + * / % & | ^ < > === == !== != <= >= ; ) ] } extends implements as".split())
WITH_BLOCK = frozenset(["function", "class", "interface", "enum"])
MODIFIERS = frozenset(["export", "default", "declare", "abstract", "async"])


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    #: Open brackets before it, and whether a line begins with it.
    depth: int
    first: bool


class Declaration(NamedTuple):
    start: int
    end: int
    name: str
    #: function, class, interface, type_alias, enum or variable.
    kind: str
    exported: bool
    props: list[str]
    fields: list[str]
    extends: list[str]


def template_end(source: str, at: int) -> int:
    """The end of a template literal whose backquote is at `at`."""
    i, n = at + 1, len(source)
    while i < n:
        if source[i] == "\\":
            i += 2
        elif source[i] == "`":
            return i + 1
        elif source.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                if source[i] == "`":
                    i = template_end(source, i)
                    continue
                depth += {"{": 1, "}": -1}.get(source[i], 0)
                i += 1
        else:
            i += 1
    return n


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at = depth = 0
    fresh = True
    while at < len(source):
        c, before = source[at], out[-1] if out else None
        if c == "`":
            end, kind = template_end(source, at), "string"
        elif c == "/" and (before is None or (before.kind == "sign" and before.text not in (")", "]", "}", "<", ">"))) and (m := REGEX.match(source, at)):
            end, kind = m.end(), "string"
        else:
            m = TOKEN.match(source, at)
            end, kind = m.end(), m.lastgroup
        text = source[at:end]
        if kind == "blank":
            fresh = fresh or "\n" in text
        else:
            if text in CLOSE and kind == "sign":
                depth = max(0, depth - 1)
            out.append(Token(kind, text, at, end, depth, fresh))
            fresh = False
            if text in OPEN and kind == "sign":
                depth += 1
        at = end
    return out


def statements(found: list[Token]) -> list[list[Token]]:
    """Tokens of each top-level statement."""
    out: list[list[Token]] = []
    now: list[Token] = []
    for t in found:
        if now and t.depth == 0 and t.first and t.text not in CARRIED and t.kind != "string" and now[-1].text not in CARRIES:
            out.append(now)
            now = []
        now.append(t)
        closes = t.depth == 0 and t.text == "}" and t.kind == "sign" and head(now)[0] in WITH_BLOCK
        if t.depth == 0 and (t.text == ";" or closes):
            out.append(now)
            now = []
    return [*out, now] if now else out


def head(statement: list[Token]) -> tuple[str, int]:
    """The word that says what a statement is, and its place."""
    for i, t in enumerate(statement):
        if t.text not in MODIFIERS or t.kind != "word":
            if t.text in ("const", "let", "var") and i + 1 < len(statement) and statement[i + 1].text == "enum":
                return "enum", i + 1
            return t.text, i
    return "", 0


def matching(statement: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at `at`, or the end."""
    return next((i for i in range(at + 1, len(statement)) if statement[i].depth == statement[at].depth and statement[i].text in CLOSE), len(statement) - 1)


def pattern_names(statement: list[Token], at: int) -> list[str]:
    """The names that an object pattern at `at` takes apart: keys, and the rest as ...name."""
    inside, depth = statement[at + 1 : matching(statement, at)], statement[at].depth + 1
    out, begins = [], True
    for i, t in enumerate(inside):
        if t.depth == depth and t.text == ",":
            begins = True
        elif begins and t.text == "..." and i + 1 < len(inside):
            out.append("..." + inside[i + 1].text)
            begins = False
        elif begins and t.kind in ("word", "string"):
            out.append(t.text)
            begins = False
    return out


def params(statement: list[Token], at: int) -> list[str]:
    """Names taken from the first object pattern among the parameters whose bracket is at `at`."""
    stop, depth = matching(statement, at), statement[at].depth + 1
    place = next((i for i in range(at + 1, stop) if statement[i].depth == depth and statement[i].text == "{" and statement[i - 1].text in ("(", ",")), None)
    return [] if place is None else pattern_names(statement, place)


def value_of(statement: list[Token], at: int) -> tuple[bool, list[str]]:
    """Whether a variable's value is a function, and the names its first parameter takes apart. at: the variable's name."""
    depth = statement[0].depth
    sign = next((i for i in range(at, len(statement)) if statement[i].depth == depth and statement[i].text == "="), None)
    if sign is None or sign + 1 >= len(statement):
        return False, []
    i = sign + 1
    if statement[i].text == "async" and i + 1 < len(statement):
        i += 1
    if statement[i].text == "function":
        return True, []
    if statement[i].text == "<":  # type parameters of an arrow function
        i = next((k for k in range(i, len(statement)) if statement[k].text == "(" and statement[k].depth == depth), i)
    if statement[i].text == "(":
        close = matching(statement, i)
        rest = [t for t in statement[close + 1 :] if t.depth == depth]
        arrow = next((k for k, t in enumerate(rest) if t.text == "=>"), None)
        if arrow is not None and (arrow == 0 or rest[0].text == ":"):
            return True, params(statement, i)
        return False, []
    return (True, []) if statement[i].kind == "word" and i + 1 < len(statement) and statement[i + 1].text == "=>" else (False, [])


def members(statement: list[Token], enum: bool) -> list[str]:
    """Names of the members of the first block."""
    at = next((i for i, t in enumerate(statement) if t.text == "{" and t.depth == statement[0].depth), None)
    if at is None:
        return []
    out, begins, depth = [], True, statement[at].depth + 1
    inside = statement[at + 1 : matching(statement, at)]
    for i, t in enumerate(inside):
        if t.depth != depth:
            continue
        if t.text in (",", ";"):
            begins = True
        elif (begins or t.first) and t.kind in ("word", "string"):
            follows = next((x.text for x in inside[i + 1 :] if x.text != "?"), "")
            if t.text == "readonly" and follows not in (":", "("):
                continue
            if enum or follows in (":", "(", "<"):
                out.append(t.text)
                begins = False
    return out


def bases(statement: list[Token]) -> list[str]:
    """What an interface extends."""
    at = next((i for i, t in enumerate(statement) if t.text == "extends" and t.depth == statement[0].depth), None)
    if at is None:
        return []
    out, angle = [""], 0
    for t in statement[at + 1 :]:
        if t.text == "{" and not angle:
            break
        angle += {"<": 1, ">": -1}.get(t.text, 0)
        if t.text == "," and not angle:
            out.append("")
        else:
            out[-1] += t.text
    return [x for x in out if x]


def read(source: str) -> tuple[list[Declaration], list[str], list[str]]:
    """Declarations in order, the texts of import statements, and the names that are exported."""
    found: list[Declaration] = []
    imports: list[str] = []
    exports: list[str] = []
    for s in statements(tokens(source)):
        word, at = head(s)
        exported = s[0].text == "export"
        start, end = s[0].start, s[-1].end
        if word == "import" and not exported:
            imports.append(source[start:end])
            continue
        name = s[at + 1] if at + 1 < len(s) else None
        if word in ("const", "let", "var") and name is not None:
            label = name.text if name.kind == "word" else source[name.start : s[matching(s, at + 1)].end]
            function, props = value_of(s, at + 1)
            found.append(Declaration(start, end, label, "function" if function else "variable", exported, props, [], []))
            if exported:
                exports += declarators(s, at)
        elif word == "function" and name is not None:
            name = s[at + 2] if name.text == "*" and at + 2 < len(s) else name
            if name.kind == "word":
                bracket = next((i for i in range(at, len(s)) if s[i].text == "(" and s[i].depth == s[0].depth), None)
                found.append(Declaration(start, end, name.text, "function", exported, [] if bracket is None else params(s, bracket), [], []))
                exports += [name.text] * exported
        elif word in ("class", "interface", "enum") and name is not None and name.kind == "word":
            fields = members(s, word == "enum") if word != "class" else []
            found.append(Declaration(start, end, name.text, word, exported, [], fields, bases(s) if word == "interface" else []))
            exports += [name.text] * (exported and word == "class")
        elif word == "type" and name is not None and name.kind == "word" and len(s) > at + 2:
            value = next((i for i in range(at, len(s)) if s[i].text == "=" and s[i].depth == s[0].depth), None)
            plain = value is not None and value + 1 < len(s) and s[value + 1].text == "{"
            found.append(Declaration(start, end, name.text, "type_alias", exported, [], members(s[value + 1 :], False) if plain else [], []))
        elif exported and word not in ("{", "*", "") and s[at].kind == "word" and len(s) <= at + 2:
            exports.append(word)
    return found, imports, exports


def declarators(statement: list[Token], at: int) -> list[str]:
    depth = statement[0].depth
    return [statement[i + 1].text for i in range(at, len(statement) - 1) if statement[i].depth == depth and (i == at or statement[i].text == ",") and statement[i + 1].kind == "word"]


def hook(name: str) -> bool:
    return name.startswith("use") and name[3:4].isupper()


def declared_chunks(source: str, stem: str) -> list[sections.Piece]:
    """A chunk for each declaration: what stands before the first one comes with it, the imports with the others. What
    stands between declarations is left out. Without any: the file."""
    found, imports, _ = read(source)
    if not found:
        return [(source.strip(), stem, "module")]
    front = [source[: found[0].start].rstrip()] + ["\n".join(imports)] * (len(found) - 1)
    kind = lambda d: "hook" if d.kind == "function" and hook(d.name) else d.kind
    return [("\n\n".join(x for x in (f, source[d.start : d.end].strip()) if x), d.name, kind(d)) for d, f in zip(found, front, strict=True)]


def component_kind(d: Declaration) -> str:
    if d.kind in ("class", "interface", "type_alias", "enum"):
        return d.kind
    return "hook" if hook(d.name) else "function_component" if d.name[:1].isupper() else "utility"


class Component(NamedTuple):
    text: str
    name: str
    type: str
    imports: list[str]
    exports: list[str]
    props: list[str]


def component_chunks(source: str, stem: str) -> list[Component]:
    """As declared_chunks, but each runs to the next declaration's start; with imports, own exports and props."""
    found, imports, exports = read(source)
    if not found:
        return [Component(source.strip(), stem, "module", imports, exports, [])]
    ends = [d.start for d in found[1:]] + [len(source)]
    front = [source[: found[0].start].rstrip()] + ["\n".join(imports)] * (len(found) - 1)
    return [
        Component("\n\n".join(x for x in (f, source[d.start : e].strip()) if x), d.name, component_kind(d), imports, [d.name] if d.name in exports else [], d.props)
        for d, e, f in zip(found, ends, front, strict=True)
    ]


def type_records(source: str) -> list[Declaration]:
    """Interfaces, type aliases and enums with their fields and bases."""
    return [d for d in read(source)[0] if d.kind in ("interface", "type_alias", "enum")]


def merged(chunks: list[sections.Piece], least: int) -> list[sections.Piece]:
    """While the pending chunk has fewer tokens than least, the next joins it and names it. A small last one stays."""
    out: list[sections.Piece] = []
    for text, name, kind in chunks:
        if out and sections.quarter(out[-1][0]) < least:
            out[-1] = (out[-1][0].rstrip() + "\n\n" + text, name, kind)
        else:
            out.append((text, name, kind))
    return out


def divided(text: str, most: int) -> list[str]:
    """Paragraphs gathered until they exceed the most tokens; then all but the last are a part. One huge paragraph stays whole."""
    if sections.quarter(text) <= most:
        return [text]
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in re.split(r"\n{2,}", text):
        grown = size + len(p) + 2 * bool(held)
        if held and max(1, grown // 4) > most:
            out.append("\n\n".join(held))
            held, grown = [], len(p)
        held.append(p)
        size = grown
    if last := "\n\n".join(held).strip():
        out.append(last)
    return out or [text]


def file_parts(source: str, name: str, least: int = 200, most: int = 800, small: int = 500) -> list[sections.Piece]:
    """A file's chunks: whole if it is small; by declarations if it is TypeScript; else by blank lines. Then small ones are merged and large ones divided."""
    stem, dot, ending = name.rpartition(".") if "." in name[1:] else (name, "", "")
    if sections.quarter(source) < small:
        chunks = [(source.strip(), stem, "module")]
    elif ending.lower() in ("ts", "tsx"):
        chunks = declared_chunks(source, stem)
    else:
        chunks = [(p, "", "module") for p in sections.paragraphs(source)] or [(source.strip(), "", "module")]
    return [(part, n, k) for text, n, k in merged(chunks, least) for part in divided(text, most)]


PARTS = "array<struct<text:string,name:string,type:string>>"
COMPONENTS = "array<struct<text:string,name:string,type:string,imports:array<string>,exports:array<string>,props:array<string>>>"
TYPES = "array<struct<name:string,type:string,text:string,fields:array<string>,extends:array<string>>>"


def parts(source: Column, name: Column) -> Column:
    """file_parts as a column; null for null."""

    @F.pandas_udf(PARTS)
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        one = lambda t, n: None if t is None else [dict(zip(("text", "name", "type"), p, strict=True)) for p in file_parts(t, n or "")]
        return pd.Series([one(*x) for x in zip(texts, names, strict=True)], dtype=object)

    return run(source, name)


def components(source: Column, stem: Column) -> Column:
    """component_chunks as a column; null for null."""

    @F.pandas_udf(COMPONENTS)
    def run(texts: pd.Series, stems: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [c._asdict() for c in component_chunks(t, s or "")] for t, s in zip(texts, stems, strict=True)], dtype=object)

    return run(source, stem)


def types(source: Column) -> Column:
    """type_records as a column; null for null."""

    @F.pandas_udf(TYPES)
    def run(texts: pd.Series) -> pd.Series:
        one = lambda t: [{"name": d.name, "type": d.kind, "text": t[d.start : d.end].strip(), "fields": d.fields, "extends": d.extends} for d in type_records(t)]
        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run(source)
