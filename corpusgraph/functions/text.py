"""Scalar text functions: cleaning, sizes, names, headings, mentions, quoting, prices."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import matcher


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """Without control characters, runs of blanks as one, no blanks at line ends, at most one empty line, trimmed."""
    x = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" +\n", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


# What is taken off a heading to name its module.
NUMBER_IN_FRONT = r"^\d+\.\s*"
STEP_IN_FRONT = r"(?i)^(Step|Phase|Stage)\s+\d+\s*[–\-]\s*"
STATE_BEHIND = r"(?i)\s*[\(–\-].*?(final|document|updated|complete|version)[^\)]*\)?$"


def module_name(heading: Column) -> Column:
    """A heading without its number, its step, phase or stage in front, and a state like "(final ...)" behind; if nothing is left, its first 50 characters."""
    x = F.regexp_replace(heading, r"(?U)^\s+|\s+$", "")
    for pattern in (NUMBER_IN_FRONT, STEP_IN_FRONT, STATE_BEHIND):
        x = F.regexp_replace(x, pattern, "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"[–\-— ]+$", "")
    return F.when(x != "", x).otherwise(F.substring(heading, 1, 50))


def numbered_level(heading: Column) -> Column:
    """One more than the parts of the number in front, six at most; null without a number."""
    number = F.regexp_extract(heading, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6)))


def capitalised(text: Column) -> Column:
    """Words of two humps at least (PascalCase), sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), 1)))


def contained(text: Column, names: list[str], few: int = 16) -> Column:
    """Those of a list of names that the text contains; more than a few by one pass over the text."""
    if len(names) > few:
        return F.transform(matcher.matched(text, names), lambda i: F.get(F.array(*[F.lit(n) for n in names]), i))
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n))


# What the indentation format quotes, and its escapes in their order.
SPECIAL = r"""[\[\]{}\:\,\\\"\n\r\t]"""
NUMERIC = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"
LEADING_ZERO = r"^0\d+$"
RESERVED = ("true", "false", "null")
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def needs_quotes(value: Column, delimiter: str = ",") -> Column:
    """Whether a plain value would read as something else in the indentation format."""
    padded = value.rlike(r"(?U)^\s|\s$")
    alike = value.isin(*RESERVED) | value.rlike(NUMERIC) | value.rlike(LEADING_ZERO) | value.startswith("-")
    return (value == "") | padded | alike | value.rlike(SPECIAL) | F.contains(value, F.lit(delimiter))


def quoted(value: Column, delimiter: str = ",") -> Column:
    x = value
    for a, b in ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.when(needs_quotes(value, delimiter), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(value)


def price(model: Column, tokens_in: Column, tokens_out: Column, prices: Mapping[str, tuple[float, float]], default: tuple[float, float]) -> Column:
    """Of tokens, by prices for a thousand."""
    known = lambda k: F.coalesce(*([F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, p[k])])[model]] if prices else []), F.lit(default[k]))
    return F.bround(tokens_in / 1000 * known(0) + tokens_out / 1000 * known(1), 6)


def embedding_cost(tokens: Column, price_per_million: float = 0.13) -> Column:
    return F.bround(tokens / 1e6 * price_per_million, 6)


def model_cost(tokens: Column, model: Column, prices: Mapping[str, float]) -> Column:
    """Of tokens, by prices for a million; unknown models cost nothing."""
    known = F.create_map(*[F.lit(x) for p in prices.items() for x in p])[model] if prices else F.lit(None)
    return F.bround(tokens * F.coalesce(known, F.lit(0.0)) / 1e6, 8)


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with {key} replaced as it stands, one key after the other; other braces stay."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), value)
    return template


def exact_tokens(body: Column, ranks: str, pattern: str) -> Column:
    """Tokens of a byte-level BPE. ranks: the path of a tiktoken file, read once in each worker (all must see it); pattern: how text is cut first."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: None if t is None else len(coder.encode_ordinary(t))).astype("Int64")

    return run(body)


# Fenced code, doc comments and line comments.
FENCED = r"(?s)```(\w+)?.*?```"
DOC_COMMENT = r"(?s)/\*\*\s*\n?\s*\*?\s*(.+?)(?:\n|\*/)"
LINE_COMMENT = r"(?m)^//\s*(.+)$"


def code_blocks(text: Column) -> Column:
    """struct<n, language>: fenced blocks, and the tag that most of them have (of equals the first by name; empty without tags)."""
    tags = F.regexp_extract_all(text, F.lit(FENCED), F.lit(1))
    named = F.filter(tags, lambda x: x != "")
    ranked = F.transform(F.array_sort(F.array_distinct(named)), lambda x: F.struct(F.size(F.filter(named, lambda y: y == x)).alias("n"), x.alias("tag")))
    most = F.array_max(F.transform(ranked, lambda x: x["n"]))
    return F.struct(F.size(tags).alias("n"), F.coalesce(F.get(F.filter(ranked, lambda x: x["n"] == most), F.lit(0))["tag"], F.lit("")).alias("language"))


def summary(text: Column, name: Column, kind: Column) -> Column:
    """One line on a chunk: the first line of a doc comment, else the first line comment (of more than 10 characters, cut at 200), else "kind: name"."""
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    doc = F.regexp_replace(trimmed(F.regexp_extract(text, DOC_COMMENT, 1)), r"\.+$", "")
    line = trimmed(F.regexp_extract(text, LINE_COMMENT, 1))
    long = lambda x: F.when(F.length(x) > 10, F.substring(x, 1, 200))
    return F.coalesce(long(doc), long(line), F.concat(kind, F.lit(": "), name))


def collapsed_position(text: str | None, heading: str | None) -> int:
    """Where a heading stands if case and runs of white space don't count: from 0, -1 if nowhere."""
    if text is None or heading is None:
        return -1
    want = " ".join(text.split()).lower().find(" ".join(heading.split()).lower())
    if want <= 0:
        return want
    seen = 0
    for m in re.finditer(r"[ \t\r\n]+|[^ \t\r\n]+", text):
        if seen >= want:
            return m.start()
        blank = m[0][0] in " \t\r\n"
        if not blank and want < seen + len(m[0]):
            return m.start() + want - seen
        seen += 1 if blank else len(m[0])
        if blank and seen >= want and len(m[0]) > 1:
            return m.start() + 1
    return len(text)


def heading_position(text: Column, heading: Column) -> Column:
    """Where a heading begins, from 1; 0 if nowhere: as it stands, else in any case, else with any white space. Only texts that the first two don't find reach Python."""

    @F.pandas_udf("int")
    def loose(texts: pd.Series, headings: pd.Series) -> pd.Series:
        return pd.Series([collapsed_position(t, h) + 1 for t, h in zip(texts, headings, strict=True)], dtype="int32")

    plain, lower = F.position(heading, text), F.position(F.lower(heading), F.lower(text))
    strict = F.when(plain > 0, plain).otherwise(lower)
    return F.when(strict > 0, strict).otherwise(loose(F.when(strict == 0, text), heading))


def section_between(text: Column, heading: Column, following: Column) -> Column:
    """From a heading to the next one, both found as by heading_position; the whole text where the heading isn't there, to the end where the next one isn't."""
    begin = heading_position(text, heading)
    rest = F.substr(text, begin + F.length(heading))
    end = F.when(following.isNotNull() & (following != ""), heading_position(rest, following)).otherwise(F.lit(0))
    return F.when(begin == 0, text).when(end == 0, F.substr(text, begin)).otherwise(F.substr(text, begin, F.length(heading) + end - 1))
