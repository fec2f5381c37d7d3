"""Checks of uploads and of models' answers: a check gives null, or what is wrong. Answers are mended before they are checked."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import suffix

# What is accepted.
MODES = ("frontend", "backend", "both")
UPLOADS = (".docx", ".pdf")
MOST_BYTES = 20 * 1024 * 1024
WORD_TYPE, PDF_TYPE = "wordprocessingml", "application/pdf"
#: Labels that wrap a component, and the type that each means.
COMPONENT_TYPES = {
    "TOOLBAR": "toolbar",
    "FILTER_PANEL": "filter_panel",
    "GRID": "grid",
    "KPI": "kpi",
    "TABS": "tabs",
    "FORM": "form",
    "SCAN_PANEL": "scan_panel",
    "STEPPER": "stepper",
    "FEEDBACK_AREA": "feedback_area",
    "BARCODE_PANEL": "barcode_panel",
    "INFO_PANEL": "info_panel",
    "UPLOAD_ZONE": "upload_zone",
    "TIMELINE": "timeline",
    "SUMMARY_SECTION": "summary_section",
}


def fault(status: int, message: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), message.alias("message"))


def mode_fault(mode: Column) -> Column:
    """400 unless the mode is one of MODES."""
    return F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), fault(400, F.concat(F.lit(f"mode must be one of {', '.join(sorted(MODES))}: "), F.coalesce(mode, F.lit("")))))


def upload_fault(name: Column) -> Column:
    """400 without a name or with another extension. The content type never decides."""
    wrong = fault(400, F.concat(F.lit(f"allowed: {', '.join(sorted(UPLOADS))}; received: "), suffix(name)))
    return F.when(F.coalesce(name, F.lit("")) == "", fault(400, F.lit("no file name"))).when(~suffix(name).isin(*UPLOADS), wrong)


def size_fault(size: Column) -> Column:
    """413 for more than MOST_BYTES."""
    return F.when(size > MOST_BYTES, fault(413, F.concat(F.format_number(size / (1024 * 1024), 1), F.lit(f" MB are more than {MOST_BYTES >> 20} MB"))))


def upload_kind(name: Column, content_type: Column) -> Column:
    """docx or pdf: by the extension, else by the content type; null for others."""
    e, t = suffix(name), F.coalesce(content_type, F.lit(""))
    return F.when(e == ".docx", "docx").when(e == ".pdf", "pdf").when(F.contains(t, F.lit(WORD_TYPE)), "docx").when(t == PDF_TYPE, "pdf")


def is_type(value: object, name: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None,
        "number": number, "integer": number and float(value).is_integer(),
    }.get(name, False)


def faults(value: object, schema: object, root: Mapping | None = None, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, message) of everything in a value that a JSON Schema forbids. Known: $ref within the schema, type, const,
    enum, anyOf, oneOf, allOf, properties, required, additionalProperties, items, minItems, maxItems, uniqueItems,
    minLength, maxLength, pattern, minimum, maximum."""
    import re

    if isinstance(schema, bool) or not isinstance(schema, Mapping):
        if schema is False:
            yield path, "nothing is allowed here"
        return
    root = schema if root is None else root
    if "$ref" in schema:
        target: object = root
        for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[part] if part else target
        yield from faults(value, target, root, path)
    kinds = schema.get("type")
    if kinds is not None and not any(is_type(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield path, f"{json.dumps(value)} is not of type {kinds}"
    if "const" in schema and value != schema["const"]:
        yield path, f"{json.dumps(schema['const'])} was expected"
    if "enum" in schema and value not in schema["enum"]:
        yield path, f"{json.dumps(value)} is not one of {json.dumps(schema['enum'])}"
    for part in schema.get("allOf", ()):
        yield from faults(value, part, root, path)
    for word, fits in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if word in schema and not fits(sum(next(faults(value, x, root, path), None) is None for x in schema[word])):
            yield path, f"{json.dumps(value)} doesn't fit {word}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                yield path, f"'{name}' is a required property"
        for name, x in value.items():
            if name in known:
                yield from faults(x, known[name], root, (*path, name))
            elif schema.get("additionalProperties", True) is False:
                yield path, f"'{name}' is not allowed"
            elif "additionalProperties" in schema:
                yield from faults(x, schema["additionalProperties"], root, (*path, name))
    if isinstance(value, list):
        for i, x in enumerate(value):
            yield from faults(x, schema.get("items", True), root, (*path, i))
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            yield path, f"{len(value)} items"
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in value}) < len(value):
            yield path, "items repeat"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            yield path, f"{len(value)} characters"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, f"doesn't match {schema['pattern']}"
    if is_type(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        yield path, f"{value} is out of bounds"


def first_fault(value: object, schema: Mapping, name: str) -> str | None:
    """The first fault by path, as a message; None without any."""
    found = min(faults(value, schema), key=lambda f: [(isinstance(p, str), p) for p in f[0]], default=None)
    return found and f"'{name}' at '{'.'.join(map(str, found[0])) or '<root>'}': {found[1]}"


def flat_components(components: list) -> list[dict]:
    """Components as flat records: those wrapped in a label come out with its type; tabs are gone into."""

    def opened(c: dict) -> dict:
        if c.get("type") == "tabs":
            c = c | {"children": [t | {"components": flat_components(t.get("components", []))} for t in c.get("children", [])]}
        return c

    out = []
    for c in components:
        if isinstance(c, dict):
            inner = [c] if "type" in c else [{"type": t} | c[label] for label, t in COMPONENT_TYPES.items() if isinstance(c.get(label), dict)]
            out += map(opened, inner)
    return out


def mended(answer: dict) -> dict:
    """An extraction whose screens have flat components and whose enums all have values, in either shape of a module."""

    def part(m: dict) -> dict:
        screens = m.get("screens")
        if isinstance(screens, list) and all(isinstance(s, dict) for s in screens):
            m = m | {"screens": [s | {"components": flat_components(s.get("components") or [])} for s in screens]}
        if isinstance(m.get("enums"), list):
            m = m | {"enums": [e for e in m["enums"] if isinstance(e, dict) and e.get("values")]}
        return m

    module = answer.get("module")
    if not isinstance(module, dict):
        return answer
    module = part(module)
    if isinstance(module.get("frontend"), dict):
        module = module | {"frontend": part(module["frontend"])}
    return answer | {"module": module}


def of_json(text: str | None) -> object:
    """The value of JSON text, or None."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def schema_fault(value: Column, schema: Mapping, name: str) -> Column:
    """first_fault of JSON text; text that isn't JSON is a fault of its own, null is null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return first_fault(json.loads(t), schema, name)
            except ValueError:
                return f"'{name}': not JSON"

        return texts.map(one).astype(object)

    return run(value)


def mended_json(value: Column) -> Column:
    """mended of JSON text; null where it is no JSON object."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(mended(x)) if isinstance(x := of_json(t), dict) else None).astype(object)

    return run(value)
