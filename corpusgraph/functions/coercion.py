"""Answers of external models as JSON: fences off, one of several shapes as a list of modules, values of the wrong type as text or null."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may hold the list or the name, and fields that are text or null.
LIST_KEYS = ("modules", "plan", "data", "result", "plans")
NAME_KEYS = ("module_name", "name", "module", "moduleName", "module_title", "title")
TEXT_FIELDS = {"fields": ("default_value", "visible_when", "required_when", "disabled_when"), "filters": ("default_value",)}
FENCE = re.compile(r"\A\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*\Z", re.DOTALL)


def parsed(answer: str) -> object:
    """The JSON of an answer, in a fence or not. ValueError where there is none."""
    m = FENCE.match(answer)
    return json.loads(m[1] if m else answer)


def text_or_null(value: object) -> str | None:
    """Null for null, false and the empty text; objects and lists as JSON, true as "true", the rest as text."""
    if value is None or value is False or value == "":
        return None
    if isinstance(value, str):
        return value
    return json.dumps(value) if isinstance(value, dict | list | bool) else str(value)


def options(value: object) -> list[str]:
    return [x if isinstance(x, str) else str(x) for x in value] if isinstance(value, list) else []


def component(item: dict) -> dict:
    """With text or null where a field's or filter's value must be, texts as options, and a column's color_logic as text."""
    out = dict(item)
    for part, names in TEXT_FIELDS.items():
        if part in item:
            out[part] = [x | {n: text_or_null(x.get(n)) for n in names} | ({"options": options(x["options"])} if "options" in x else {}) for x in item[part]]
    if "columns" in item:
        logic = lambda v: "True" if v is True else v if v == "" else text_or_null(v)
        out["columns"] = [x | {"color_logic": logic(x["color_logic"])} if "color_logic" in x else x for x in item["columns"]]
    return out


def module(item: dict) -> dict:
    """With a name from the first key that has one, and its components coerced."""
    name = next((item[k] for k in NAME_KEYS if item.get(k)), None)
    out = item | ({"module_name": name} if name else {})
    if "screens" in item:
        out["screens"] = [s | ({"components": [component(c) for c in s["components"]]} if "components" in s else {}) for s in item["screens"]]
    return out


def modules(raw: object) -> Iterator[dict]:
    """Of a list, an object that holds it, or a bare object. ValueError for anything else."""
    if isinstance(raw, dict):
        raw = next((raw[k] for k in LIST_KEYS if isinstance(raw.get(k), list)), [raw])
    if not isinstance(raw, list):
        raise ValueError("neither a list nor an object")
    return map(module, raw)


def plan_modules(answer: Column) -> Column:
    """Each answer's modules as JSON texts; null where it has no such JSON."""

    @F.pandas_udf("array<string>")
    def run(answers: pd.Series) -> pd.Series:
        def one(a: str | None) -> list[str] | None:
            try:
                return None if a is None else [json.dumps(m) for m in modules(parsed(a))]
            except (ValueError, TypeError, AttributeError):
                return None

        return pd.Series([one(a) for a in answers], dtype=object)

    return run(answer)


def coerced(item: Column) -> Column:
    """A component's JSON with its values coerced; null where it is no JSON object."""

    @F.pandas_udf("string")
    def run(items: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                x = None if t is None else json.loads(t)
                return json.dumps(component(x)) if isinstance(x, dict) else None
            except (ValueError, TypeError, AttributeError):
                return None

        return items.map(one).astype(object)

    return run(item)
