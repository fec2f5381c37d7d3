"""Map and reduce over a document's modules with an external model: segments, slices, calls, merges, plans.

The model is a function from a prompt to an answer, given by the caller; calls run in Arrow batches on the executors, with
tries that wait longer each time. Everything around the calls is declared on tables.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coercion, sections, text, validate
from . import aggregate, graph

# Tokens of a call, tries of a call and of an invalid answer, and the status codes after which a call is tried again.
INPUT_TOKENS, LEAST_TOKENS = 12_000, 1000
TRIES, SCHEMA_RETRIES, FIRST_WAIT = 3, 2, 1.0
RETRIED = (429, 500, 502, 503, 504)
#: Fixed value: places of headings that the document doesn't have.
NOWHERE = 10_000
UNKNOWN_ORDER = 999
#: What there is for a document without modules.
WHOLE = ("Application", "", 1, "Full document")

Model = Callable[[str], str]


class CallFailed(Exception):
    """A failed call; status: the server's code, if any."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def tried(call: Callable[[], str], tries: int = TRIES, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> str:
    """The result of a call that may fail a few times; the wait doubles. A status that isn't in RETRIED ends it at once."""
    for n in range(tries):
        try:
            return call()
        except CallFailed as e:
            if n + 1 == tries or (e.status is not None and e.status not in RETRIED):
                raise
            sleep(wait * 2**n)
    raise AssertionError


def valid_answer(model: Model, prompt: str, schema: Mapping, name: str, mend: Callable[[dict], dict] | None = None, retries: int = SCHEMA_RETRIES, **how) -> tuple[dict, int]:
    """An answer that fits the schema, and how many calls it took; after an invalid one the prompt says what was wrong."""
    asked = prompt
    for n in range(1, retries + 2):
        raw = tried(lambda p=asked: model(p), **how)
        try:
            got = coercion.parsed(raw)
            got = mend(got) if mend else got
            if fault := validate.first_fault(got, schema, name):
                raise ValueError(fault)
            return got, n
        except ValueError as e:
            if n > retries:
                raise RuntimeError(f"no valid answer for '{name}' after {n} calls: {e}") from e
            asked = f"{prompt}\n\nThe last answer could not be used ({e}). Answer again with nothing but one JSON value in the form that was asked for."
    raise AssertionError


# Segments and slices.


def segments(headings: DataFrame, classified: DataFrame, document: str = "document") -> DataFrame:
    """document, name, heading, level, description, position of each module, in the order of the document.

    headings: document, pos, level, text. classified: document, heading, type, module_name, description, as a classifier of
    the candidates (aggregate.module_candidates) gives them. Kept are the MODULE ones, each heading once; headings that
    the document lacks come last; names that are empty or of more than 8 words are made from the heading. A document
    without modules is one."""
    clean = aggregate.clean_headings(headings, document, "pos", "level", "text")
    place = clean.withColumn("doc_pos", F.row_number().over(Window.partitionBy(document).orderBy("pos")) - 1).select(document, F.col("text").alias("heading"), "level", "doc_pos")
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kept = classified.where("type = 'MODULE'").withColumn("heading", trimmed("heading")).where("heading <> ''")
    kept = kept.groupBy(document, "heading").agg(F.min_by(F.struct("module_name", "description"), F.col("n")).alias("x")).select(document, "heading", "x.*")
    own = trimmed("module_name")
    named = F.when((own == "") | (F.size(F.split(own, r"\s+")) > 8), text.module_name(F.col("heading"))).otherwise(own)
    rows = kept.join(place, [document, "heading"], "left").withColumn("name", named)
    rows = rows.withColumn("description", F.when(trimmed("description") != "", trimmed("description")).otherwise(F.concat(F.lit("Requirements for "), F.col("name"))))
    rows = rows.select(document, "name", "heading", F.coalesce("level", F.lit(2)).alias("level"), "description", F.coalesce("doc_pos", F.lit(NOWHERE)).alias("_at"))
    bare = headings.select(document).distinct().join(rows.select(document), document, "left_anti")
    bare = bare.select(document, *[F.lit(v).alias(k) for k, v in zip(("name", "heading", "level", "description"), WHOLE, strict=True)], F.lit(0).alias("_at"))
    every = rows.unionByName(bare)
    return every.withColumn("position", F.row_number().over(Window.partitionBy(document).orderBy("_at", "heading")) - 1).drop("_at")


def slices(modules: DataFrame, documents: DataFrame, document: str = "document", body: str = "text") -> DataFrame:
    """document, position, name, text: each module's part of the document, up to the next module's heading."""
    label = F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("name"))
    rows = modules.withColumn("_label", label).withColumn("_next", F.lead("_label").over(Window.partitionBy(document).orderBy("position")))
    joined = rows.join(documents.select(document, body), document)
    return joined.select(document, "position", "name", text.section_between(F.col(body), F.col("_label"), F.col("_next")).alias("text"))


def budget(overhead: int) -> int:
    """Tokens that are left for a module's text."""
    return max(INPUT_TOKENS - overhead, LEAST_TOKENS)


# Merging parts of a module.


def first_of(items: Iterable, key: Callable[[object], object], unnamed: bool = False) -> list:
    """The first item of each key. unnamed: items of an empty key all stay."""
    seen: set = set()
    out = []
    for x in items:
        k = key(x)
        if (unnamed and not k) or k not in seen:
            out.append(x)
        seen.add(k)
    return out


def by_name(items: list) -> list:
    return first_of(items, lambda x: x.get("name", ""), unnamed=True)


def by_endpoint(items: list) -> list:
    return first_of(items, lambda x: (x.get("method", "").upper(), x.get("path", "")))


def by_text(items: list) -> list:
    """By the item itself, or by the first text in it, or by all of it."""
    return first_of(items, lambda x: x if isinstance(x, str) else next((v for v in x.values() if isinstance(v, str)), repr(x)) if isinstance(x, dict) else repr(x))


#: The lists of each side of a module, and what tells their items apart.
FRONTEND = {"screens": by_name, "enums": by_name, "business_rules": by_text, "workflows": by_text}
BACKEND = {"api_endpoints": by_endpoint, "models": by_name, "business_logic": by_text, "workflows": by_text}


def merged(parts: list[dict], mode: str, name: str) -> dict:
    """Extractions of a module's parts as one: lists follow each other, the first of each item stays; the first description
    that isn't empty. A single part stays as it is."""
    if len(parts) < 2:
        return parts[0] if parts else {"module": {"name": name}}
    modules = [p.get("module", {}) for p in parts]
    lists = lambda sides, table: {k: only([x for s in sides for x in s.get(k, [])]) for k, only in table.items()}
    out = {"name": name, "description": next((m["description"] for m in modules if m.get("description")), None)}
    if mode == "both":
        out |= {side: lists([m.get(side, {}) for m in modules], table) for side, table in (("frontend", FRONTEND), ("backend", BACKEND))}
    else:
        out |= lists(modules, FRONTEND if mode == "frontend" else BACKEND)
    return {"module": out}


def merged_parts(parts: DataFrame, mode: str, keys: Sequence[str] = ("document", "name")) -> DataFrame:
    """keys, extraction: the JSON extractions of each module's parts (part, extraction) as one. A module has few parts."""

    @F.pandas_udf("string")
    def run(found: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(merged([json.loads(x) for x in part], mode, n or "")) for part, n in zip(found, names, strict=True)], dtype=object)

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "extraction"))), lambda x: x["extraction"])
    return parts.groupBy(*keys).agg(ordered.alias("_parts")).select(*keys, run("_parts", F.col(keys[-1])).alias("extraction"))


# Calls.


def extracted(rows: DataFrame, model: Model, template: str, schema: Mapping, mode: str, overhead: int = 0, keys: Sequence[str] = ("document", "position", "name"), parallel: int | None = None) -> DataFrame:
    """keys, part, extraction, calls, error: one call for each part of a slice (text) that fits the budget. The template
    has {module_name} and {module_text}. What fails is told in error, and its extraction is null. parallel: how many calls
    may run at once, as partitions."""
    rows = rows if parallel is None else rows.repartition(parallel)
    most, columns = budget(overhead), list(keys)

    def one(name: str, body: str) -> Iterator[tuple]:
        parts = [body] if sections.quarter(body) <= most else sections.module_parts(body, most, name, most=None)
        for i, part in enumerate(parts):
            prompt = template.replace("{module_name}", name).replace("{module_text}", part)
            try:
                got, n = valid_answer(model, prompt, schema, "extraction", validate.mended)
                yield i, json.dumps(got), n, None
            except (RuntimeError, CallFailed) as e:
                yield i, None, 0, str(e)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(*[r[k] for k in columns], *x) for _, r in df.iterrows() for x in one(r["name"], r["text"])]
            yield pd.DataFrame(out, columns=[*columns, "part", "extraction", "calls", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return rows.select(*columns, "text").mapInPandas(run, f"{kinds}, part int, extraction string, calls int, error string")


def references(components: Sequence[dict]) -> Iterator[str]:
    """Screens that toolbars, grids and tabs among components open."""
    for c in components:
        for action in {"toolbar": c.get("actions", []), "grid": c.get("row_actions", [])}.get(c.get("type"), []):
            if action.get("opens_screen"):
                yield action["opens_screen"]
        if c.get("type") == "tabs":
            for tab in c.get("children", []):
                yield from references(tab.get("components", []))


def unknown_screens(extraction: Column) -> Column:
    """array<struct<screen, opens>>: what screens of an extraction's JSON open that no screen of the module is named; null where it is no JSON object."""

    @F.pandas_udf("array<struct<screen:string,opens:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict] | None:
            x = validate.of_json(t)
            if not isinstance(x, dict):
                return None
            module = x.get("module") or {}
            screens = (module.get("frontend") or module).get("screens", [])
            known = {s.get("name", "") for s in screens}
            return [{"screen": s.get("name"), "opens": r} for s in screens for r in references(s.get("components", [])) if r not in known]

        return texts.map(one).astype(object)

    return run(extraction)


def finished(merges: DataFrame, modules: DataFrame, document: str = "document") -> DataFrame:
    """document, number, name, extraction: modules in the order of their segments, unknown ones last; a name in the
    extraction stands instead of the segment's."""
    out = aggregate.numbered_merge(merges, modules.select(document, "name", "position"), "name", "position", UNKNOWN_ORDER, document)
    own = F.get_json_object("extraction", "$.module.name")
    return out.select(document, "number", F.coalesce(own, "name").alias("name"), "extraction")


def dependency_graph(modules: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graph.hygiene of a model's graph (nodes: id; edges: src, dst, kind) by the modules' names (name)."""
    from ..functions import ids

    return graph.hygiene(nodes, edges, modules.select(ids.module_id(F.col("name")).alias("id")), ["depends_on", "calls"])


# Plans.


def priorities(modules: DataFrame, nodes: DataFrame | None = None, document: str = "document") -> DataFrame:
    """document, name, priority: a graph node's priority, order or 1 (the last node of a name counts), else the module's place, from 1."""
    own = modules.where(F.coalesce("name", F.lit("")) != "").groupBy(document, "name").agg(F.min("position").alias("position"))
    if nodes is None:
        return own.select(document, "name", (F.col("position") + 1).alias("priority"))
    given = F.coalesce(F.nullif("priority", F.lit(0)), F.nullif("order", F.lit(0)), F.lit(1))
    told = nodes.where(F.coalesce("name", F.lit("")) != "").groupBy(document, "name").agg(F.max_by(given, F.col("n")).alias("_p"))
    return own.join(told, [document, "name"], "left").select(document, "name", F.coalesce("_p", F.col("position") + 1).alias("priority"))


def ordered_plans(plans: DataFrame, document: str = "document") -> DataFrame:
    """Plans (module_name, priority, screens, file_structure: arrays) with number and the document's totals; without a priority they come last."""
    rank = F.coalesce(F.nullif("priority", F.lit(0)), F.lit(UNKNOWN_ORDER))
    by, whole = Window.partitionBy(document).orderBy(rank, "module_name"), Window.partitionBy(document)
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    out = plans.withColumn("number", F.row_number().over(by)).withColumn("total_modules", F.count("*").over(whole))
    return out.withColumn("total_screens", F.sum(n("screens")).over(whole)).withColumn("total_files", F.sum(n("file_structure")).over(whole))


def similarity_queries(plans: DataFrame, document: str = "document") -> DataFrame:
    """document, module_name, queries: a module's query, then each screen's and its components', empty ones left out; the
    last plan of a name counts. plans: n, module_name, similarity_query, screens (array of similarity_query and components
    with similarity_query)."""
    texts = lambda s: F.concat(F.array(s["similarity_query"]), F.transform(s["components"], lambda c: c["similarity_query"]))
    every = F.concat(F.array("similarity_query"), F.flatten(F.transform("screens", texts)))
    rows = plans.withColumn("queries", F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""))
    return rows.groupBy(document, "module_name").agg(F.max_by("queries", "n").alias("queries"))


def shared_context(modules: DataFrame, context: DataFrame, document: str = "document") -> DataFrame:
    """Each module with what its document's modules share (one row a document)."""
    return modules.join(context, document)


def screen_count(extraction: Column) -> Column:
    """Screens of a frontend module's JSON."""
    return F.coalesce(F.json_array_length(F.get_json_object(extraction, "$.module.screens")), F.lit(0))


def planned(modules: DataFrame, model: Model, template: str, schema: Mapping, keys: Sequence[str] = ("document", "name"), parallel: int | None = None) -> DataFrame:
    """keys, plan, calls, error of modules (keys, module: text, priority, context): one call each; the template has
    {module}, {context} and {priority}. A plan's modules get their priority where they have none."""
    columns = list(keys)
    rows = modules if parallel is None else modules.repartition(parallel)

    def one(r: Mapping) -> tuple:
        prompt = template.replace("{module}", r["module"]).replace("{context}", r["context"] or "").replace("{priority}", str(r["priority"]))
        try:
            got, n = valid_answer(model, prompt, schema, "plan")
            return json.dumps({"priority": int(r["priority"])} | {k: v for k, v in got.items() if k != "priority" or v}), n, None
        except (RuntimeError, CallFailed) as e:
            return None, 0, str(e)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame([(*[r[k] for k in columns], *one(r)) for _, r in df.iterrows()], columns=[*columns, "plan", "calls", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return rows.select(*columns, "module", "priority", "context").mapInPandas(run, f"{kinds}, plan string, calls int, error string")


def submitted(uploads: DataFrame, kind: str) -> DataFrame:
    """A pending job for each upload (name, content_type, mode, content) that passes the checks and has text; code and message of the others.

    id, job_type, status, code, message, mode, text, headings, updated_at."""
    from ..sources.uploads import documents

    fault = F.coalesce(validate.upload_fault(F.col("name")), validate.size_fault(F.octet_length("content")), validate.mode_fault(F.col("mode")))
    rows = uploads.withColumn("_fault", fault).withColumn("_d", documents(F.when(fault.isNull(), F.col("content")), F.col("name"), F.col("content_type")))
    empty = F.coalesce(F.col("_d.text"), F.lit("")) == ""
    code = F.when(F.col("_fault").isNotNull(), F.col("_fault.status")).when(empty, 422).otherwise(202)
    message = F.when(F.col("_fault").isNotNull(), F.col("_fault.message")).when(empty, F.coalesce("_d.error", F.lit("no text")))
    return rows.select(F.uuid().alias("id"), F.lit(kind).alias("job_type"), F.when(code == 202, "pending").alias("status"), code.alias("code"), message.alias("message"), "name", "mode", F.col("_d.text").alias("text"), F.col("_d.headings").alias("headings"), F.current_timestamp().alias("updated_at"))
