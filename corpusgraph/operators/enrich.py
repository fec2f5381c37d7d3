"""What is known of files beside their text, and the points made of them: chunks by the kind of file, with their payloads.

Indexes over all files (members of folders, users of packages) are joined to each file; a file's list of siblings is its
folder's list without itself. Chunks come from Arrow batches of one file's text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import chunking, classify, features, ids, modules, sections, syntax, text
from . import graph, loads

SYNTHETIC = "__synthetic__/"
#: What a document's category says of its text, and how the collections' names are.
DOC_TYPES = {"readme": "readme", "story": "storybook_story", "package_manifest": "package_manifest"}
SCRIPTS = ("typescript", "javascript")
STYLES = ("scss", "css")


def mentioned(body: Column, packages: Mapping[str, str]) -> tuple[Column, Column]:
    """Names of components and packages that a text mentions, both sorted."""
    return text.capitalised(body), F.array_sort(F.array_distinct(text.contained(body, sorted(set(packages.values())))))


def used_by(files: DataFrame, packages: Mapping[str, str]) -> DataFrame:
    """package_name and used_by_packages: the other packages whose scripts import it."""
    own = files.where(F.col("language").isin(*SCRIPTS)).select("package_name", F.explode(modules.dependencies(F.col("content"), packages)).alias("used"))
    pairs = graph.used_by(own, "package_name", "used")
    return pairs.groupBy(F.col("used").alias("package_name")).agg(F.array_sort(F.collect_set("user")).alias("used_by_packages"))


def enriched(files: DataFrame, packages: Mapping[str, str]) -> DataFrame:
    """Files (rel_path, package_name, language, content) with related_files, dependencies, used_by_packages,
    mentioned_components and mentioned_packages. packages: prefixes of specifiers, and the package of each."""
    nothing = F.array().cast("array<string>")
    real = files.where(~F.startswith("rel_path", F.lit(SYNTHETIC))).select(loads.folder_of(F.col("rel_path")).alias("_folder"), "rel_path")
    folders = graph.folder_members(real, "_folder", "rel_path")
    synthetic = F.startswith("rel_path", F.lit(SYNTHETIC))
    rows = files.withColumn("_folder", F.when(~synthetic, loads.folder_of(F.col("rel_path")))).join(folders, "_folder", "left").join(used_by(files, packages), "package_name", "left")
    components, named = mentioned(F.col("content"), packages)
    script = F.col("language").isin(*SCRIPTS)
    return rows.select(
        *files.columns, F.coalesce(F.array_remove("members", F.col("rel_path")), nothing).alias("related_files"), F.when(script, modules.dependencies(F.col("content"), packages)).otherwise(nothing).alias("dependencies"),
        F.coalesce("used_by_packages", nothing).alias("used_by_packages"), components.alias("mentioned_components"), named.alias("mentioned_packages"),
    )


def kind_of_chunks(category: Column, language: Column) -> Column:
    """Which chunker a package file's text goes to: code, style, markdown, config or types."""
    content = classify.category_content(category)
    code = F.when(language.isin(*STYLES), "style").otherwise("code")
    doc = F.when((category == "story") & (language != "markdown"), "code").otherwise("markdown")
    return F.when(content == "code", code).when(content == "doc", doc).when(category == "json_config", "config").otherwise("types")


ONE = "struct<text:string,name:string,type:string,exports:array<string>,imports:array<string>,props:array<string>,fields:array<string>,extends:array<string>>"


def chunks(files: DataFrame, kind: Column) -> DataFrame:
    """files with chunk_index, total_chunks and chunk (ONE): a row for each chunk. Markdown is cut at its headings, its
    sections then bounded in size; types that a file lacks make it code."""
    name = classify.stem(classify.base_name(F.col("rel_path")))
    rows = files.select(*files.columns, kind.alias("chunk_kind"), chunk_records(F.col("content"), name, kind).alias("_chunks"))
    return rows.select(*files.columns, "chunk_kind", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "chunk"))


SECTION = re.compile(r"^(#{1,3})\s+.+$", re.MULTILINE)


def records(text: str | None, stem: str | None, kind: str | None) -> list[dict] | None:
    """The chunks of a file of that kind, with the fields of ONE that they have; null for null."""
    if text is None:
        return None
    if kind == "types" and (found := syntax.type_records(text)):
        return [{"text": text[d.start : d.end].strip(), "name": d.name, "type": d.kind, "fields": d.fields, "extends": d.extends} for d in found]
    if kind in ("types", "code"):
        return [c._asdict() for c in syntax.component_chunks(text, stem or "")]
    if kind in ("style", "config"):
        pieces = sections.CHUNKERS[kind](text, stem or "")
    elif kind == "markdown":
        pieces = section_pieces(text, stem)
    else:
        return None
    return [dict(zip(("text", "name", "type"), p, strict=True)) for p in pieces]


def section_pieces(text: str, stem: str | None) -> list[sections.Piece]:
    """Of a Markdown text: sections at headings of levels 1 to 3, bounded in size."""
    text = re.sub(chunking.FRONT_MATTER.removeprefix("(?s)"), "", text, count=1, flags=re.DOTALL)
    parts = [(p, p.partition("\n")[0].lstrip("#").strip(), "section") for _, p in sections.starts(SECTION, text)]
    return sections.bounded(parts) if parts else [(text.strip(), stem, "section")]


def chunk_records(body: Column, stem: Column, kind: Column) -> Column:
    """records as a column: one pass through Python for all kinds, and no pandas."""
    out = to_arrow_schema(StructType.fromDDL(f"x array<{ONE}>")).field(0).type

    @F.arrow_udf(f"array<{ONE}>")
    def run(texts: pa.Array, stems: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([records(*x) for x in zip(texts.to_pylist(), stems.to_pylist(), kinds.to_pylist(), strict=True)], out)

    # else the filter that Spark adds below a generator would call it once more for each file
    return run.asNondeterministic()(body, stem, kind)


def unified_points(files: DataFrame, packages: Mapping[str, str], layers: Mapping[str, str], repo: str = "") -> DataFrame:
    """The points of package files (rel_path, file_id, package_name, module_path, file_category, language, content): ids,
    summary, and the payload of the content type, the others' columns null."""
    rows = chunks(enriched(files, packages), kind_of_chunks(F.col("file_category"), F.col("language")))
    kind, c = classify.category_content(F.col("file_category")), F.col("chunk")
    only = lambda what, x: F.when(kind == what, x)
    components, named = mentioned(c["text"], packages)
    blocks = text.code_blocks(c["text"])
    chunk_id = ids.hashed_chunk_id(F.col("rel_path"), F.col("chunk_index"), c["text"])
    return rows.select(
        ids.point_id(chunk_id).alias("point_id"), chunk_id.alias("chunk_id"), kind.alias("content_type"), F.lit(repo).alias("repo_name"), F.col("package_name").alias("namespace"), F.col("rel_path").alias("file_path"),
        classify.base_name(F.col("rel_path")).alias("file_name"), "file_id", "chunk_index", "total_chunks", "language", text.summary(c["text"], c["name"], c["type"]).alias("summary"), ids.text_hash(c["text"]).alias("text_hash"),
        F.current_timestamp().alias("ingested_at"), c["text"].alias("text"),
        only("code", F.col("file_category")).alias("file_category"), only("code", c["type"]).alias("chunk_type"), only("code", c["name"]).alias("symbol_name"), only("code", F.col("module_path")).alias("module_path"),
        only("code", classify.layer(F.col("package_name"), layers)).alias("module_layer"), only("code", c["props"]).alias("parameters"), only("code", c["exports"]).alias("exports"), only("code", c["imports"]).alias("imports"),
        only("code", F.col("dependencies")).alias("dependencies"), only("code", F.col("related_files")).alias("related_files"),
        only("doc", classify.looked_up(DOC_TYPES, F.col("file_category"), "usage_example")).alias("doc_type"), only("doc", c["name"]).alias("section_title"), only("doc", blocks["n"] > 0).alias("has_code_example"),
        only("doc", blocks["language"]).alias("code_language"), only("doc", F.when(F.size(components) > 0, components).otherwise(F.col("mentioned_components"))).alias("mentioned_symbols"),
        only("doc", F.when(F.size(named) > 0, named).otherwise(F.col("mentioned_packages"))).alias("mentioned_modules"),
        only("config", F.when(c["type"] == "json_config", F.lit("interface")).otherwise(c["type"])).alias("config_type"), only("config", c["name"]).alias("schema_name"),
        only("config", F.coalesce(c["fields"], F.array().cast("array<string>"))).alias("config_fields"), only("config", F.coalesce(c["extends"], F.array().cast("array<string>"))).alias("extends"),
    )


def example_points(files: DataFrame, scope: str, primitives: str) -> DataFrame:
    """The points of example files (path, file_name, example_id, example_group, file_id, related_files, content), by the
    loose rules: chunks with ids, what the file is and shows, and the packages that it imports."""
    found = loads.analysed(files, primitives, loose=True).withColumnRenamed("path", "rel_path").withColumn("language", F.when(classify.suffix(F.col("file_name")).isin(".ts", ".tsx"), "typescript").otherwise("javascript"))
    kind = F.when((F.col("file_role") == "types") & (F.col("language") == "typescript"), "types").otherwise("code")
    rows, c = chunks(found, kind), F.col("chunk")
    f = F.struct(*features.FLAGS, *features.LISTS)
    imported = modules.scoped_imports(F.col("content"), scope, loose=True)
    chunk_id = ids.hashed_chunk_id(F.col("rel_path"), F.col("chunk_index"), c["text"])
    use = features.use_case(F.col("example_id"), F.col("pattern"), F.col("file_role"), f, c["name"], loose=True)
    is_types, own = F.col("file_role") == "types", c["name"] != classify.stem(F.col("file_name"))
    nothing = F.array().cast("array<string>")
    config = F.when(F.col("file_role") == "config", F.when(F.contains("content", F.lit("DashboardConfig")), "DashboardConfig").when(F.contains("content", F.lit("JSONFormSchema")), "JSONFormSchema"))
    return rows.select(
        ids.point_id(chunk_id).alias("point_id"), chunk_id.alias("chunk_id"), F.col("rel_path").alias("file_path"), "file_name", "file_id", "chunk_index", "total_chunks", "language", "example_id", "example_group",
        F.col("pattern").alias("example_pattern"), "file_role", "complexity", F.lit(True).alias("is_verified"), use.alias("use_case"), imported["symbols"].alias("demonstrated_symbols"), c["name"].alias("symbol_name"), c["type"].alias("chunk_type"),
        F.coalesce(c["exports"], nothing).alias("exports"), F.coalesce(c["imports"], nothing).alias("imports"), F.coalesce(c["props"], nothing).alias("parameters"), imported["packages"].alias("packages"),
        *features.FLAGS, *features.LISTS, F.coalesce(config, F.lit("")).alias("config_type_name"), F.coalesce(c["fields"], nothing).alias("config_fields"), F.when(is_types & own, F.array(c["name"])).otherwise(nothing).alias("type_names"),
        F.when(is_types, F.coalesce(c["fields"], nothing)).otherwise(nothing).alias("type_fields"), "related_files", use.alias("summary"), ids.text_hash(c["text"]).alias("text_hash"), c["text"].alias("text"),
    )
