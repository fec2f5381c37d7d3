"""Node and edge tables made from source files, from a table of knowledge on packages, and from example folders.

Every table is one set-based plan: no row is inserted by itself. Nodes are unique by key (the first counts), edges by both
ends. Nulls in keys take no part. graph_tables writes tables as Parquet, all or some of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, features, modules
from . import aggregate
from .graph import load_edges, load_nodes

CODE_TABLES = ("source_file", "exported_symbol", "file_belongs_to", "exports_symbol", "imports_from", "imports_package", "re_exports_from", "symbol_linked_to_component")


def node_id(package: Column, name: Column) -> Column:
    return F.concat_ws("::", package, name)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def packages(manifests: DataFrame, root: str = "packages") -> DataFrame:
    """folder and package_name of manifests (path, content) at root/<folder>/package.json that are JSON with a name."""
    name = F.get_json_object("content", "$.name")
    return manifests.where(F.col("path").rlike(rf"(^|/){root}/[^/]+/package\.json$") & (F.coalesce(name, F.lit("")) != "")).select(folder_of(F.col("path")).alias("folder"), name.alias("package_name"))


def package_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, package_name, rel_path, content of the TypeScript files (path, content) in a package's src folder, or in the
    package where it has none."""
    parts = F.split("path", "/")
    kept = files.where(~classify.graph_skipped(F.col("path"))).withColumn("folder", F.array_join(F.slice(parts, 1, 2), "/"))
    own = kept.join(known, "folder").withColumn("rel_path", F.substr("path", F.length("folder") + 2)).withColumn("_src", F.startswith("rel_path", F.lit("src/")))
    with_src = own.groupBy("folder").agg(F.max("_src").alias("_has"))
    return own.join(with_src, "folder").where(F.col("_src") | ~F.col("_has")).select("path", "package_name", "rel_path", "content")


def source_files(files: DataFrame) -> DataFrame:
    """Nodes of files (path, package_name, rel_path, content)."""
    name = classify.base_name(F.col("rel_path"))
    rows = files.select(node_id(F.col("package_name"), F.col("rel_path")).alias("id"), name.alias("file_name"), "rel_path", "package_name", classify.graph_file_type(name, F.col("content")).alias("file_type"))
    return load_nodes(rows, "id")


def symbols(files: DataFrame) -> DataFrame:
    """file, id, name, symbol_type, package_name of each export of each file."""
    rows = files.select(node_id(F.col("package_name"), F.col("rel_path")).alias("file"), "package_name", F.explode(modules.typed_exports(F.col("content"))).alias("e"))
    return rows.select("file", node_id(F.col("package_name"), F.col("e.name")).alias("id"), F.col("e.name").alias("name"), F.col("e.symbol_type").alias("symbol_type"), "package_name")


def statements(files: DataFrame) -> DataFrame:
    """file, path, package_name, kind (import, star, list), pos, specifier, names of each statement that reads another module."""
    content = F.col("content")
    stars = F.transform(modules.star_exports(content), lambda x: F.struct(x.alias("specifier"), F.array().cast("array<string>").alias("names")))
    every = {"import": modules.import_statements(content), "star": stars, "list": modules.named_exports_from(content)}

    def tagged(kind: str) -> Column:
        return F.transform(every[kind], lambda e, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), e["specifier"].alias("specifier"), e["names"].alias("names")))

    rows = files.select(node_id(F.col("package_name"), F.col("rel_path")).alias("file"), "path", "package_name", F.explode(F.concat(*map(tagged, every))).alias("s"))
    return rows.select("file", "path", "package_name", "s.kind", "s.pos", "s.specifier", "s.names")


def resolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """Statements with a relative specifier whose target exists, with target (the id): the first candidate path that is a file.

    Each path that an import may name has its best file, by an aggregate of the files; statements join that once. The join
    is one by a shuffle: files are made by expressions and exploded, so sizes of their tables are guessed far too low."""
    near = found.where(F.startswith("specifier", F.lit("."))).withColumn("_base", modules.named_path(folder_of(F.col("path")), F.col("specifier")))
    places = files.select(node_id(F.col("package_name"), F.col("rel_path")).alias("target"), F.explode(modules.names_of_path(F.col("path"))).alias("x"))
    best = places.groupBy(F.col("x.base").alias("_base")).agg(F.min_by("target", F.struct("x.rank", "target")).alias("target"))
    return near.join(best.hint("merge"), "_base").drop("_base")


def first_edges(rows: DataFrame) -> DataFrame:
    """One edge of each pair of ends: the names of its first statement, imports before lists."""
    return rows.groupBy("src", "dst").agg(F.min_by("names", F.struct("kind", "pos")).alias("import_specifiers"))


def package_imports(found: DataFrame, known: DataFrame, scope: str) -> DataFrame:
    """src, dst, import_specifiers: files to the other packages that they read. A specifier inside a package counts for it."""
    s = F.col("specifier")
    base = F.when(F.startswith(s, F.lit("@")), F.array_join(F.slice(F.split(s, "/"), 1, 2), "/")).otherwise(s)
    named = found.where((F.col("kind") != "star") & ~F.startswith(s, F.lit("."))).withColumn("dst", base)
    named = named.where(F.startswith(s, F.lit(scope)) | (F.col("kind") == "import"))
    rows = named.where(F.col("dst") != F.col("package_name")).join(known.select(F.col("package_name").alias("dst")).distinct(), "dst", "left_semi")
    return first_edges(rows.withColumnRenamed("file", "src"))


def code_graph(files: DataFrame, known: DataFrame, components: DataFrame, scope: str) -> dict[str, DataFrame]:
    """The CODE_TABLES of files (path, package_name, rel_path, content), packages (package_name) and components (id, name)."""
    nodes, exported, found = source_files(files), symbols(files), statements(files)
    near = resolved(found, files).select(F.col("file").alias("src"), F.col("target").alias("dst"), "kind", "pos", "names")
    first = exported.groupBy("id").agg(F.min_by(F.struct("name", "symbol_type", "package_name"), "file").alias("x")).select("id", "x.*")
    last = components.groupBy("name").agg(F.max("id").alias("dst"))
    return {
        "source_file": nodes,
        "exported_symbol": first,
        "file_belongs_to": nodes.select(F.col("id").alias("src"), F.col("package_name").alias("dst")),
        "exports_symbol": load_edges(exported.select(F.col("file").alias("src"), F.col("id").alias("dst"))),
        "imports_from": first_edges(near.where("kind <> 'star'")),
        "imports_package": package_imports(found, known, scope),
        "re_exports_from": load_edges(near.where("kind = 'star'").select("src", "dst")),
        "symbol_linked_to_component": first.join(last.hint("merge"), "name").select(F.col("id").alias("src"), "dst"),
    }


def knowledge_graph(knowledge: DataFrame, typedefs: DataFrame, uses_type: DataFrame, shown: Mapping[str, Sequence[str]], field_types: Mapping[str, Sequence[str]], labels: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables of the semantic graph.

    knowledge: import_path, package_description, name, description, when_to_use, do_not_use_when, internally_uses, hooks.
    typedefs: id, name, description, required_fields. uses_type: src, dst, role. shown, field_types: component id to the
    features or field types that it has. labels: of features."""
    spark = knowledge.sparkSession
    own = knowledge.withColumn("id", node_id(F.col("import_path"), F.col("name")))
    components = load_nodes(own.select("id", "name", classify.component_type(F.col("name")).alias("component_type"), "description", "when_to_use", "do_not_use_when"), "id")
    by_name = own.groupBy("name").agg(F.max("id").alias("dst"))

    def named(column: str, word: Column) -> DataFrame:
        """Edges to the components named in an array."""
        asked = own.select(F.col("id").alias("src"), F.explode(column).alias("x")).select("src", word.alias("name"))
        return load_edges(asked.join(by_name, "name").select("src", "dst"))

    def static(table: Mapping[str, Sequence[str]]) -> DataFrame:
        return load_edges(spark.createDataFrame([(k, x) for k, v in table.items() for x in v], "src string, dst string"))

    first_word = F.regexp_replace(F.element_at(F.split(F.trim("x"), r"\s+"), 1), r"\(+$", "")
    every = sorted({x for v in field_types.values() for x in v})
    return {
        "package": load_nodes(knowledge.select(F.col("import_path").alias("name"), "import_path", F.col("package_description").alias("description")), "name"),
        "component": components,
        "typedef": load_nodes(typedefs, "id"),
        "feature": spark.createDataFrame(list(labels.items()), "name string, label string"),
        "fieldtype": spark.createDataFrame([(x,) for x in every], "name string"),
        "belongs_to": load_edges(own.select(F.col("id").alias("src"), F.col("import_path").alias("dst"))),
        "internally_uses": named("internally_uses", F.col("x")).withColumn("note", F.lit("")),
        "uses_hook": named("hooks", first_word),
        "uses_type": load_edges(uses_type),
        "exhibits_feature": static(shown),
        "supports_field_type": static(field_types),
    }


def context_text(knowledge: DataFrame) -> DataFrame:
    """import_path and text: what a prompt says of a package, its components in the order of their names."""
    # The labels.
    some = lambda head, x, sep: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(x, sep)))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("  • "), F.col("name")), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("    "), "description")), some("    USE WHEN: ", F.col("when_to_use"), " | "),
        some("    DO NOT USE: ", F.col("do_not_use_when"), " | "), some("    data_hook: ", F.col("hooks"), ", "), some("    internally_uses: ", F.col("internally_uses"), ", "),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("name", lines.alias("text")))), lambda x: x["text"])
    found = knowledge.groupBy("import_path").agg(F.first("package_description").alias("_d"), parts.alias("_parts"))
    return found.select("import_path", F.concat_ws("\n", F.concat(F.lit("["), "import_path", F.lit("]")), F.concat(F.lit("  "), "_d"), F.lit(""), F.array_join("_parts", "\n"), F.lit("")).alias("text"))


def component_ids(names: DataFrame, components: DataFrame, name: str = "name") -> DataFrame:
    """names with the id of the component of exactly that name (the last one counts); null without one."""
    last = components.groupBy(name).agg(F.max("id").alias("id"))
    return names.join(last, name, "left")


def analysed(files: DataFrame, primitives: str, loose: bool = False) -> DataFrame:
    """Example files (example_group, example_id, file_name, path, content) with pattern, role, features (columns of flags and lists) and complexity."""
    source, name = F.col("content"), F.col("file_name")
    rows = files.withColumn("pattern", features.pattern(source, F.col("path"), loose)).withColumn("file_role", features.role(name, source, primitives, loose))
    rows = rows.withColumn("_f", features.features(source, F.col("pattern"), loose)).withColumn("complexity", features.complexity(source, F.col("file_role"), F.col("_f"), loose))
    return rows.select(*files.columns, "pattern", "file_role", "complexity", "_f.*")


RANKS = ("simple", "medium", "complex")


def examples(found: DataFrame) -> DataFrame:
    """One row for each example folder of analysed files: the dominant pattern, the union of features, the greatest complexity, files and a line on its use."""
    key = "example_id"
    flags = aggregate.union_flags(found, key, features.FLAGS, features.LISTS)
    shown, worst = aggregate.dominant(found, key, "pattern", "file_name"), aggregate.ordinal_max(found, key, "complexity", RANKS)
    rest = found.groupBy(key).agg(F.min("example_group").alias("example_group"), F.array_sort(F.collect_set("file_name")).alias("files"))
    rows = flags.join(shown, key).join(worst, key).join(rest, key)
    f = F.struct(*features.FLAGS, *features.LISTS)
    return rows.withColumn("use_case", features.use_case(F.col(key), F.col("pattern"), F.lit("summary"), f, F.lit("")))


def example_graph(found: DataFrame, component_package: str, field_types: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of analysed example files: examples, their files, and edges to files, components, features and field types."""
    sets = examples(found)
    file_id = node_id(F.col("example_id"), F.col("file_name"))
    flags = F.explode(features.active(F.struct(*features.FLAGS)))
    src = F.col("example_id").alias("src")
    return {
        "example": sets.select("example_id", "example_group", "pattern", "complexity", "use_case", F.array().cast("array<string>").alias("chunk_ids")),
        "example_file": load_nodes(found.select(file_id.alias("id"), "file_name", "file_role", F.col("path").alias("file_path")), "id"),
        "has_file": load_edges(found.select(src, file_id.alias("dst"))),
        "demonstrates_component": sets.where(F.col("pattern") != "unknown").select(src, node_id(F.lit(component_package), F.col("pattern")).alias("dst")),
        "example_exhibits_feature": sets.select(src, flags.alias("dst")),
        "exhibits_field_type": sets.select(src, F.explode(features.among(F.col("field_types_used"), tuple(field_types))).alias("dst")),
    }


def with_chunk_ids(nodes: DataFrame, chunks: DataFrame, key: str = "example_id") -> DataFrame:
    """Nodes whose chunk_ids become those of chunks (key, chunk_id), in order; nodes without chunks keep theirs."""
    found = chunks.groupBy(key).agg(F.array_sort(F.collect_set("chunk_id")).alias("_ids"))
    return nodes.join(found, key, "left").withColumn("chunk_ids", F.coalesce("_ids", "chunk_ids")).drop("_ids")


def write_graph(tables: Mapping[str, DataFrame], path: str, only: Sequence[str] | None = None) -> None:
    """Each table in a folder of its own, replaced as a whole. only: those tables alone, others stay (as CODE_TABLES)."""
    for name, df in tables.items():
        if only is None or name in only:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def expressions(tables: Mapping[str, DataFrame], text: str, **values: object) -> DataFrame:
    """An ad-hoc SQL query over the tables as views; what it can't do is raised with the query's text."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text, values or None)
    except Exception as e:
        raise ValueError(f"{e}\nquery: {text}") from e
