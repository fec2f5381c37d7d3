"""Scans of source trees: files as rows, with names, categories and hashes; manifests as text; workspaces of several sources.

Skip rules are conditions on the files' metadata, so skipped folders and files are never opened.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify


def bare(path: Column) -> Column:
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/+|^/+", "")


def under(root: str, path: Column, encoded: bool) -> Column:
    """What follows the root in a path."""
    base = root.split(":", 1)[-1].strip("/")
    return F.regexp_replace(F.substr(bare(path), F.lit(len(quote(base) if encoded else base) + 1)), "^/+", "")


def opened(spark: SparkSession, root: str, skipped) -> DataFrame:
    """rel_path, length, content of the files under root that skipped(path, size) lets through."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = raw.where(~skipped(under(root, F.col("_metadata.file_path"), True), F.col("_metadata.file_size")))
    return kept.select(under(root, F.col("path"), False).alias("rel_path"), "length", "content")


def scan(spark: SparkSession, root: str, namespaces: Mapping[str, str] | None = None, layers: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each file that isn't skipped: rel_path, namespace, file_name, category, language, content_type,
    module_layer, content_hash, size_bytes, content.

    namespaces: folders under root that are scanned, and the package of each; without them the whole root, namespace null.
    layers: of packages."""
    rows = opened(spark, root, classify.skipped)
    name = classify.base_name(F.col("rel_path"))
    space = F.lit(None).cast("string")
    for folder, package in sorted((namespaces or {}).items(), key=lambda x: len(x[0])):
        space = F.when(F.startswith("rel_path", F.lit(folder.strip("/") + "/")), F.lit(package)).otherwise(space)
    rows = rows.withColumn("namespace", space)
    if namespaces:
        rows = rows.where("namespace IS NOT NULL")
    content = F.decode("content", "UTF-8")
    return rows.select(
        "rel_path",
        "namespace",
        name.alias("file_name"),
        classify.category(F.col("rel_path"), name).alias("category"),
        classify.language(name).alias("language"),
        classify.content_type(name).alias("content_type"),
        classify.layer(F.col("namespace"), layers or {}).alias("module_layer"),
        F.sha2(content, 256).alias("content_hash"),
        F.col("length").alias("size_bytes"),
        content.alias("content"),
    )


def ranked_union(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of several sources; of a key that more have, the first source's."""
    out = parts[0].withColumn("_rank", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_rank", F.lit(i)), allowMissingColumns=True)
    cols = [c for c in out.columns if c not in (key, "_rank")]
    return out.groupBy(key).agg(F.min_by(F.struct(*cols), "_rank").alias("_x")).select(key, "_x.*")


MANIFEST = "name string, version string, description string, dependencies map<string,string>, peerDependencies map<string,string>, scripts map<string,string>"


def manifest_text(manifest: Column, package: Column | None = None) -> Column:
    """A package manifest as text: name (else the package's) and version, description, sorted dependencies and peers, names of scripts; null if it isn't JSON."""
    v = F.from_json(manifest, MANIFEST)
    sorted_pairs = lambda m: F.array_sort(F.map_entries(m))
    tag = lambda e: F.when(F.startswith(e["value"], F.lit("workspace:")), F.lit("(workspace)")).otherwise(e["value"])
    line = lambda label, x: F.concat(F.lit(label), x)
    listed = lambda title, m, shown: F.when(F.size(m) > 0, F.concat(F.lit(title + ":\n"), F.array_join(F.transform(sorted_pairs(m), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(" "), shown(e))), "\n"), F.lit("\n")))
    name = F.coalesce(v["name"], F.lit(None).cast("string") if package is None else package, F.lit(""))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Package: "), name, F.lit(" v"), F.coalesce(v["version"], F.lit("unknown"))),
        F.when(F.coalesce(v["description"], F.lit("")) != "", line("Description: ", v["description"])),
        F.lit(""),
        listed("Dependencies", v["dependencies"], tag),
        listed("Peer Dependencies", v["peerDependencies"], lambda e: e["value"]),
        F.when(F.size(v["scripts"]) > 0, line("Scripts: ", F.array_join(F.array_sort(F.map_keys(v["scripts"])), ", "))),
    )
    return F.when(F.try_parse_json(manifest).isNotNull() & v.isNotNull(), body)


def workspace(spark: SparkSession, root: str, layers: Mapping[str, str] | None = None, package_files: Sequence[str] = ("README.md", "package.json"), extra: Mapping[str, str] | None = None) -> DataFrame:
    """Files of a workspace: packages' src folders, named files at packages' roots, extra folders (folder to package), files
    at the root, and the manifests' texts under __synthetic__/. Of a path that several have, the first counts.

    rel_path, file_id, content, package_name, package_layer, module_path, file_category, language, collection_targets."""
    rows = opened(spark, root, lambda path, size: classify.package_skipped(classify.base_name(path), size) | classify.in_folder(path, classify.TREE_SKIPPED_FOLDERS[:8]))
    rows = rows.withColumn("content", F.decode("content", "UTF-8")).withColumn("folder", F.regexp_extract("rel_path", r"^(packages/[^/]+)/", 1))
    manifests = rows.where(F.col("rel_path").rlike(r"^packages/[^/]+/package\.json$"))
    own = manifests.select("folder", F.get_json_object("content", "$.name").alias("package_name"), F.col("content").alias("manifest"))
    inside = rows.where("folder <> ''").join(own.drop("manifest"), "folder")
    rest = F.substr("rel_path", F.length("folder") + 2)
    prefix = F.concat("folder", F.lit("/src"))
    sources = [
        inside.where(F.startswith(rest, F.lit("src/"))).withColumn("module_path", classify.module_path(F.col("rel_path"), prefix)),
        inside.where(rest.isin(*package_files) | rest.rlike(r"^[^/]*config[^/]*$")).withColumn("module_path", F.lit("")),
    ]
    for folder, package in (extra or {}).items():
        at = folder.strip("/") + "/"
        sources.append(rows.where(F.startswith("rel_path", F.lit(at))).withColumn("package_name", F.lit(package)).withColumn("module_path", classify.module_path(F.col("rel_path"), F.lit(at))))
    sources.append(rows.where(~F.contains("rel_path", F.lit("/"))).withColumn("package_name", F.lit("monorepo-root")).withColumn("module_path", F.lit("")))
    text = own.select(F.concat(F.lit("__synthetic__/"), "package_name").alias("rel_path"), "package_name", manifest_text(F.col("manifest"), F.col("package_name")).alias("content"), F.lit("").alias("module_path"))
    sources.append(text.where("content IS NOT NULL"))
    columns = ("rel_path", "content", "package_name", "module_path")
    out = ranked_union([x.select(*columns) for x in sources], "rel_path")
    name = classify.base_name(F.col("rel_path"))
    synthetic = F.startswith("rel_path", F.lit("__synthetic__/"))
    category = F.when(synthetic, "package_manifest").otherwise(classify.package_category(F.col("rel_path"), name))
    return out.select(
        "rel_path", F.sha2("content", 256).alias("file_id"), "content", "package_name", classify.layer(F.col("package_name"), layers or {}, "infrastructure").alias("package_layer"), "module_path",
        category.alias("file_category"), F.when(synthetic, "markdown").otherwise(classify.package_language(name)).alias("language"),
        F.when(synthetic, F.array(F.lit("docs"))).otherwise(classify.targets(category)).alias("collection_targets"),
    )


def example_files(spark: SparkSession, root: str) -> DataFrame:
    """Source files laid out as group/example/file, with the names of the other files of the example. Spark's reader doesn't list empty files."""
    rows = opened(spark, root, lambda path, size: ~classify.suffix(classify.base_name(path)).isin(".ts", ".tsx", ".jsx", ".js") | (F.size(F.split(path, "/")) != 3))
    parts, content = F.split("rel_path", "/"), F.decode("content", "UTF-8")
    rows = rows.select(F.col("rel_path").alias("path"), parts[0].alias("example_group"), parts[1].alias("example_id"), parts[2].alias("file_name"), content.alias("content"), F.sha2(content, 256).alias("file_id"))
    names = rows.groupBy("example_group", "example_id").agg(F.array_sort(F.collect_list("file_name")).alias("_names"))
    return rows.join(names, ["example_group", "example_id"]).withColumn("related_files", F.array_remove("_names", F.col("file_name"))).drop("_names")


def paths_on_disk(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select(path).distinct()


def write_points(df: DataFrame, path: str, partition: str = "content_type") -> None:
    """A collection of points as Parquet, partitioned by what searches filter on."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
