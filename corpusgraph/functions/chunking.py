"""Chunking: pieces by separator, Markdown sections, headers of what is embedded. Chunks of source files: see syntax and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in characters.
MIN_CHARS, MAX_CHARS = 80, 6000
PIECES = "array<struct<text:string,name:string,type:string>>"


def pieces(df: DataFrame, column: str, separator: str) -> DataFrame:
    """A row for each piece, with its place."""
    return df.select("*", F.posexplode(F.split(column, separator)).alias("pos", "piece")).drop(column)


def paragraphs(text: Column) -> Column:
    """Non-empty trimmed parts between blank lines; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


# Front matter, and the headings that begin a section.
FRONT_MATTER = r"(?s)\A---\s*\n.*?\n---\s*\n"
HEADING = r"^(#{1,3})\s+.+$"


def markdown_sections(df: DataFrame, key: str, column: str, name: str | None = None) -> DataFrame:
    """Sections at headings of levels 1 to 3: key, pos, level, title, parent, path ("A > B"), text. Front matter and what
    precedes the first heading go. A text without headings is one section, titled by the column `name`, level 0."""
    rows = df.select(key, F.regexp_replace(column, FRONT_MATTER, "").alias("_body"), (F.lit("") if name is None else F.col(name)).alias("_name"))
    lines = rows.select(key, "_name", F.posexplode(F.split("_body", "\n")).alias("at", "line"))
    by = Window.partitionBy(key).orderBy("at")
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", HEADING, 1)))
    lines = lines.withColumn("pos", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(by)).withColumn("_any", F.max("level").over(Window.partitionBy(key)))
    lines = lines.where("pos > 0 OR _any = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    sections = lines.groupBy(key, "pos").agg(F.max("level").alias("level"), F.min_by("line", "at").alias("title"), F.max("_name").alias("_name"), text.alias("text"))
    sections = sections.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    sections = sections.withColumn("title", F.when(F.col("level") > 0, F.regexp_replace(F.regexp_replace("title", r"^#+", ""), r"(?U)^\s+|\s+$", "")).otherwise(F.col("_name")))
    order = Window.partitionBy(key).orderBy("pos")
    for n in (1, 2, 3):  # the last heading of a level, unless a higher one came later
        sections = sections.withColumn(f"_p{n}", F.max(F.when(F.col("level") == n, F.col("pos"))).over(order)).withColumn(f"_t{n}", F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(order))
    sections = sections.withColumn("_t2", F.when(F.col("_p2") > F.coalesce("_p1", F.lit(0)), F.col("_t2"))).withColumn("_t3", F.when(F.col("_p3") > F.greatest(F.coalesce("_p1", F.lit(0)), F.coalesce("_p2", F.lit(0))), F.col("_t3")))
    above = F.when(F.col("level") >= 3, F.coalesce("_t2", "_t1")).when(F.col("level") == 2, F.col("_t1"))
    path = F.when(F.col("level") > 0, F.concat_ws(" > ", "_t1", F.when(F.col("level") >= 2, F.col("_t2")), F.when(F.col("level") >= 3, F.col("_t3")))).otherwise(F.lit(""))
    return sections.select(key, F.greatest(F.col("pos"), F.lit(1)).cast("int").alias("pos"), "level", "title", F.coalesce(above, F.lit("")).alias("parent"), path.alias("path"), "text")


def embed_text(text: Column, kind: Column, symbol: Column, namespace: Column, category: Column, name: Column, imports: Column, exports: Column, use: Column | None = None, avoid: Column | None = None, label: str = "Imports: ") -> Column:
    """What is embedded of a chunk: lines on what and where it is, when to use it, the first 8 imports and exports, a rule, and the text.

    use, avoid: arrays of guidance for a known symbol. label: what stands before the imports."""
    first8 = lambda x: F.array_join(F.slice(x, 1, 8), ", ")
    some = lambda head, x, body: F.when(F.size(x) > 0, F.concat(F.lit(head), body))
    what = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(kind, F.lit(": "), symbol)).otherwise(kind)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), what, F.lit("] ["), namespace, F.lit(" / "), category, F.lit("]")),
        F.concat(F.lit("Package: "), namespace, F.lit(" | File: "), name),
        some("Use when: ", use, F.array_join(use, " | ")) if use is not None else F.lit(None).cast("string"),
        some("Do not use when: ", avoid, F.array_join(avoid, " | ")) if avoid is not None else F.lit(None).cast("string"),
        some(label, imports, first8(imports)),
        some("Exports: ", exports, first8(exports)),
        F.lit("---"),
        text,
    )
