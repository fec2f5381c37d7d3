"""Queries of the text operators: file chunks, parts to a budget, headings of plain text, the indentation format, answers as modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import batches, coercion, ids, indented, sections, syntax
from .tables import query, read


@query("""SELECT 'r_name: ' || r_name || chr(10) || 'nations[' || count(*) || ']{n_nationkey,n_name}:' || chr(10) || string_agg('  ' || n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS body
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def indented_records(spark, sf_dir):
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    r = read(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(indented.encoded(F.to_json(F.struct("r_name", "nations"))).alias("body"))


@query("SELECT event_id, event_type AS name, 'json_config' AS type, props AS text FROM events")
def config_chunks(spark, sf_dir):
    chunks = sections.file_chunks(F.col("props"), F.col("event_type"), F.lit("config"))
    return read(spark, sf_dir, "events").select("event_id", F.inline(chunks)).select("event_id", "name", "type", "text")


@query("""SELECT p_partkey, '{"name": "' || p_name || '", "module_name": "' || p_name || '"}' AS module FROM part""")
def plan_modules(spark, sf_dir):
    one = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name"))).alias("modules")))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(coercion.plan_modules(F.concat(F.lit("```json\n"), one, F.lit("\n```")))).alias("module"))


@query(None)
def module_parts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = batches.items(docs, "doc_id", "text", ["source"], lambda t, name: ((x,) for x in sections.module_parts(t, 800, name or "", most=None)), "text string", "part")
    return out.select("doc_id", "part", F.length("text").alias("n_chars"), ids.text_hash(F.col("text")).alias("digest"))


@query(None)
def file_pieces(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit(".md")).alias("name"))
    out = batches.items(docs, "doc_id", "text", ["name"], lambda t, name: ((x[1], x[0]) for x in syntax.file_parts(t, name or "")), "name string, text string")
    return out.select("doc_id", "pos", "name", ids.text_hash(F.col("text")).alias("digest"))


@query(None)
def text_headings(spark, sf_dir):
    return batches.items(read(spark, sf_dir, "documents"), "doc_id", "text", [], sections.text_headings, "level int, text string")
