"""Queries of lookups and searches by intent, stores and their plans, checks and mended answers, merges of a module's parts, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coercion, text, validate
from ..operators import aggregate, buckets, search, store, workflow
from ..streaming import jobs
from .tables import SCORED, probe, query, read

# Lookups.


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def point_lookup(spark, sf_dir):
    return search.by_key(read(spark, sf_dir, "part"), "p_partkey", 42, ["p_partkey", "p_name", "p_brand"])


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id = (SELECT min(event_id) FROM events)")
def json_lookup(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    found = search.by_key(events, "event_id", events.agg(F.min("event_id")).first()[0], ["event_id", "event_type", "props"], ["props"])
    return found.select("event_id", "event_type", F.try_variant_get("props", "$.k", "long").alias("k"))


@query("SELECT n_name, n_nationkey FROM nation")
def node_scan(spark, sf_dir):
    return search.all_by_name(read(spark, sf_dir, "nation"), ["n_name", "n_nationkey"], "n_name")


@query(f"WITH {SCORED} SELECT round(score, 6) AS score, vec_id AS text, label FROM s ORDER BY s.score DESC, vec_id LIMIT 5")
def search_hits(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    hits = search.as_hits(search.top_k(points, probe(points), "vec_id").withColumn("text", F.col("vec_id")).withColumn("score", F.round("score", 6)))
    return hits.select("score", "text", "metadata.label")


@query("SELECT o_orderkey, count(*) AS kept FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY o_orderkey")
def nested_members(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus")).alias("lines"))
    nested = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    out = search.members(nested, "lines", {"l_returnflag": "R", "l_linestatus": "F"})
    return out.where(F.size("lines") > 0).select("o_orderkey", F.size("lines").cast("long").alias("kept"))


# Search by intent: labels are lanes, and languages of the code lane.

LANE = "CASE label % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'config' ELSE 'doc' END"
CODE_FIT = "(label % 3 <> 0 OR vec_id % 3 < 2)"
INTENT_LANES = f"""{SCORED}, p AS (SELECT vec_id, {LANE} AS content_type, vec_id // 4 AS file_id, score FROM s WHERE label < 9 AND {CODE_FIT}),
r AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY score DESC, vec_id) AS r FROM p), w AS (SELECT vec_id, file_id, content_type, score * CASE content_type WHEN 'code' THEN 1.0 WHEN 'config' THEN 0.9 ELSE 1.2 END AS score FROM r WHERE r <= 5),
x AS (SELECT vec_id, vec_id // 10 AS example_id, score FROM s WHERE label = 9 ORDER BY s.score DESC, vec_id LIMIT 5)"""


def asked(spark, sf_dir, expand_files: bool):
    points = read(spark, sf_dir, "embeddings")
    language = F.when(F.col("vec_id") % 3 == 0, "typescript").when(F.col("vec_id") % 3 == 1, "tsx").otherwise("css")
    rows = points.withColumn("content_type", F.expr(LANE)).withColumn("language", language).withColumn("file_id", F.floor(F.col("vec_id") / 4)).withColumn("example_id", F.floor(F.col("vec_id") / 10))
    return search.intent_search(rows.where("label < 9"), rows.where("label = 9"), "how to use a schema", probe(points), "vec_id", expand_files=expand_files)


@query(f"""WITH {INTENT_LANES} SELECT vec_id AS key, content_type, round(score, 6) AS score, 'unified' AS source FROM w UNION ALL SELECT vec_id, '', round(score, 6), 'examples' FROM x""")
def combined_search(spark, sf_dir):
    hits, found, _ = asked(spark, sf_dir, False)
    one = lambda df, lane, name: df.select(F.col("vec_id").alias("key"), lane.alias("content_type"), F.round("score", 6).alias("score"), F.lit(name).alias("source"))
    return one(hits, F.col("content_type"), "unified").unionByName(one(found, F.lit(""), "examples"))


@query(f"""WITH {INTENT_LANES} SELECT file_id AS key, arg_max(content_type, score) AS content_type, round(max(score), 6) AS score, 'unified' AS source FROM w GROUP BY file_id
UNION ALL SELECT e.vec_id, '', round(b.best, 6), 'examples' FROM embeddings e JOIN (SELECT example_id, max(score) AS best FROM x GROUP BY example_id) b ON e.vec_id // 10 = b.example_id WHERE e.label = 9""")
def combined_search_files(spark, sf_dir):
    hits, found, _ = asked(spark, sf_dir, True)
    one = lambda df, key, lane, name: df.select(F.col(key).alias("key"), lane.alias("content_type"), F.round("score", 6).alias("score"), F.lit(name).alias("source"))
    return one(hits, "file_id", F.col("content_type"), "unified").unionByName(one(found, "vec_id", F.lit(""), "examples"))


@query(f"WITH {INTENT_LANES} SELECT 'how to use a schema' AS query, 1.2::DOUBLE AS doc_weight, (SELECT count(*) FROM w) AS total_unified, (SELECT count(*) FROM x) AS total_examples, (SELECT round(max(score), 6) FROM w) AS best")
def search_result(spark, sf_dir):
    hits, found, weights = asked(spark, sf_dir, False)
    r = search.as_result(hits, found, "how to use a schema", weights, ["vec_id"])
    return r.select("query", F.col("intent_weights")["doc"].alias("doc_weight"), F.col("total_unified").cast("long").alias("total_unified"), F.col("total_examples").cast("long").alias("total_examples"), F.round(F.col("unified_results")[0]["score"], 6).alias("best"))


@query("""WITH h AS (SELECT o_orderkey AS k, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
SELECT l_orderkey, l_returnflag, count(*) AS chunks, string_agg(l_linenumber::VARCHAR, chr(10) ORDER BY l_linenumber) AS text, round(max(score), 6) AS best_score, arg_min(l_linestatus, l_linenumber) AS mode FROM lineitem JOIN h ON l_orderkey = k GROUP BY l_orderkey, l_returnflag""")
def example_file_texts(spark, sf_dir):
    """Orders as example sets, flags as their files, lines as the files' chunks."""
    hits = read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("score"))
    lines = read(spark, sf_dir, "lineitem").withColumn("text", F.col("l_linenumber").cast("string"))
    out = search.whole_files(search.expand(hits, lines, "l_orderkey"), "l_orderkey", "l_returnflag", "l_linenumber", "text", ["l_linestatus"])
    return out.select("l_orderkey", "l_returnflag", "chunks", "text", F.round("best_score", 6).alias("best_score"), F.col("l_linestatus").alias("mode"))


@query("SELECT user_id, arg_min(value, event_id) AS best_score FROM events GROUP BY user_id")
def first_hit_scores(spark, sf_dir):
    return search.first_scores(read(spark, sf_dir, "events").withColumnRenamed("value", "score"), "user_id", ["event_id"])


# Stores.


@query("""WITH f AS (SELECT doc_id::VARCHAR AS file_path, source AS example_id, sha256(CASE WHEN source = 'src3' AND lang = 'de' THEN text || '!' ELSE text END) AS file_id FROM documents WHERE source <> 'src1'),
s AS (SELECT doc_id::VARCHAR AS file_path, source AS example_id, sha256(text) AS file_id FROM documents WHERE source <> 'src2')
SELECT coalesce(f.example_id, s.example_id) AS example_id, CASE WHEN count(f.file_path) = 0 THEN 'delete' WHEN bool_or(s.file_path IS NULL OR f.file_path IS NULL) THEN 'write' ELSE 'keep' END AS op
FROM f FULL JOIN s ON f.file_path = s.file_path AND f.file_id = s.file_id AND f.example_id = s.example_id GROUP BY 1""")
def folder_plan(spark, sf_dir):
    """One folder is new, one gone, one has changed files."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("source").alias("example_id"), "text", "lang")
    changed = (F.col("example_id") == "src3") & (F.col("lang") == "de")
    disk = docs.where("example_id <> 'src1'").withColumn("file_id", F.sha2(F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return store.folder_plan(disk, docs.where("example_id <> 'src2'").withColumn("file_id", F.sha2("text", 256)))


@query("""WITH s AS (SELECT source, arg_min(sha256(text), doc_id) AS h FROM documents GROUP BY source), f AS (SELECT source, arg_max(sha256(text), doc_id) AS h FROM documents GROUP BY source)
SELECT source AS file_path, CASE WHEN s.h = f.h THEN 'keep' ELSE 'update' END AS op FROM s JOIN f USING (source)""")
def store_plan(spark, sf_dir):
    """Sources as files whose newest document is their content; stored is the first."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.sha2("text", 256).alias("file_id"), F.col("doc_id").alias("chunk_index"))
    disk = docs.groupBy("file_path").agg(F.max_by("file_id", "chunk_index").alias("file_id"))
    return store.plan_of(disk, docs, keep_if_empty=True)


@query("SELECT sha256(text) AS file_id, count(*) AS n FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de') GROUP BY 1")
def digest_delete(spark, sf_dir):
    points = read(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("file_id"))
    return store.delete_by_digest(points, points.where("lang = 'de'").distinct()).groupBy("file_id").agg(F.count("*").alias("n"))


@query("SELECT item_id, 32::BIGINT AS dims, 1.0::DOUBLE AS norm FROM benchmark WHERE text IS NOT NULL")
def text_vectors(spark, sf_dir):
    v = read(spark, sf_dir, "benchmark").select("item_id", store.embedded(F.col("text"), 32, "search_document").alias("v")).where("v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.select("item_id", F.size("v").cast("long").alias("dims"), F.round(norm, 4).alias("norm"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) OR l_linenumber = 7")
def cascaded_children(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("parent"))
    parents = read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    return store.cascaded(lines, parents, "parent").select("l_orderkey", "l_linenumber")


STATES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


JOB_LOG = f"""log AS (SELECT user_id AS id, event_id, {STATES} AS status, ts FROM events),
e1 AS (SELECT * FROM log WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, event_id) = 1),
e2 AS (SELECT log.* FROM log JOIN e1 ON e1.id = log.id AND (log.ts, log.event_id) > (e1.ts, e1.event_id) WHERE log.status IN ('processing', 'failed') QUALIFY row_number() OVER (PARTITION BY log.id ORDER BY log.ts, log.event_id) = 1),
e3 AS (SELECT log.* FROM log JOIN e2 ON e2.id = log.id AND (log.ts, log.event_id) > (e2.ts, e2.event_id) WHERE e2.status = 'processing' AND log.status IN ('completed', 'failed') QUALIFY row_number() OVER (PARTITION BY log.id ORDER BY log.ts, log.event_id) = 1),
kept AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3)"""


@query(f"WITH {JOB_LOG} SELECT id, event_id, status FROM kept")
def job_log(spark, sf_dir):
    """Events of users as events of jobs: what a job's state allows."""
    return store.job_events(job_events(spark, sf_dir), at=("ts", "event_id")).select("id", "event_id", "status")


def job_events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.expr(STATES).alias("status"), "ts")


@query(f"WITH {JOB_LOG} SELECT id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(status, (ts, event_id)) AS status FROM kept GROUP BY id")
def job_stream(spark, sf_dir):
    """The same events as a stream in two parts, by time; the table of states that the stream keeps."""
    log = job_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    at, seconds = buckets.shared_folder(spark), F.unix_micros("ts")
    middle = log.agg(((F.min(seconds) + F.max(seconds)) / 2).alias("m")).first()["m"] or 0.0
    for part in (seconds <= middle, seconds > middle):
        log.where(part).write.mode("append").parquet(f"{at}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{at}/log")
    jobs.keep_states(jobs.states(stream, ("ts", "event_id")), f"{at}/states", f"{at}/checkpoint", ("ts", "event_id")).awaitTermination()
    return buckets.current(spark, f"{at}/states").select("id", "event_id", "status")


# Checks and answers.


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'frontend' ELSE lang END NOT IN ('frontend', 'backend', 'both') AS mode_fault, CASE WHEN doc_id % 4 < 2 THEN NULL ELSE 400 END AS name_fault,
CASE WHEN n_chars * 10000 > 20971520 THEN 413 END AS size_fault, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pdf' END AS kind FROM documents""")
def upload_checks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.DOCX", "b.pdf", "c.txt", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 4 == 2, "application/pdf").otherwise("text/plain")
    mode = F.when(F.col("lang").isin("en", "de"), "frontend").otherwise(F.col("lang"))
    return d.select(
        "doc_id", validate.mode_fault(mode).isNotNull().alias("mode_fault"), validate.upload_fault(name)["status"].alias("name_fault"), validate.size_fault(F.col("n_chars") * 10000)["status"].alias("size_fault"),
        validate.upload_kind(name, kind).alias("kind"),
    )


SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False}


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN '''props'' at ''k'': ' || json_extract_string(props, '$.k') || ' is out of bounds' END AS fault FROM events")
def schema_faults(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", validate.schema_fault(F.col("props"), SCHEMA, "props").alias("fault"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'grid' WHEN 1 THEN 'form' ELSE 'kpi' END AS type, p_name AS id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS enums FROM part""")
def mended_answers(spark, sf_dir):
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'GRID' WHEN 1 THEN 'FORM' ELSE 'kpi' END")
    own = F.to_json(F.struct(F.col("p_name").alias("id")))
    wrapped = F.when(kind == "kpi", F.to_json(F.struct(F.col("p_name").alias("id"), F.lit("kpi").alias("type")))).otherwise(F.concat(F.lit('{"'), kind, F.lit('": '), own, F.lit("}")))
    values = F.when(F.col("p_partkey") % 2 == 0, F.lit('["a"]')).otherwise(F.lit("[]"))
    answer = F.concat(F.lit('{"module": {"screens": [{"components": ['), wrapped, F.lit(']}], "enums": [{"values": '), values, F.lit("}]}}"))
    got = read(spark, sf_dir, "part").select("p_partkey", validate.mended_json(answer).alias("m"))
    at = lambda p: F.get_json_object("m", f"$.module.{p}")
    return got.select("p_partkey", at("screens[0].components[0].type").alias("type"), at("screens[0].components[0].id").alias("id"), F.json_array_length(at("enums")).cast("long").alias("enums"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN 'true' WHEN 3 THEN '3' END AS default_value, CASE WHEN p_partkey % 2 = 0 THEN '["1","b"]' ELSE '[]' END AS options FROM part""")
def coerced_fields(spark, sf_dir):
    value = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'false' WHEN 1 THEN concat('\"', p_name, '\"') WHEN 2 THEN 'true' WHEN 3 THEN '3' ELSE '\"\"' END")
    options = F.expr("CASE WHEN p_partkey % 2 = 0 THEN '[1, \"b\"]' ELSE '\"none\"' END")
    item = F.concat(F.lit('{"fields": [{"default_value": '), value, F.lit(', "options": '), options, F.lit("}]}"))
    got = read(spark, sf_dir, "part").select("p_partkey", coercion.coerced(item).alias("c"))
    return got.select("p_partkey", F.get_json_object("c", "$.fields[0].default_value").alias("default_value"), F.replace(F.get_json_object("c", "$.fields[0].options"), F.lit(", "), F.lit(",")).alias("options"))


# Merges and plans.

SIDE = "l_returnflag || (l_linenumber % 3)"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, {SIDE} AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'get' ELSE 'GET' END AS m, l_returnflag AS p FROM lineitem)
SELECT l_orderkey, count(DISTINCT s) AS screens, count(DISTINCT p) AS endpoints, count(DISTINCT s) AS rules, 'd' || min(l_linenumber) AS description FROM l GROUP BY l_orderkey""")
def merged_modules(spark, sf_dir):
    """Orders as modules, lines as the extractions of their parts."""
    lines = read(spark, sf_dir, "lineitem").withColumn("s", F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")))
    lines = lines.withColumn("m", F.when(F.col("l_linenumber") % 2 == 0, "get").otherwise("GET"))
    front = F.struct(F.array(F.struct(F.col("s").alias("name"))).alias("screens"), F.array("s").alias("business_rules"))
    back = F.struct(F.array(F.struct(F.col("m").alias("method"), F.col("l_returnflag").alias("path"))).alias("api_endpoints"))
    one = F.to_json(F.struct(F.struct(F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("description"), front.alias("frontend"), back.alias("backend")).alias("module")))
    parts = lines.select("l_orderkey", F.lit("x").alias("name"), F.col("l_linenumber").alias("part"), one.alias("extraction"))
    got = workflow.merged_parts(parts, "both", ("l_orderkey", "name"))
    at = lambda p: F.json_array_length(F.get_json_object("extraction", f"$.module.{p}")).cast("long")
    return got.select("l_orderkey", at("frontend.screens").alias("screens"), at("backend.api_endpoints").alias("endpoints"), at("frontend.business_rules").alias("rules"), F.get_json_object("extraction", "$.module.description").alias("description"))


@query("""WITH m AS (SELECT conv_id, role, min(turn) AS position FROM conversations GROUP BY ALL)
SELECT conv_id, role AS name, CASE WHEN role = 'system' THEN 1 WHEN role = 'user' AND conv_id % 2 = 0 THEN 7 ELSE position + 1 END::BIGINT AS priority FROM m""")
def module_priorities(spark, sf_dir):
    modules = read(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("name"), F.col("turn").alias("position"))
    user = (F.col("name") == "user") & (F.col("conv_id") % 2 == 0)
    nodes = modules.where((F.col("name") == "system") | user).select("conv_id", "name", F.lit(0).alias("priority"), F.when(user, 7).alias("order"), F.lit(1).alias("n"))
    return workflow.priorities(modules, nodes, "conv_id").select("conv_id", "name", F.col("priority").cast("long").alias("priority"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS priority FROM orders), n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE priority WHEN 0 THEN 999 ELSE priority END, o_orderkey) AS number, count(*) OVER (PARTITION BY o_custkey) AS total_modules,
CAST(sum(coalesce(n, 0)) OVER (PARTITION BY o_custkey) AS BIGINT) AS total_screens FROM p LEFT JOIN n ON o_orderkey = l_orderkey""")
def ordered_plans(spark, sf_dir):
    screens = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("screens"))
    priority = F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.substring("o_orderpriority", 1, 1).cast("int"))
    plans = read(spark, sf_dir, "orders").join(screens, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", F.col("o_orderkey").alias("module_name"), priority.alias("priority"), "screens", F.array().alias("file_structure"))
    out = workflow.ordered_plans(plans, "o_custkey")
    return out.select("o_custkey", F.col("module_name").alias("o_orderkey"), F.col("number").cast("long").alias("number"), "total_modules", F.col("total_screens").cast("long").alias("total_screens"))


@query("""SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 's' || l_linenumber || '|c' || l_linenumber ELSE 'c' || l_linenumber END, '|' ORDER BY l_linenumber)) AS queries
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""")
def similarity_queries(spark, sf_dir):
    # only numbers are shuffled and sorted; screens are made of them after the join
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("numbers"))
    plans = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    c = lambda n: F.concat(F.lit("c"), n.cast("string"))
    screen = lambda n: F.struct(n.alias("l_linenumber"), F.when(n % 2 == 0, F.concat(F.lit("s"), n.cast("string"))).otherwise("").alias("similarity_query"), F.array(F.struct(c(n).alias("similarity_query"))).alias("components"))
    screens = F.transform(F.array_sort("numbers"), screen).alias("screens")
    plans = plans.select(F.col("o_orderkey").alias("module_name"), F.lit(1).alias("document"), F.lit(1).alias("n"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("similarity_query"), screens)
    return workflow.similarity_queries(plans).select(F.col("module_name").alias("o_orderkey"), F.array_join("queries", "|").alias("queries"))


@query("""WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS title FROM conversations),
f AS (SELECT conv_id, title, arg_min(role, turn) AS role FROM t WHERE title <> '' AND length(title) <= 150 AND unicode(title) < 9728 AND NOT regexp_matches(title, '(?i)^(module\\s*(name|no\\.?|number|title)|section\\s+title)\\s*[:—\\-]') GROUP BY ALL),
n AS (SELECT c.conv_id, count(f.title) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON c.conv_id = f.conv_id AND f.role = 'user' GROUP BY c.conv_id)
SELECT conv_id, greatest(1, n) AS modules, n = 0 AS whole FROM n""")
def module_segments(spark, sf_dir):
    """Messages as headings; the classifier takes the users' ones, and a conversation without any is one module."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    h = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("pos"), level.alias("level"), "text")
    clean = aggregate.clean_headings(h, "document", "pos", "level", "text")
    classified = clean.where("level = 2").select("document", F.col("text").alias("heading"), F.lit("MODULE").alias("type"), F.lit("").alias("module_name"), F.lit("").alias("description"), F.col("pos").alias("n"))
    got = workflow.segments(h, classified).groupBy(F.col("document").alias("conv_id"))
    return got.agg(F.count("*").alias("modules"), F.max(F.col("heading") == "").alias("whole"))


@query("SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def adhoc_query(spark, sf_dir):
    from ..operators import loads

    tables = {"_s": read(spark, sf_dir, "supplier"), "_n": read(spark, sf_dir, "nation")}
    return loads.expressions(tables, "SELECT s.s_suppkey, n.n_name FROM _s s JOIN _n n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = :region", region=1)


@query("SELECT event_type, round(sum(user_id) * CASE event_type WHEN 'view' THEN 0.02 WHEN 'click' THEN 0.13 ELSE 0 END / 1e6, 8) AS cost FROM events GROUP BY event_type")
def model_costs(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("user_id").alias("tokens"))
    return n.select("event_type", F.round(text.model_cost(F.col("tokens"), F.col("event_type"), {"view": 0.02, "click": 0.13}), 8).alias("cost"))


@query("SELECT DISTINCT upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS method, user_id FROM events")
def endpoints_once(spark, sf_dir):
    """The first row of each method, in any case, and path."""
    e = read(spark, sf_dir, "events").withColumn("method", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))).withColumn("_m", F.upper("method"))
    return aggregate.first_wins(e, ["_m", "user_id"], ["event_id"]).select(F.initcap("method").alias("method"), "user_id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def dependency_graph(spark, sf_dir):
    """Modules of one region; a model's graph names others too, and they go."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation").where("n_regionkey = 0")
    own = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").cast("string").alias("name"))
    told = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"))
    edges = told.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("uses").alias("kind"))
    return workflow.dependency_graph(own, told, edges)[0].select(F.col("id").cast("long").alias("id"))


