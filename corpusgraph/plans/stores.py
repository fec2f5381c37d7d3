"""Queries of the bucketed store, of the search of many queries, of the matcher and of bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matcher
from ..operators import bitmaps, buckets, neighbours, signatures
from .tables import query, read

# A collection of all documents as points of files, and changes of it.

POINTS = "point_id string, file_path string, digest string"
PATHS = "SELECT CAST(doc_id AS VARCHAR) AS point_id, source || '/' || (doc_id % 50) AS file_path, md5(coalesce(text, '')) AS digest, lang, source, doc_id FROM documents"
BUCKET = "CAST('0x' || substr(md5(file_path), 1, 7) AS INTEGER) % 64"


def changed_store(spark, sf_dir) -> str:
    """All documents; then a batch that has German ones twice, without the files of one source; then one point of one file."""
    docs = read(spark, sf_dir, "documents")
    points = docs.select(F.col("doc_id").cast("string").alias("point_id"), F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("file_path"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "lang", "source")
    at = buckets.shared_folder(spark)
    buckets.create(spark, at, POINTS, "point_id", "file_path", 64)
    buckets.change(spark, at, points)
    german = points.where("lang = 'de'")
    twice = german.withColumn("at", F.lit(1)).unionByName(german.withColumn("at", F.lit(2))).withColumn("digest", F.concat("digest", F.lit("/"), F.col("at").cast("string")))
    buckets.change(spark, at, twice, files=points.where("source = 'src1'").select("file_path").distinct(), order=["at"])
    first = points.where("lang <> 'de' AND source <> 'src1'").agg(F.min(F.struct("file_path", "point_id")).alias("x")).select("x.*")
    buckets.change(spark, at, first.withColumn("digest", F.lit("new")))
    return at


FIRST = "SELECT file_path, point_id FROM p WHERE lang <> 'de' AND source <> 'src1' ORDER BY file_path, point_id LIMIT 1"
AFTER = f"""p AS ({PATHS}), first AS ({FIRST}), after AS (
  SELECT point_id, file_path, CASE WHEN lang = 'de' THEN digest || '/2' WHEN point_id = (SELECT point_id FROM first) THEN 'new' ELSE digest END AS digest
  FROM p WHERE lang = 'de' OR source <> 'src1')"""


@query(f"WITH {AFTER} SELECT * FROM after")
def bucket_store(spark, sf_dir):
    return buckets.current(spark, changed_store(spark, sf_dir))


@query(f"""WITH {AFTER},
two AS (SELECT DISTINCT {BUCKET} AS bucket FROM p WHERE lang = 'de' OR source = 'src1'),
one AS (SELECT {BUCKET} AS bucket FROM first),
n2 AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM p GROUP BY 1), n4 AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM after GROUP BY 1)
SELECT 2 AS version, bucket, n, 2 AS written FROM n2
UNION ALL SELECT 3, bucket, n, CASE WHEN bucket IN (SELECT bucket FROM two) THEN 3 ELSE 2 END FROM n4
UNION ALL SELECT 4, bucket, n, CASE WHEN bucket IN (SELECT bucket FROM one) THEN 4 WHEN bucket IN (SELECT bucket FROM two) THEN 3 ELSE 2 END FROM n4""")
def bucket_versions(spark, sf_dir):
    """Which version wrote each bucket: the last change wrote one."""
    return buckets.manifests(spark, changed_store(spark, sf_dir))


# Each vector asks two lanes, with conditions of its own; the lanes have weights.

@query("""WITH q AS (SELECT vec_id AS query_id, embedding, label AS a, (label + 3) % 10 AS b, vec_id % 4 AS c FROM embeddings),
s AS (SELECT q.query_id, e.label AS lane, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score, q.a
  FROM q JOIN embeddings e ON e.label IN (q.a, q.b) AND (q.c <> 1 OR e.vec_id % 2 = 0) AND (q.c <> 2 OR e.vec_id % 3 IN (0, 2))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, vec_id) AS i FROM s),
w AS (SELECT query_id, lane, vec_id, score * CASE WHEN lane = a THEN 1.0 ELSE 0.7 END AS score FROM r WHERE i <= 5)
SELECT query_id, lane, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM w""")
def every_vector_searches(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("lane"), (F.col("vec_id") % 2).cast("string").alias("half"), (F.col("vec_id") % 3).cast("string").alias("third"))
    other, turn = (F.col("lane") + 3) % 10, F.col("vec_id") % 4
    queries = points.select(
        F.col("vec_id").alias("query_id"), "embedding", F.array(F.col("lane"), other.cast("int")).alias("lanes"),
        F.when(turn == 1, F.array(F.lit("0"))).alias("want_half"), F.when(turn == 2, F.array(F.lit("0"), F.lit("2"))).alias("want_third"))
    best, _ = neighbours.top_of_lanes(points, queries, "vec_id", 5, fields=["half", "third"])
    lanes = queries.select("query_id", F.posexplode("lanes").alias("i", "lane"))
    weights = lanes.select("query_id", "lane", F.when(F.col("i") == 0, 1.0).otherwise(0.7).alias("weight"))
    return neighbours.weighted(best, weights, 5, "query_id", "lane", "vec_id").select("query_id", "lane", "vec_id", F.round("score", 6).alias("score"), "rank")


# Texts of the benchmark, and the beginnings of them, in all documents.

STRINGS = "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -item_id - 1, regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+)', 1) FROM benchmark"


@query(f"WITH s AS ({STRINGS}) SELECT doc_id, id FROM documents d JOIN s ON contains(d.text, s.text)")
def benchmark_strings(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark")
    starts = items.select((-F.col("item_id") - 1).alias("id"), F.regexp_extract("text", "^([^ ]+ [^ ]+ [^ ]+)", 1).alias("text"))
    strings = items.select(F.col("item_id").alias("id"), "text").unionByName(starts)
    return matcher.match_table(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", strings, "id", "text")


# Wish lists of all customers: orders with a line of one of two flags, a line of a number, and a line of a status.

WISHES = """SELECT c_custkey AS list, 0 AS k, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE 'none' END AS feature FROM customer
UNION ALL SELECT c_custkey, 0, CASE WHEN c_nationkey % 2 = 0 THEN 'N' ELSE 'A' END FROM customer
UNION ALL SELECT c_custkey, 1, 'line ' || (c_custkey % 9) FROM customer
UNION ALL SELECT c_custkey, 2, CASE WHEN c_acctbal < 0 THEN 'O' ELSE 'F' END FROM customer"""
FEATURES = """SELECT l_orderkey AS src, l_returnflag AS dst FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem UNION ALL SELECT l_orderkey, 'line ' || l_linenumber FROM lineitem"""
LISTS = f"""w AS (SELECT DISTINCT * FROM ({WISHES})), e AS (SELECT DISTINCT * FROM ({FEATURES})),
kinds AS (SELECT list, string_agg(k || ':' || feature, ',' ORDER BY k, feature) AS kind FROM w GROUP BY list),
one AS (SELECT kind, min(list) AS list FROM kinds GROUP BY kind),
x AS (SELECT w.list, e.src FROM one JOIN w ON w.list = one.list JOIN e ON e.dst = w.feature GROUP BY w.list, e.src HAVING count(DISTINCT w.k) = 3)"""


def wish_lists(spark, sf_dir, kept=None):
    wishes = spark.sql(WISHES.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer")).withColumnRenamed("k", "any")
    edges = spark.sql(FEATURES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))
    return bitmaps.index(edges), wishes if kept is None else wishes.join(kept, "list", "left_semi")


@query(f"WITH {LISTS}, n AS (SELECT kind, count(src) AS n FROM one JOIN x USING (list) GROUP BY kind) SELECT list, n FROM kinds JOIN n USING (kind)")
def wish_list_sizes(spark, sf_dir):
    """How many orders each customer's wishes leave; equal lists are answered once."""
    return bitmaps.list_sizes(*wish_lists(spark, sf_dir))


@query(f"""WITH w AS (SELECT DISTINCT * FROM ({WISHES}) WHERE list IN (SELECT min(c_custkey) FROM customer GROUP BY c_nationkey)), e AS (SELECT DISTINCT * FROM ({FEATURES}))
SELECT w.list, e.src FROM w JOIN e ON e.dst = w.feature GROUP BY w.list, e.src HAVING count(DISTINCT w.k) = 3""")
def wish_list_members(spark, sf_dir):
    """The orders of the first customer of each nation."""
    first = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("list"))
    return bitmaps.list_members(*wish_lists(spark, sf_dir, first))


# Trees of files: documents by source and number; German ones of some sources have changed, one source is new, one is gone.

TREE_PATH = "source || '/' || (doc_id % 10) || '/' || (doc_id % 7) || '/' || doc_id"
GERMAN = "lang = 'de' AND source IN ('src2', 'src3') AND doc_id % 10 < 2"
TREES = f"""d AS (SELECT {TREE_PATH} AS p, CASE WHEN {GERMAN} THEN md5(text) || '!' ELSE md5(text) END AS h FROM documents WHERE source <> 'src4'),
s AS (SELECT {TREE_PATH} AS p, md5(text) AS h FROM documents WHERE source <> 'src5'),
c AS (SELECT coalesce(d.p, s.p) AS p, CASE WHEN s.p IS NULL THEN 'add' WHEN d.p IS NULL THEN 'delete' ELSE 'update' END AS op FROM d FULL JOIN s ON d.p = s.p WHERE d.h IS DISTINCT FROM s.h)"""


def two_trees(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("file_path", F.expr(TREE_PATH)).withColumn("file_id", F.md5(F.col("text").cast("binary")))
    disk = docs.where("source <> 'src4'").withColumn("file_id", F.when(F.expr(GERMAN), F.concat("file_id", F.lit("!"))).otherwise(F.col("file_id")))
    kept = docs.where("source <> 'src5'")
    a, b = (signatures.stored(spark, signatures.signatures(x)) for x in (disk, kept))
    return disk, kept, signatures.differing(spark, a, b)[0]


@query(f"""WITH {TREES}, f AS (SELECT DISTINCT unnest(['', string_split(p, '/')[1], array_to_string(string_split(p, '/')[1:2], '/'), array_to_string(string_split(p, '/')[1:3], '/')]) AS folder FROM c)
SELECT folder, folder IN (SELECT array_to_string(string_split(p, '/')[1:3], '/') FROM c) AS own FROM f""")
def differing_folders(spark, sf_dir):
    return two_trees(spark, sf_dir)[2]


@query(f"WITH {TREES} SELECT p AS file_path, op FROM c")
def changed_tree_files(spark, sf_dir):
    return signatures.changed_files(*two_trees(spark, sf_dir))
