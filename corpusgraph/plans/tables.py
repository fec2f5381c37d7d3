"""Queries of the reference operators over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, ids, text
from ..operators import aggregate, graph, search, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def probe(points: DataFrame, vec_id: int = 7) -> list[float]:
    """The vector that is searched for: one row."""
    return points.where(F.col("vec_id") == vec_id).first()["embedding"]


SCORED = """s AS (SELECT e.*, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"""
WEIGHTS = {0: 1.0, 1: 0.9, 2: 0.7, 3: 1.2}
LANES = f"""{SCORED},
l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s WHERE label IN (0, 1, 2, 3)),
w AS (SELECT vec_id, label, score * CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 1.2 END AS score FROM l WHERE r <= 5)"""


@query(f"WITH {LANES} SELECT vec_id, label, round(score, 6) AS score FROM w ORDER BY w.score DESC, vec_id LIMIT 20")
def multi_lane_topk(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    return search.lane_top_k(points, probe(points), "label", WEIGHTS, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT vec_id, label, round(score, 6) AS score FROM s WHERE label IN (2, 4, 6) ORDER BY s.score DESC, vec_id LIMIT 5")
def filtered_topk(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    return search.top_k(points, probe(points), "vec_id", 5, {"label": [2, 4, 6], "nothing": None}).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT vec_id, label, round(score, 6) AS score FROM s WHERE label = 3 ORDER BY s.score DESC, vec_id LIMIT 10")
def examples_topk(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    return search.top_k(points, probe(points), "vec_id", 10, {"label": 3}).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {LANES} SELECT vec_id, label, round(score, 6) AS score FROM w ORDER BY w.score DESC, vec_id LIMIT 5")
def collections_topk(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    return search.lane_top_k(points, probe(points), "label", WEIGHTS, "vec_id", overall=5).select("vec_id", "label", F.round("score", 6).alias("score"))


MADE = """CASE (conv_id + turn) % 16 WHEN 0 THEN 'How  TO filter' WHEN 1 THEN 'docs' WHEN 2 THEN 'usage of it' WHEN 3 THEN 'STORYBOOK' WHEN 4 THEN 'setup it' WHEN 5 THEN 'the interface' WHEN 6 THEN 'Type Alias'
WHEN 7 THEN 'props' WHEN 8 THEN 'an enum' WHEN 9 THEN 'useForm now' WHEN 10 THEN 'DataGrid' WHEN 11 THEN 'import it' WHEN 12 THEN 'Import it' WHEN 13 THEN 'a schema example' WHEN 14 THEN 'hooked' ELSE text END"""
#: The rules of intent as they are, for texts of any kind.
INTENT = f"""CASE WHEN regexp_matches({MADE}, '(?i)\\b(how\\s+to|what\\s+is|explain|guide|tutorial|usage|example|storybook|readme|docs?)\\b') THEN 'doc'
WHEN regexp_matches({MADE}, '(?i)\\b(interface|type\\s+alias|schema|props?\\b|config\\s+type|extends|enum)\\b') THEN 'config'
WHEN regexp_matches({MADE}, '\\b(use[A-Z]\\w+|[A-Z][a-z]+(?:[A-Z][a-z]+)+|import|component|hook)\\b') THEN 'code' END"""


@query(f"""WITH c AS (SELECT conv_id, turn, role, {INTENT} AS lane FROM conversations)
SELECT conv_id, turn, role, CASE WHEN lane = 'code' THEN 1.1 ELSE 1.0 END::DOUBLE AS code,
CASE WHEN lane = 'config' THEN 1.2 ELSE 0.9 END::DOUBLE AS config, CASE WHEN lane = 'doc' THEN 1.2 ELSE 0.7 END::DOUBLE AS doc FROM c""")
def intent_weights(spark, sf_dir):
    w = search.intent_weights(F.expr(MADE))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", *[w[k].alias(k) for k in ("code", "config", "doc")])


@query(f"""WITH {SCORED}, h AS (SELECT vec_id % 50 AS conv_id, score FROM s ORDER BY s.score DESC, vec_id LIMIT 5),
b AS (SELECT conv_id, max(score) AS best FROM h GROUP BY conv_id)
SELECT c.conv_id, turn, role, length(text) AS n_chars, round(best, 6) AS best_score FROM conversations c JOIN b ON c.conv_id = b.conv_id""")
def file_context_expand(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    hits = search.top_k(points, probe(points), "vec_id").select((F.col("vec_id") % 50).alias("conv_id"), "score")
    out = search.expand(hits, read(spark, sf_dir, "conversations"), "conv_id")
    return out.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"), F.round("best_score", 6).alias("best_score"))


@query("""WITH h AS (SELECT o_orderkey AS l_orderkey, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
SELECT l.l_orderkey, l_linenumber, l_returnflag, round(score, 6) AS best_score,
CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 99 END AS role_rank FROM lineitem l JOIN h ON l.l_orderkey = h.l_orderkey""")
def example_set_expand(spark, sf_dir):
    hits = read(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("score"))
    out = search.ranked_files(search.expand(hits, read(spark, sf_dir, "lineitem"), "l_orderkey"), "l_returnflag", {"A": 0, "N": 1})
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", F.round("best_score", 6).alias("best_score"), "role_rank")


def disk(docs: DataFrame) -> DataFrame:
    """Documents as files; those of one language have changed since they were stored."""
    return docs.select("doc_id", "source", F.when(F.col("lang") == "de", ids.text_hash(F.concat("text", F.lit("!")))).otherwise(ids.text_hash(F.col("text"))).alias("digest"))


def stored(docs: DataFrame) -> DataFrame:
    """What is stored of them: a path for each document, moved for French ones, so that those are deleted and added."""
    moved = F.when(F.col("lang") == "fr", -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return docs.select(moved.alias("doc_id"), "source", ids.text_hash(F.col("text")).alias("digest"))


SIDES = """d AS (SELECT doc_id, source, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS digest FROM documents),
s AS (SELECT CASE WHEN lang = 'fr' THEN -doc_id - 1 ELSE doc_id END AS doc_id, source, sha256(text) AS digest FROM documents)"""


@query(f"""WITH {SIDES} SELECT coalesce(d.doc_id, s.doc_id) AS doc_id,
CASE WHEN s.doc_id IS NULL THEN 'add' WHEN d.doc_id IS NULL THEN 'delete' WHEN s.digest <> d.digest THEN 'update' ELSE 'keep' END AS op
FROM d FULL OUTER JOIN s ON d.doc_id = s.doc_id""")
def sync_diff(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return sync.diff(disk(docs), stored(docs), "doc_id", "digest")


@query(f"WITH {SIDES} SELECT doc_id, source, digest FROM d UNION ALL SELECT doc_id, source, digest FROM s WHERE doc_id NOT IN (SELECT doc_id FROM d)")
def sync_apply(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return sync.upsert(stored(docs), disk(docs), "doc_id").select("doc_id", "source", "digest")


@query(f"WITH {SIDES} SELECT doc_id, digest FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def sync_delete(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return sync.delete(stored(docs), docs.where("lang = 'de'"), "doc_id").select("doc_id", "digest")


@query(f"WITH {SIDES} SELECT source, arg_min(digest, doc_id) AS digest FROM s WHERE source <> '' AND digest <> '' GROUP BY source")
def stored_hashes(spark, sf_dir):
    return sync.stored_hashes(stored(read(spark, sf_dir, "documents")), "source", "digest", "doc_id")


@query("SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS paths FROM documents GROUP BY sha256(text) HAVING count(DISTINCT doc_id) > 1")
def twin_hazard(spark, sf_dir):
    return sync.twins(read(spark, sf_dir, "documents").select("doc_id", ids.text_hash(F.col("text")).alias("digest")), "digest", "doc_id")


@query(f"""WITH {SIDES}, p AS (SELECT coalesce(d.source, s.source) AS source, d.doc_id IS NOT NULL AS on_disk, d.doc_id IS NULL OR s.doc_id IS NULL AS differs
FROM d FULL OUTER JOIN s ON d.doc_id = s.doc_id AND d.digest = s.digest AND d.source = s.source)
SELECT source, bool_or(differs) AS dirty FROM p GROUP BY source HAVING bool_or(on_disk)""")
def folder_dirty(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return sync.dirty_folders(disk(docs), stored(docs), "source", "doc_id", "digest")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    return sync.orphans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


def edges(spark, sf_dir, src: str, dst: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col(src).alias("src"), F.col(dst).alias("dst"), *more)


@query("""SELECT p_partkey, p_name, s_suppkey, s_name FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_brand = 'Brand#11'""")
def one_hop(spark, sf_dir):
    parts = read(spark, sf_dir, "part").where("p_brand = 'Brand#11'")
    return graph.one_hop(parts, edges(spark, sf_dir, "l_partkey", "l_suppkey"), read(spark, sf_dir, "supplier"), "p_partkey", "s_suppkey").select("p_partkey", "p_name", "s_suppkey", "s_name")


@query("SELECT o_orderkey, o_orderpriority, p_partkey, p_type, l_returnflag AS role FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT'")
def one_hop_edge_prop(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    out = graph.one_hop(orders, edges(spark, sf_dir, "l_orderkey", "l_partkey", "l_returnflag"), read(spark, sf_dir, "part"), "o_orderkey", "p_partkey")
    return out.select("o_orderkey", "o_orderpriority", "p_partkey", "p_type", F.col("l_returnflag").alias("role"))


@query("SELECT l_orderkey AS src FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3")
def relational_division(spark, sf_dir):
    return graph.division(edges(spark, sf_dir, "l_orderkey", "l_returnflag"), ["A", "N", "R"])


@query("SELECT l_orderkey AS src FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(*) = 2")
def relational_division_counted(spark, sf_dir):
    return graph.division(edges(spark, sf_dir, "l_orderkey", "l_returnflag"), ["A", "R"], distinct=False)


RANKS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
RANK_SQL = "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE 0 END"


@query(f"""SELECT o_orderkey, o_orderpriority, {RANK_SQL} AS rank FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2)
AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) = 2)
ORDER BY rank DESC, o_orderkey LIMIT 25""")
def generation_candidates(spark, sf_dir):
    wishes = [(edges(spark, sf_dir, "l_orderkey", "l_returnflag"), ["A", "R"]), (edges(spark, sf_dir, "l_orderkey", "l_linestatus"), ["O", "F"])]
    out = graph.candidates(read(spark, sf_dir, "orders"), "o_orderkey", wishes, aggregate.rank_of(F.col("o_orderpriority"), RANKS), 25)
    return out.select("o_orderkey", "o_orderpriority", "rank")


ALL = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ALL))
def node_edge_counts(spark, sf_dir):
    return graph.counts({t: read(spark, sf_dir, t) for t in ALL})


@query("SELECT p.p_partkey AS src, c.k AS dst FROM part p JOIN (SELECT p_type, max(p_partkey) AS k FROM part GROUP BY p_type) c ON p.p_type = c.p_type")
def bridge_by_name(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return graph.bridge(part.select("p_partkey", "p_type"), part.select("p_type", F.col("p_partkey").alias("k")), "p_type", "p_partkey", "k")


@query("""SELECT source, doc_id, n AS members, sha256(l) AS digest FROM documents JOIN (SELECT source, count(DISTINCT doc_id) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS l FROM (SELECT DISTINCT source, doc_id FROM documents) GROUP BY source) USING (source)""")
def sibling_map(spark, sf_dir):
    """Each file's folder with all its members once: siblings are the others, without a list for each file."""
    files = read(spark, sf_dir, "documents").select("source", "doc_id")
    folders = graph.folder_members(files, "source", "doc_id").select("source", F.size("members").cast("long").alias("members"), ids.text_hash(F.array_join(F.transform("members", lambda x: x.cast("string")), ",")).alias("digest"))
    return files.join(folders, "source").select("source", "doc_id", "members", "digest")


@query("""SELECT s.s_suppkey, string_agg(t.s_suppkey::VARCHAR, ',' ORDER BY t.s_suppkey) AS siblings FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey AND s.s_suppkey <> t.s_suppkey GROUP BY s.s_suppkey""")
def sibling_lists(spark, sf_dir):
    out = graph.siblings(read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey").where(F.size("siblings") > 0)
    return out.select("s_suppkey", F.array_join(F.transform("siblings", lambda x: x.cast("string")), ",").alias("siblings"))


@query("""SELECT DISTINCT c.n_name AS used, s.n_name AS user FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE c.n_name <> s.n_name""")
def used_by_index(spark, sf_dir):
    t = lambda n: read(spark, sf_dir, n)
    pairs = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = pairs.select("c_nationkey", "s_nationkey").distinct()
    name = lambda k, a: t("nation").select(F.col("n_nationkey").alias(k), F.col("n_name").alias(a))
    return graph.used_by(pairs.join(name("c_nationkey", "used_name"), "c_nationkey").join(name("s_nationkey", "user_name"), "s_nationkey"), "user_name", "used_name")


def hygiene(spark, sf_dir):
    nodes = read(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("id"))
    valid = read(spark, sf_dir, "part").where("p_size >= 5").select(F.col("p_partkey").alias("id"))
    e = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") + F.col("l_linenumber")).alias("dst"), F.col("l_returnflag").alias("kind"))
    return graph.hygiene(nodes, e, valid, ["A", "R"])


SOUND = """v AS (SELECT p_partkey AS id FROM part WHERE p_size >= 5),
e AS (SELECT l_partkey AS src, l_partkey + l_linenumber AS dst, l_returnflag AS kind FROM lineitem WHERE l_partkey IN (SELECT id FROM v) AND l_partkey + l_linenumber IN (SELECT id FROM v))"""


@query(f"WITH {SOUND} SELECT id, id NOT IN (SELECT dst FROM e WHERE kind IN ('A', 'R')) AS entry FROM v")
def graph_hygiene(spark, sf_dir):
    nodes, _, first = hygiene(spark, sf_dir)
    return nodes.join(first.withColumn("entry", F.lit(True)).hint("shuffle_hash"), "id", "left").select("id", F.coalesce("entry", F.lit(False)).alias("entry"))


@query(f"WITH {SOUND} SELECT src, dst, kind FROM e")
def graph_hygiene_edges(spark, sf_dir):
    return hygiene(spark, sf_dir)[1].select("src", "dst", "kind")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def dangling_refs(spark, sf_dir):
    known = read(spark, sf_dir, "part").where("p_size < 45").select(F.col("p_partkey").alias("l_partkey"))
    return graph.dangling(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, ["l_partkey"])


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type <> 'view' GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM n)
SELECT u.user_id, coalesce(b.event_type, 'view') AS event_type FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON u.user_id = b.user_id AND r = 1""")
def dominant_value(spark, sf_dir):
    return aggregate.dominant(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "view")


@query("SELECT o_custkey, list_extract(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], max(" + RANK_SQL + ") + 1) AS o_orderpriority FROM orders GROUP BY o_custkey")
def ordinal_max(spark, sf_dir):
    return aggregate.ordinal_max(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", RANKS)


@query("SELECT source, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY source")
def union_flags(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return aggregate.union_flags(joined.withColumn("good", F.col("quality") == 1).withColumn("bad", F.col("toxic") == 1), "source", ["good", "bad"])


PRICES = {"view": (0.0025, 0.01), "click": (0.00015, 0.0006)}


@query("""WITH s AS (SELECT CAST(sum(event_id % 1000) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out, arg_min(event_type, event_id) AS model FROM events)
SELECT tokens_in, tokens_out, model, round(tokens_in / 1000 * CASE model WHEN 'view' THEN 0.0025 WHEN 'click' THEN 0.00015 ELSE 0.0004 END::DOUBLE
 + tokens_out / 1000 * CASE model WHEN 'view' THEN 0.01 WHEN 'click' THEN 0.0006 ELSE 0.0016 END::DOUBLE, 6) AS cost FROM s""")
def usage_total(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    return aggregate.usage_total(calls, "event_id", "model", "tokens_in", "tokens_out", PRICES, (0.0004, 0.0016))


@query("SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1 OR role = ''")
def dedup_first_wins(spark, sf_dir):
    return aggregate.first_wins(read(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], ["turn"], "role")


@query("""SELECT r.n_name, coalesce(m.r_regionkey, 999) AS r_regionkey, row_number() OVER (ORDER BY coalesce(m.r_regionkey, 999), n_name) AS number
FROM nation r LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) m ON r.n_regionkey = m.r_regionkey""")
def ordered_merge(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    order = n.join(read(spark, sf_dir, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_regionkey")
    return aggregate.numbered_merge(n.select("n_name"), order, "n_name", "r_regionkey").select("n_name", "r_regionkey", F.col("number").cast("long").alias("number"))


def headings(spark, sf_dir):
    """Messages as headings: the level is what the role says, the title the whole message; some are made to be labels, symbols, blanks or repeats."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"), F.expr(TITLE).alias("title"))


TITLE = """CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN 'Module Name: ' || role WHEN 1 THEN 'section title - x' WHEN 2 THEN '★ Star' WHEN 3 THEN ' ' WHEN 4 THEN ' Stock ' WHEN 5 THEN 'Rules:' WHEN 6 THEN 'Module x' ELSE text END"""
HEADINGS = f"h AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, {TITLE} AS title FROM conversations)"


@query(f"""WITH {HEADINGS}, s AS (SELECT a.conv_id, a.turn, a.level, (SELECT min(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.level <= a.level) AS stop FROM h a)
SELECT conv_id, turn, level, (SELECT count(*) FROM h b WHERE b.conv_id = s.conv_id AND b.turn > s.turn AND (s.stop IS NULL OR b.turn < s.stop)) AS descendants FROM s""")
def child_counts(spark, sf_dir):
    out = aggregate.descendants(headings(spark, sf_dir), "conv_id", "turn", "level")
    return out.select("conv_id", "turn", "level", F.col("descendants").cast("long").alias("descendants"))


@query(f"WITH {HEADINGS} SELECT conv_id, min(level) AS level FROM (SELECT conv_id, level, count(*) AS n FROM h GROUP BY ALL) WHERE n BETWEEN 2 AND 25 GROUP BY conv_id")
def module_levels(spark, sf_dir):
    return aggregate.module_level(headings(spark, sf_dir), "conv_id", "level")


@query(f"""WITH {HEADINGS}, s AS (SELECT a.*, (SELECT min(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.level <= a.level) AS stop FROM h a),
d AS (SELECT *, (SELECT count(*) FROM h b WHERE b.conv_id = s.conv_id AND b.turn > s.turn AND (s.stop IS NULL OR b.turn < s.stop)) >= 4 AS owns FROM s),
n AS (SELECT conv_id, level, count(*) AS n, count(*) FILTER (WHERE owns) AS m FROM d GROUP BY ALL),
c AS (SELECT conv_id, min(level) AS l, arg_min(n, level) AS n FROM n WHERE n BETWEEN 2 AND 25 OR (n > 25 AND m >= 2) GROUP BY conv_id)
SELECT d.conv_id, d.turn, d.level FROM d LEFT JOIN c ON d.conv_id = c.conv_id WHERE c.l IS NULL OR (d.level = c.l AND (c.n <= 25 OR d.owns))""")
def module_candidates(spark, sf_dir):
    return aggregate.module_candidates(headings(spark, sf_dir), "conv_id", "turn", "level").select("conv_id", "turn", "level")


@query(f"""WITH {HEADINGS}, t AS (SELECT conv_id, turn, level, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title FROM h), c AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY level) AS l FROM t WHERE title <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, title ORDER BY turn) AS r FROM c WHERE l <= 3 AND length(title) <= 150 AND unicode(title) < 9728
AND NOT regexp_matches(title, '(?i)^(module\\s*(name|no\\.?|number|title)|section\\s+title)\\s*[:—\\-]')) SELECT conv_id, turn, level, title FROM d WHERE r = 1""")
def preclean_headings(spark, sf_dir):
    return aggregate.clean_headings(headings(spark, sf_dir), "conv_id", "turn", "level", "title")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return aggregate.latest(e, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def global_latest(spark, sf_dir):
    return aggregate.page(read(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 1).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def paginate(spark, sf_dir):
    return aggregate.page(read(spark, sf_dir, "events").where("user_id = 5"), [F.col("ts").desc(), F.col("event_id")], 50, 10).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN arg_max(value, (ts, event_id)) END AS value FROM events GROUP BY user_id""")
def job_state(spark, sf_dir):
    log = read(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return aggregate.job_view(log, "user_id", [F.col("ts"), F.col("event_id")], "event_type", "value", "purchase").select("user_id", "event_type", "value")


@query("""SELECT doc_id, source || '/' || doc_id || '__chunk_0' AS chunk_id, substr(sha256(source || '/' || doc_id || '::0'), 1, 16) AS hashed_id, sha256(text) AS digest,
greatest(1, length(text) // 4)::INTEGER AS tokens, sha256(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '_', 'g')).trim('_')) AS slug FROM documents""")
def chunk_ids(spark, sf_dir):
    path, zero = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), F.lit(0)
    return read(spark, sf_dir, "documents").select("doc_id", ids.path_chunk_id(F.concat(F.lit("/"), path), zero).alias("chunk_id"), ids.hashed_chunk_id(path, zero).alias("hashed_id"), ids.text_hash(F.col("text")).alias("digest"), text.approx_tokens(F.col("text")).alias("tokens"), ids.text_hash(ids.slug(F.col("text"))).alias("slug"))


@query("""WITH h AS (SELECT doc_id, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '__chunk_' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ids.point_id(ids.path_chunk_id(F.col("source"), F.col("doc_id"))).alias("point_id"))


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT doc_id, sha256({CLEAN}) AS digest, length({CLEAN}) AS n FROM documents")
def clean_text(spark, sf_dir):
    x = text.clean(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", ids.text_hash(x).alias("digest"), F.length(x).cast("long").alias("n"))


@query("""WITH w AS (SELECT doc_id, text, split_part(text, chr(10), 2) AS h, split_part(text, chr(10), 3) AS f FROM documents WHERE text LIKE '%' || chr(10) || '%' || chr(10) || '%')
SELECT doc_id, sha256(CASE WHEN instr(text, h) = 0 THEN text WHEN instr(substr(text, instr(text, h) + length(h)), f) = 0 THEN substr(text, instr(text, h))
ELSE substr(text, instr(text, h), length(h) + instr(substr(text, instr(text, h) + length(h)), f) - 1) END) AS digest FROM w WHERE h <> '' AND f <> ''""")
def slice_by_heading(spark, sf_dir):
    line = lambda n: F.coalesce(F.get(F.split("text", "\n"), F.lit(n - 1)), F.lit(""))
    w = read(spark, sf_dir, "documents").where("text LIKE '%\\n%\\n%'").select("doc_id", "text", line(2).alias("h"), line(3).alias("f")).where("h <> '' AND f <> ''")
    return w.select("doc_id", ids.text_hash(text.section_between(F.col("text"), F.col("h"), F.col("f"))).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)
SELECT doc_id, p - 1 AS pos, sha256(line) AS digest FROM l WHERE trim(line) <> ''""")
def line_chunks(spark, sf_dir):
    out = chunking.pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "\n")
    return out.where(F.trim("piece") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), ids.text_hash(F.col("piece")).alias("digest"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def flatten_nested(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("lines"))
    nested = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("lines", F.filter("lines", lambda x: x["l_returnflag"] == "R"))
    return nested.select("o_orderkey", F.explode("lines").alias("x")).select("o_orderkey", "x.l_linenumber", "x.l_partkey")


@query("""SELECT c_custkey, c_name, CASE WHEN c_acctbal <= 1000 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def guarded_projection(spark, sf_dir):
    rows = search.filtered(read(spark, sf_dir, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "ignored": {"a": 1}, "other": 3}, ["c_mktsegment"])
    return rows.select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("c_acctbal"))


@query("SELECT p_type, p_size, 'T' || p_type || '-' || p_size AS pair FROM (SELECT DISTINCT p_type FROM part), (SELECT DISTINCT p_size FROM part WHERE p_size <= 5)")
def static_edges(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    sizes = F.array_sort(F.collect_set(F.when(F.col("p_size") <= 5, F.col("p_size"))))
    types = part.groupBy("p_type").agg(F.lit(1).alias("one")).join(part.agg(sizes.alias("sizes")).withColumn("one", F.lit(1)), "one")
    return types.select("p_type", F.explode("sizes").alias("p_size")).withColumn("pair", F.concat(F.lit("T"), "p_type", F.lit("-"), F.col("p_size").cast("string")))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders QUALIFY position <= 3""")
def top_per_group(spark, sf_dir):
    by = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).cast("long").alias("position")).where("position <= 3")
