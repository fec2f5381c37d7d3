"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key (MD5 of doc_id and size). Rows that are alike in doc_id, source and size are counted
first, so that a hot doc_id is one group of a number of copies, whatever its share. A source's groups are ranged by
their key into buckets; sums per bucket and their prefix sums, then prefix sums inside a bucket, give each group's place
in words, and its copies follow each other there. The budget of a source is cut at that place: whole epochs are repeated
for every row, and the rest goes to the rows before the cut, the last of them in part.

Nulls: a null text has no words, a null source is a source of its own that sorts last, a null doc_id is a key like any
other. Equal keys are ordered by doc_id and size. Repeated rows count each. Without words all targets are zero. An
empty table gives no rows. Columns that clash with those made here can't: inputs are projected first. The windows over
sources have one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read, row_key

#: Rows of a bucket of keys, on average over all sources.
BUCKET_ROWS = 2000
#: Copies of a row that one task makes at once.
COPIES = 10_000
#: No source and no document is taken more often.
MOST_EPOCHS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """From (sk, source, source_size): weights 1, 2, 3, repeating by code point, null last, and targets by water filling.

    With sources ordered by cap over weight, level i is what a unit of weight gets once the first i - 1 are at their cap;
    the first level that the i-th source can take is the one that holds.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("weight", (F.row_number().over(every) - 1) % 3 + 1).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("i", F.row_number().over(by))
    s = s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left").cast("double") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("i"))).over(whole))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    budget = F.floor("target").cast("long")
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    return s.select("sk", "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix(groups: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Places of groups of alike rows (doc_id, source, size, n: how many, and more, columns without nulls that tell groups apart): adds source_size, target, epochs, rest and
    before (words of the source's rows that come earlier)."""
    told = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), *[F.col(c).cast("string") for c in more]]
    key = F.md5(F.concat_ws("/", *told).cast("binary"))
    rows = materialize(groups.withColumn("sk", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("key", key).withColumn("all", F.col("n") * F.col("size")))
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.expr(f"cast(conv(substring(key, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296"))
    sums = materialize(rows.groupBy("sk", "source", "bucket").agg(F.sum("all").alias("all")))
    before = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sums.select("sk", "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    cuts = cuts.join(targets(sums.groupBy("sk", "source").agg(F.sum("all").alias("source_size"))), "sk")
    inside = Window.partitionBy("sk", "bucket").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(cuts, ["sk", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("all").over(inside), F.lit(0)))


def rows_again(groups: DataFrame) -> DataFrame:
    """A row for each of a group's n, with its number _i. Large groups are cut into pieces of COPIES that any task may take."""
    pieces = groups.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    if (groups.agg(F.max("n")).first()[0] or 0) > COPIES:
        pieces = materialize(pieces).repartition(*[F.col(c) for c in ("sk", "key", "_from")])
    return pieces.withColumn("_i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("n")) - 1)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    thin = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    placed = materialize(mix(thin.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("_i") * F.col("size")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    return rows_again(placed).select("doc_id", "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, of rows with doc_id, text, source and any other columns: each row once for each time that it is taken whole.

    The row at a source's cut comes once more if at least half of it is within the budget; texts are never cut. Rows
    without words belong to every epoch, and to the rest if before the cut. Rows that are alike in all columns are
    counted and come as often as all of them are taken; nothing is matched by doc_id.
    """
    own, key = docs.columns, row_key(*docs.columns)
    thin = docs.select(key.alias("_row"), "doc_id", "source", words(F.col("text")).alias("size"))
    placed = mix(thin.groupBy("_row", "doc_id", "source", "size").agg(F.count("*").alias("n")), ("_row",))
    left = F.col("rest") - F.col("before")
    # copy i is taken once more if (left - i * size) * 2 >= size
    again = F.when(F.col("size") > 0, F.floor((left * 2 + F.col("size")) / (2 * F.col("size")))).otherwise(F.when(left > 0, F.col("n")).otherwise(0))
    times = F.col("n") * F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("n"), again.cast("long")))
    often = placed.select("_row", times.alias("_times")).where("_times > 0")
    one = docs.withColumn("_row", key).dropDuplicates(["_row"])
    return one.join(often, "_row").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*own)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS VARCHAR)) AS key
  FROM documents),
s AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
    FROM d GROUP BY source)),
l AS (
  SELECT *, row_number() OVER w AS i,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s WINDOW w AS (ORDER BY ratio, source IS NULL, source)),
t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), (SELECT arg_min(level, i) FROM l WHERE level <= ratio) * weight) AS target
  FROM l),
e AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS BIGINT) AS epochs FROM t),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d)
SELECT p.doc_id, p.size, e.source_size, e.target,
       CAST(e.epochs * p.size + greatest(0, least(p.size, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size - p.before)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
