"""Phrase collocations of each language, with DataFrame operations.

All words and pairs of words inside a piece become rows, and one hash aggregate counts them for each language (phrase and
language are one string there, which makes its rows smaller); rows that are alike are counted where they arise, before
the shuffle. Longer phrases are counted a length at a time, and only those whose two parts, shorter by a word, seem
frequent enough; else they can't be. That is looked up in a bitmap of the frequent parts' hashes, which is broadcast: its
size is bounded, and a part that only seems frequent costs a row and changes no count. A phrase that is frequent enough is cut at each place, and
the counts of both parts are joined; frequent parts are salted there. Scores are decimals of 38 digits without a
fraction, so they are exact for counts below 10^16. A phrase goes if an extension by one word has enough of its
occurrences; that is enough, for one inside a longer extension is also inside one of those by one word, which occurs at
least as often.

Nulls: a null text is empty, a null lang is `und`, the same as that value. Texts, pieces and lines without words give
no rows. Repeated rows count each; an empty table gives no rows; extra columns aren't read. Ties in score go by count, then
by the phrase's UTF-8 bytes, so ranks are the same in each run.
"""

from __future__ import annotations

import contextlib
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, spread_join

#: Where texts are cut into pieces, and what words are.
CUTS = r"[.,;:!?\x0A-\x0D]"
PHRASE_WORD = r"[^\x20\x09]+"
LEAST_COUNT, FIRST = 10, 2000
#: A phrase goes if an extension has so many hundredths of its occurrences.
COVERED = 50


#: Splits of the input that a task counts together: the more, the fewer rows are left to shuffle.
SPLITS = 2
#: Of the bitmap of frequent parts: bits of a row of it, bits for each part, and bits in all (16 MB), whatever the number of parts.
BLOCK_BITS, BITS_A_PHRASE, MOST_BITS = 1 << 15, 16, 1 << 27
#: Texts where lower-casing A-Z isn't what lower() does, or may not be.
NOT_PLAIN = r"[^\x00-\u024F]|[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
#: Of phrases whose rank is sought, each of so many parts of a language gives its best first.
RANK_PARTS = 16


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed; where no other letter has a case to lose, by the faster way."""
    return F.when(text.rlike(NOT_PLAIN), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


@contextlib.contextmanager
def one_map(spark: SparkSession) -> Iterator[None]:
    """Inside, hash aggregates don't look into a small map before the large one, which is lost work where most keys are rare."""
    name = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def word_rows(docs: DataFrame, max_n: int) -> DataFrame:
    """end (a tab and the language), w0, w1, ...: every word and the max_n - 1 words after it, null beyond the piece."""
    pieces = docs.select("lang", F.explode(F.split(lowered(F.col("text")), CUTS)).alias("piece"))
    words = pieces.select(F.concat(F.lit("\t"), "lang").alias("end"), F.regexp_extract_all("piece", F.lit(PHRASE_WORD), F.lit(0)).alias("words"))
    # a word and those after it become columns of one row, so that no row carries its piece
    later = [F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))).alias(f"w{k}") for k in range(1, max_n)]
    return words.select("end", F.inline(F.arrays_zip(F.col("words").alias("w0"), *later)))


def key_of(n: int) -> Column:
    """A phrase of n words, a tab, its language (a phrase has no tab); null beyond the piece."""
    return F.concat("w0", *[x for j in range(1, n) for x in (F.lit(" "), F.col(f"w{j}"))], "end")


def bit_of(words: list[Column], end: Column, bits: int) -> Column:
    """The place of a phrase in a bitmap."""
    return F.xxhash64(*words, end).bitwiseAND(F.lit(bits - 1))


def bitmap(phrases: DataFrame, n: int) -> tuple[DataFrame, int]:
    """block (of BLOCK_BITS) and marks (array<long>) of the bitmap of phrases (lang, phrase) of n words, and its bits."""
    bits = BLOCK_BITS
    while bits < min(BITS_A_PHRASE * phrases.count(), MOST_BITS):
        bits *= 2
    w = F.split("phrase", " ")
    set_ = phrases.select(bit_of([w[i] for i in range(n)], F.concat(F.lit("\t"), "lang"), bits).alias("bit"))
    longs = set_.select(F.shiftright("bit", 6).alias("long"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mark"))
    longs = longs.unionByName(phrases.sparkSession.range(bits // 64).select(F.col("id").alias("long"), F.lit(0).cast("long").alias("mark")))
    longs = longs.groupBy("long").agg(F.bit_or("mark").alias("mark"))
    blocks = longs.groupBy(F.expr(f"long div {BLOCK_BITS // 64}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("long", "mark")))["mark"].alias("marks"))
    return materialize(blocks), bits


def of_frequent_parts(rows: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """rows of word_rows but for those whose first n words can't be a phrase of frequent parts. parts (lang, phrase): those of n - 1 words."""
    blocks, bits = bitmap(parts, n - 1)
    rows = rows.where(F.col(f"w{n - 1}").isNotNull())
    for first in (0, 1):
        place = bit_of([F.col(f"w{i}") for i in range(first, first + n - 1)], F.col("end"), bits)
        rows = rows.withColumn("bit", place).withColumn("block", F.expr(f"bit div {BLOCK_BITS}")).join(F.broadcast(blocks), "block")
        rows = rows.where(F.expr(f"getbit(marks[cast(bit % {BLOCK_BITS} div 64 AS int)], cast(bit & 63 AS int)) = 1")).drop("bit", "block", "marks")
    return rows


def key_counts(keys: DataFrame, least: int) -> DataFrame:
    """lang, phrase, a of keys: how often a word occurs, or a phrase that occurs `least` times or more."""
    phrase = F.substring_index("key", "\t", 1)
    counts = keys.groupBy("key").agg(F.count("*").alias("a")).where((F.col("a") >= least) | ~F.contains(phrase, F.lit(" ")))
    return counts.select(F.substr("key", F.length(phrase) + 2).alias("lang"), phrase.alias("phrase"), "a")


def counted(docs: DataFrame, max_n: int, least: int) -> DataFrame:
    """lang, phrase, a: how often it occurs, of all words and of phrases of 2 to max_n words that occur `least` times or more; written."""
    keys = word_rows(docs, 2).select(F.explode(F.array(key_of(1), key_of(2))).alias("key")).where(F.col("key").isNotNull())
    out = last = materialize(key_counts(keys, least))
    for n in range(3, max_n + 1):
        parts = last.where(F.contains("phrase", F.lit(" ")))
        last = materialize(key_counts(of_frequent_parts(word_rows(docs, n), parts, n).select(key_of(n).alias("key")), least))
        out = out.unionByName(last)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: of phrases of two words or more, by their lowest cut. counts should be written."""
    parts = F.split("phrase", " ")
    phrases = counts.select("lang", "phrase", "a", parts.alias("w")).where(F.size("w") > 1)
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    join = lambda *x: F.array_join(F.slice("w", *x), " ")
    cuts = materialize(cuts.select("lang", "phrase", "a", "k", join(1, F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w")).alias("rest")))
    told = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    both = materialize(spread_join(cuts, told("first", "l"), ["lang", "first"]))
    both = spread_join(both, told("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast({1_000_000} * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) AS decimal(38,0)) div cast(cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)) AS decimal(38,0))")
    both = both.withColumn("score", score)
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x")
    return both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.*")


def uncovered(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """phrases (lang, phrase, a, ...) that no one of them, longer by one word at either end, covers."""
    w = F.split("phrase", " ")
    longer = phrases.where(F.size(w) > 2).select("lang", "a", F.explode(F.array_distinct(F.array(
        F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w) - 1), " ")))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    enough = (phrases["lang"] == most["lang"]) & (phrases["phrase"] == most["phrase"]) & (100 * most["_most"] >= covered * phrases["a"])
    return phrases.join(most, enough, "left_anti")


def collocations(docs: DataFrame, max_n: int = 3, least: int = LEAST_COUNT, first: int = FIRST) -> DataFrame:
    """The best phrases of 2 to max_n words of each language of docs (text, lang): lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with one_map(docs.sparkSession):
        counts = counted(docs.coalesce(max(1, docs.rdd.getNumPartitions() // SPLITS)), max_n, least)
    left = uncovered(materialize(scored(counts.where(F.col("a") >= least)))).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    for within in (["lang", "_part"], ["lang"]):  # a language's phrases are ranked in parts first
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= first)
    ranked = left.drop("_part")
    sizes = counts.where(~F.contains("phrase", F.lit(" "))).groupBy("lang").agg(F.sum("a").cast("long").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3)) AS ks(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
size AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
part AS (
  SELECT lang, phrase, k, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS x, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS y
  FROM c, (VALUES (1), (2)) AS js(j) WHERE j < k),
cut AS (
  SELECT part.lang, part.phrase, part.k, part.a, j, fx.a AS l, fy.a AS r,
         CAST((CAST(1000000 AS HUGEINT) * part.a * part.a) // (CAST(fx.a AS HUGEINT) * fy.a) AS BIGINT) AS score
  FROM part JOIN f fx ON fx.lang = part.lang AND fx.phrase = part.x JOIN f fy ON fy.lang = part.lang AND fy.phrase = part.y),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
wide AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase
    FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN wide ON wide.lang = low.lang AND wide.phrase = low.phrase WHERE wide.most IS NULL OR 100 * wide.most < 50 * low.a)
SELECT * FROM (
  SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank,
         phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
  FROM kept JOIN size ON size.lang = kept.lang)
WHERE rank <= 2000
"""
