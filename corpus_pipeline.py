"""The corpus pipeline: toxicity, language, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last return the
columns of documents; the last returns token ids. SQL can't express the learned stages, so there is none for the whole;
tests hold each stage against a plain version.

Decisions are made row by row: scores are attached in the map that reads the row, and where rows must meet again they
meet by a key of their whole content. So null and repeated doc_ids are rows like any others, and of two rows with one
doc_id each stands for itself. Columns besides those of documents are dropped; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import langid, mixing, pieces, simhash, toxicity
from corpusgraph.llm.common import driver_gives_back, give_back, materialize, read, release, row_key, tables_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle where near duplicates are found.
SHINGLE = 5
#: Below this posterior no language is taken to be certain.
LEAST_CERTAIN = 0.5
#: Documents are rejected as toxic from this score on.
TOXIC = 0.5


def ordered_key() -> Column:
    """A key of a row's content whose order is that of doc_id, null last; equal rows have equal keys."""
    shifted = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(shifted, F.lit("~" * 16)), row_key(*COLUMNS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below TOXIC; a null or empty text scores 0 and stays. The network learns from labels by doc_id."""
    rows = docs.select(*COLUMNS)
    net = toxicity.learn(rows, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.scored(rows, net).where(F.col("score") < TOXIC).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a certain language, which becomes their lang where that is null; null texts and those without a letter have none."""
    rows = docs.select(*COLUMNS)
    found = langid.predicted(rows, *langid.learn(rows)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CERTAIN))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, of several such the first by content.
    Texts without words are one group."""
    give_back()  # what the stages before left in the driver's Python
    driver_gives_back(spark)
    rows = docs.select(*COLUMNS)
    keyed = rows.withColumn("key", ordered_key())
    first = simhash.similar(keyed.select("key", "text"), SHINGLE).where(F.col("key") == F.col("component_id"))
    return keyed.dropDuplicates(["key"]).join(first.select("key").distinct(), "key", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as their source's target takes them; a null source is a source of its own."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; a null text has null ids."""
    return pieces.encode_texts(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage of this run read and wrote on its way is then
    deleted, and nothing else."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with tables_of() as written:
            docs = materialize(stage(spark, before, sf_dir))
        release(before, *written, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
