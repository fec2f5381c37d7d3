"""Aggregations with the order of rows: first wins, modes with a tie-break, merges, boundaries, latest states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dominant(df: DataFrame, group: str, value: str, order: str, ignored: str = "unknown") -> DataFrame:
    """The most frequent value of a group, ties to the one seen first; `ignored` where there is none."""
    n = df.where(F.col(value) != ignored).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = n.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(value))
    return df.select(group).distinct().join(best, group, "left").withColumn(value, F.coalesce(value, F.lit(ignored)))


def rank_of(value: Column, ranks: Sequence[str]) -> Column:
    """The place in ranks, 0 for others."""
    return F.coalesce(F.create_map(*[x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i))])[value], F.lit(0))


def ordinal_max(df: DataFrame, group: str, value: str, ranks: Sequence[str]) -> DataFrame:
    top = F.max(rank_of(F.col(value), ranks))
    return df.groupBy(group).agg(F.element_at(F.array(*[F.lit(r) for r in ranks]), top + 1).alias(value))


def union_flags(df: DataFrame, group: str, flags: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """True if any is; of lists the distinct members, sorted."""
    members = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(x)))).alias(x) for x in lists]
    return df.groupBy(group).agg(*[F.bool_or(f).alias(f) for f in flags], *members)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_unnamed: str | None = None) -> DataFrame:
    """The first row of each key; rows whose `keep_unnamed` is empty all stay."""
    by = Window.partitionBy(*keys).orderBy(*order)
    keep = F.col("_r") == 1
    if keep_unnamed:
        keep = keep | (F.coalesce(F.col(keep_unnamed), F.lit("")) == "")
    return df.withColumn("_r", F.row_number().over(by)).where(keep).drop("_r")


def numbered_merge(results: DataFrame, modules: DataFrame, name: str, order: str, unknown: int = 999, run: str | None = None) -> DataFrame:
    """Results numbered by the order of their module, unknown ones last; the result's own name stands. `run` tells apart
    several documents' results, each numbered by itself; without it all are one document's, and few."""
    keys = [name] if run is None else [run, name]
    joined = results.join(modules.select(*keys, order), keys, "left").withColumn(order, F.coalesce(order, F.lit(unknown)))
    by = Window.partitionBy(F.lit(0) if run is None else F.col(run)).orderBy(order, name)
    return joined.withColumn("number", F.row_number().over(by))


def descendants(headings: DataFrame, document: str, pos: str, level: str, levels: int = 12) -> DataFrame:
    """How many headings follow each before one of its own level or above. Levels are integers from 0 to `levels` - 1;
    another one is an error.

    A document's headings are one window, read backwards: the next place of each level is a running minimum, so the work
    grows with headings times levels, never with their square."""
    by = Window.partitionBy(document).orderBy(pos)
    later = Window.partitionBy(document).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = headings.withColumn("_i", F.row_number().over(by)).withColumn("_n", F.count("*").over(Window.partitionBy(document)))
    stops = [F.when(F.col(level) >= k, F.min(F.when(F.col(level) == k, F.col("_i"))).over(later)) for k in range(levels)]
    fits = F.coalesce(F.col(level).between(0, levels - 1), F.lit(False))
    found = (F.coalesce(F.least(*stops), F.col("_n") + 1) - F.col("_i") - 1).cast("int")
    told = F.concat(F.lit(f"levels are from 0 to {levels - 1}, not "), F.coalesce(F.col(level).cast("string"), F.lit("null")))
    return h.withColumn("descendants", F.when(fits, found).otherwise(F.raise_error(told).cast("int"))).drop("_i", "_n")


def module_level(headings: DataFrame, document: str, level: str, least: int = 2, most: int = 25) -> DataFrame:
    """The shallowest level of a document that has `least` to `most` headings."""
    n = headings.groupBy(document, level).agg(F.count("*").alias("n"))
    return n.where(F.col("n").between(least, most)).groupBy(document).agg(F.min(level).alias(level))


def module_candidates(headings: DataFrame, document: str, pos: str, level: str, least: int = 2, most: int = 25, children: int = 4) -> DataFrame:
    """The headings of the shallowest level that has `least` to `most`, or, of more, at least `least` with `children` descendants: those. A document without such a level keeps all."""
    h = descendants(headings, document, pos, level).withColumn("_owns", F.col("descendants") >= children).drop("descendants")
    n = h.groupBy(document, level).agg(F.count("*").alias("_n"), F.count_if("_owns").alias("_m"))
    fits = F.col("_n").between(least, most) | ((F.col("_n") > most) & (F.col("_m") >= least))
    chosen = n.where(fits).groupBy(document).agg(F.min_by(F.struct(F.col(level).alias("l"), F.col("_n").alias("n")), level).alias("_c"))
    keep = F.col("_c").isNull() | ((F.col(level) == F.col("_c.l")) & ((F.col("_c.n") <= most) | F.col("_owns")))
    return h.join(chosen, document, "left").where(keep).drop("_owns", "_c")


#: Fixed value: headings that are labels of a field.
LABEL = r"(?i)^(module\s*(name|no\.?|number|title)|section\s+title)\s*[:—\-]"


def clean_headings(headings: DataFrame, document: str, pos: str, level: str, text: str) -> DataFrame:
    """Headings of the three shallowest levels of a document (blank ones don't count), without those of more than 150
    characters, with a symbol in front, or that label a field; the first of equals. Their text comes trimmed."""
    h = headings.withColumn(text, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).where(F.col(text) != "")
    h = h.withColumn("_l", F.dense_rank().over(Window.partitionBy(document).orderBy(level))).where("_l <= 3").drop("_l")
    ok = (F.length(text) <= 150) & (F.ascii(text) < 0x2600) & ~F.col(text).rlike(LABEL)
    return first_wins(h.where(ok), [document, text], [pos])


def latest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key: a partial aggregate before the shuffle."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_x")).select(key, "_x.*")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def job_view(log: DataFrame, job: str, order: Sequence[Column], status: str, result: str, done: str = "completed") -> DataFrame:
    """The state of each job; its result only once it is done."""
    return latest(log, job, order).withColumn(result, F.when(F.col(status) == done, F.col(result)))


def usage_total(calls: DataFrame, order: str, model: str, tokens_in: str, tokens_out: str, prices: Mapping[str, tuple[float, float]], default: tuple[float, float]) -> DataFrame:
    """Sums of tokens, and their price by the first row's model."""
    from ..functions.text import price

    s = calls.agg(F.sum(tokens_in).alias(tokens_in), F.sum(tokens_out).alias(tokens_out), F.min_by(model, order).alias(model))
    return s.withColumn("cost", price(F.col(model), F.col(tokens_in), F.col(tokens_out), prices, default))
