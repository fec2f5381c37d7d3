"""Filtered, weighted, multi-lane nearest neighbours, and expansion of hits to files and example sets.

Scores are exact; every ranking has the key as its last order. Lanes are ranked by a window per lane, which keeps k rows
of each partition before it shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 5
#: Weights of the lanes, and what the first matching rule raises.
DEFAULT_WEIGHTS = {"code": 1.0, "config": 0.9, "doc": 0.7}
BOOSTS = {"doc": 1.2, "config": 1.2, "code": 1.1}


def vector_literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def cosine(vector: Column, query: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(vector, query) / (F.sqrt(dot(vector, vector)) * F.sqrt(dot(query, query)))


def build_filter(conditions: Mapping[str, object], allowed: Sequence[str] | None = None) -> Column | None:
    """A list is IN, a scalar is equality; null, mappings and fields that aren't allowed are ignored; nothing is no filter."""
    parts = []
    for name, value in conditions.items():
        if value is None or isinstance(value, Mapping) or (allowed is not None and name not in allowed):
            continue
        if isinstance(value, (list, tuple, set)):
            parts.append(F.col(name).isin(list(value)))
        elif isinstance(value, (str, int, float, bool)):
            parts.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(points: DataFrame, conditions: Mapping[str, object] | None, allowed: Sequence[str] | None = None) -> DataFrame:
    found = build_filter(conditions or {}, allowed)
    return points if found is None else points.where(found)


def top_k(points: DataFrame, query: Sequence[float], key: str, k: int = TOP_K, conditions: Mapping[str, object] | None = None, vector: str = "embedding") -> DataFrame:
    scored = filtered(points, conditions).withColumn("score", cosine(F.col(vector), vector_literal(query)))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def as_hits(scored: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    """score, text and metadata: a struct of all other columns."""
    return scored.select(score, text, F.struct(*[c for c in scored.columns if c not in (score, text)]).alias("metadata"))


def by_key(rows: DataFrame, key: str, value: object, columns: Sequence[str] = (), as_json: Sequence[str] = ()) -> DataFrame:
    """The row of a key, if there is one; columns of JSON text come as variants."""
    found = rows.where(F.col(key) == value).limit(1)
    return found.select(*[F.try_parse_json(c).alias(c) if c in as_json else F.col(c) for c in (columns or rows.columns)])


def all_by_name(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return rows.select(*columns).orderBy(name)


def members(nested: DataFrame, array: str, keep: Mapping[str, object]) -> DataFrame:
    """The rows with only those members of an array of structs that have the values in `keep`."""
    fits = lambda x: reduce(lambda a, b: a & b, [x[k] == v for k, v in keep.items()])
    return nested.withColumn(array, F.filter(array, fits))


def lane_top_k(points: DataFrame, query: Sequence[float], lane: str, weights: Mapping[object, float], key: str, k: int = TOP_K, overall: int | None = None, vector: str = "embedding") -> DataFrame:
    """The k best of each lane, weighted; of all, the best k for each lane (or `overall`)."""
    scored = points.where(F.col(lane).isin(list(weights))).withColumn("score", cosine(F.col(vector), vector_literal(query)))
    by = Window.partitionBy(lane).orderBy(F.col("score").desc(), key)
    best = scored.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col(lane)]
    best = best.withColumn("score", F.col("score") * weight)
    return best.orderBy(F.col("score").desc(), key).limit(k * len(weights) if overall is None else overall)


#: Rules in order, the lane that each raises (the third tells the case of letters).
INTENT_RULES = (
    ("doc", r"(?i)\b(how\s+to|what\s+is|explain|guide|tutorial|usage|example|storybook|readme|docs?)\b"),
    ("config", r"(?i)\b(interface|type\s+alias|schema|props?\b|config\s+type|extends|enum)\b"),
    ("code", r"\b(use[A-Z]\w+|[A-Z][a-z]+(?:[A-Z][a-z]+)+|import|component|hook)\b"),
)


def intent_weights(query: Column) -> dict[str, Column]:
    """Of each lane: its default, raised by the first rule that matches."""
    first = None
    for lane, rule in reversed(INTENT_RULES):
        first = F.when(query.rlike(rule), F.lit(lane)) if first is None else F.when(query.rlike(rule), F.lit(lane)).otherwise(first)
    return {lane: F.when(first == lane, F.lit(max(w, BOOSTS[lane]))).otherwise(F.lit(w)) for lane, w in DEFAULT_WEIGHTS.items()}


def classify_intent(query: str) -> dict[str, float]:
    out = dict(DEFAULT_WEIGHTS)
    lane = next((lane for lane, rule in INTENT_RULES if re.search(rule, query)), None)
    return out | ({lane: max(out[lane], BOOSTS[lane])} if lane else {})


def expand(hits: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """All members of the groups that hits are in, with the group's best score."""
    best = hits.where(F.col(group).isNotNull()).groupBy(group).agg(F.max("score").alias("best_score"))
    return members.join(best, group)


def whole_files(members: DataFrame, group: str, file: str, index: str, text: str, more: Sequence[str] = ()) -> DataFrame:
    """One row for each file of a group: how many chunks it has, their texts joined in order, `more` from its first chunk,
    and the best score. The store's limit on chunks isn't kept: every chunk counts."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda x: x[text])
    first = [F.min_by(c, index).alias(c) for c in more]
    return members.groupBy(group, file).agg(F.count("*").alias("chunks"), F.array_join(parts, "\n").alias(text), F.max("best_score").alias("best_score"), *first)


def first_scores(hits: DataFrame, group: str, order: Sequence[Column | str]) -> DataFrame:
    """The score of the first hit of each group in an order; for hits that come best first this is the best."""
    return hits.groupBy(group).agg(F.min_by("score", F.struct(*order)).alias("best_score"))


def ranked_files(members: DataFrame, role: str, ranks: Mapping[str, int], other: int = 99) -> DataFrame:
    """role_rank of each member: the order of an example set."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[F.col(role)], F.lit(other))
    return members.withColumn("role_rank", rank)


def combined(lanes: DataFrame, examples: DataFrame) -> DataFrame:
    """Both result lists, told apart by _source."""
    return lanes.withColumn("_source", F.lit("unified")).unionByName(examples.withColumn("_source", F.lit("examples")))


#: The languages of the code lane unless a query says otherwise.
CODE_LANGUAGES = ("typescript", "tsx")


def intent_search(
    points: DataFrame, examples: DataFrame, query: str, vector: Sequence[float], key: str, k: int = TOP_K, conditions: Mapping[str, object] | None = None,
    example_conditions: Mapping[str, object] | None = None, expand_files: bool = False, file: str = "file_id", lane: str = "content_type", language: str = "language", example: str = "example_id",
) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Hits of the three lanes, weighted by the query's intent and best first; hits of the examples; the weights.

    The code lane is limited to CODE_LANGUAGES unless the conditions name a language. expand_files: lanes give files
    (their best score, weighted; of a file in several lanes the best), examples give all members of the hits' sets."""
    weights, conditions = classify_intent(query), conditions or {}
    own = {"code": {language: list(CODE_LANGUAGES)} | dict(conditions), "doc": conditions, "config": conditions}
    parts = [top_k(points.where(F.col(lane) == name), vector, key, k, own[name]).withColumn("score", F.col("score") * weights[name]) for name in own]
    hits = reduce(DataFrame.unionByName, parts)
    if expand_files:
        hits = hits.groupBy(file).agg(F.max("score").alias("score"), F.max_by(lane, "score").alias(lane))
    found = top_k(examples, vector, key, k, example_conditions)
    if expand_files:
        found = expand(found, examples, example).withColumnRenamed("best_score", "score")
    return hits.orderBy(F.col("score").desc(), file if expand_files else key), found, weights


def as_result(hits: DataFrame, found: DataFrame, query: str, weights: Mapping[str, float], columns: Sequence[str]) -> DataFrame:
    """One row of a search: query, weights, both lists (bounded by the search's k) and their lengths."""
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(F.col("score"), *columns)), asc=False).alias(name))
    both = listed(hits, "unified_results").withColumn("_one", F.lit(1)).join(listed(found, "example_results").withColumn("_one", F.lit(1)), "_one").drop("_one")
    both = both.withColumn("total_unified", F.size("unified_results")).withColumn("total_examples", F.size("example_results"))
    return both.withColumn("query", F.lit(query)).withColumn("intent_weights", F.create_map(*[F.lit(x) for p in weights.items() for x in p]))
