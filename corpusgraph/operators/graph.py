"""Typed node and edge tables: traversal, division, bridges, hygiene. Edges have src and dst."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load_nodes(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key])


def load_edges(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).dropDuplicates(["src", "dst"])


def one_hop(sources: DataFrame, edges: DataFrame, targets: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Sources, what the edge says, and targets; several edges multiply rows."""
    return sources.join(edges, sources[source_key] == edges["src"]).join(targets, F.col("dst") == targets[target_key])


def division(edges: DataFrame, wanted: list, distinct: bool = True) -> DataFrame:
    """src that have an edge to everything wanted. Without `distinct`, edges and repeated wishes are counted as they come."""
    if not wanted:
        return edges.select("src").limit(0)
    n = F.count_distinct("dst") if distinct else F.count("*")
    return edges.where(F.col("dst").isin(wanted)).groupBy("src").agg(n.alias("n")).where(F.col("n") == (len(set(wanted)) if distinct else len(wanted))).select("src")


def candidates(nodes: DataFrame, key: str, wishes: list[tuple[DataFrame, list]], rank: Column, limit: int, limit_first: bool = False) -> DataFrame:
    """Nodes that pass every division, by rank downward, then key; ordered before the limit. limit_first: the limit takes
    the least keys, and only these are ordered."""
    for edges, wanted in wishes:
        if wanted:
            nodes = nodes.join(division(edges, wanted), nodes[key] == F.col("src"), "left_semi")
    ranked = nodes.withColumn("rank", rank)
    if limit_first:
        return ranked.orderBy(key).limit(limit).orderBy(F.col("rank").desc(), key)
    return ranked.orderBy(F.col("rank").desc(), key).limit(limit)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bridge(symbols: DataFrame, components: DataFrame, name: str, symbol_key: str, component_key: str) -> DataFrame:
    """Symbols linked to the component of the same name; the last component of a name counts."""
    last = components.groupBy(name).agg(F.max(component_key).alias(component_key))
    return symbols.join(last, name).select(F.col(symbol_key).alias("src"), F.col(component_key).alias("dst"))


def used_by(uses: DataFrame, user: str, used: str) -> DataFrame:
    """Distinct (used, user), a user of itself left out."""
    return uses.where(F.col(user) != F.col(used)).select(F.col(used).alias("used"), F.col(user).alias("user")).distinct()


def sibling_counts(files: DataFrame, parent: str, path: str) -> DataFrame:
    """How many others are in the same folder; a list of them would grow with the folder's square."""
    n = files.groupBy(parent).agg(F.count_distinct(path).alias("n"))
    return files.select(parent, path).distinct().join(n, parent).select(path, parent, (F.col("n") - 1).alias("siblings"))


def folder_members(files: DataFrame, parent: str, path: str) -> DataFrame:
    """Each folder once, with the sorted list of its files: a file's siblings are the others of its folder, so the lists
    of all files follow by a join, and nothing grows with a folder's square."""
    return files.groupBy(parent).agg(F.array_sort(F.collect_set(path)).alias("members"))


def siblings(files: DataFrame, parent: str, path: str) -> DataFrame:
    """The other files of the same folder as an array, for folders of source trees: the folder's list is joined to each file."""
    members = folder_members(files, parent, path)
    return files.join(members, parent).withColumn("siblings", F.array_remove("members", F.col(path))).drop("members")


def hygiene(nodes: DataFrame, edges: DataFrame, valid: DataFrame, inbound: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid nodes (missing ones added), edges with both ends valid, and entry points: nodes that no `inbound` edge reaches.

    All have id; edges also kind. The joins are hash joins by a shuffle: what is built is a part of the ids, while edges
    stream past it unsorted, and neither is broadcast by a guess of its size.
    """
    by_hash = lambda df: df.hint("shuffle_hash")
    ids = valid.select("id").distinct()
    known = nodes.join(by_hash(ids), "id", "left_semi").select("id").distinct()
    whole = known.unionByName(ids.join(by_hash(known), "id", "left_anti"))
    sound = edges.join(by_hash(ids.select(F.col("id").alias("src"))), "src", "left_semi").join(by_hash(ids.select(F.col("id").alias("dst"))), "dst", "left_semi")
    reached = sound.where(F.col("kind").isin(inbound)).select(F.col("dst").alias("id")).distinct()
    return whole, sound, whole.join(by_hash(reached), "id", "left_anti")


def dangling(references: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return references.join(known, keys, "left_anti")
