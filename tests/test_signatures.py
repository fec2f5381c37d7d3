"""Signatures of folders: which differ, and what is looked at to find out."""

from pyspark.sql import functions as F

from corpusgraph.operators import signatures


def tree(spark, rows):
    return spark.createDataFrame(rows, "file_path string, file_id string")


def compared(spark, a, b):
    return signatures.differing(spark, *[signatures.stored(spark, signatures.signatures(x)) for x in (a, b)])


def test_only_differing_subtrees_are_looked_at(spark):
    rows = [(f"a{i}/b{j}/c{k}/f{n}", f"h{n}") for i in range(6) for j in range(4) for k in range(3) for n in range(3)]
    changed = [(p, "other" if p == "a2/b1/c0/f1" else h) for p, h in rows]
    found, read = compared(spark, tree(spark, rows), tree(spark, changed))
    assert {tuple(r) for r in found.collect()} == {("", False), ("a2", False), ("a2/b1", False), ("a2/b1/c0", True)}
    assert read == 1 + 6 + 4 + 3  # of 1 + 6 + 24 + 72 folders
    found, read = compared(spark, tree(spark, rows), tree(spark, rows[::-1] + rows[:5]))
    assert found.collect() == [] and read == 1


def test_new_gone_moved_and_null(spark):
    a = [("x/1", "h"), ("x/2", None), ("top", "t"), ("y/deep/1", "h"), (None, "h")]
    b = [("x/1", None), ("x/2", "h"), ("top", "t"), ("z/1", "h"), ("z/1", "h"), (None, "g")]
    found, _ = compared(spark, tree(spark, a), tree(spark, b))
    assert {tuple(r) for r in found.collect()} == {("", False), ("x", True), ("y", False), ("y/deep", True), ("z", True)}
    ops = {r["file_path"]: r["op"] for r in signatures.changed_files(tree(spark, a), tree(spark, b), found).collect()}
    assert ops == {"x/1": "update", "x/2": "update", "y/deep/1": "add", "z/1": "delete"}
    moved = signatures.signatures(tree(spark, [("q/a", "1"), ("q/b", "2")])).where("folder = 'q'").select(*signatures.PARTS).first()
    assert moved != signatures.signatures(tree(spark, [("q/a", "2"), ("q/b", "1")])).where("folder = 'q'").select(*signatures.PARTS).first()


def test_empty_trees(spark):
    none, some = tree(spark, []), tree(spark, [("a/b", "1")])
    assert compared(spark, none, none)[0].collect() == []
    assert {r["folder"] for r in compared(spark, none, some)[0].collect()} == {"", "a"}
    assert signatures.signatures(some.select("file_path", F.lit("1").alias("file_id"), F.lit(2).alias("own"))).count() == 2
