"""Collections in buckets: what a change rewrites, who wins, what is read."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import buckets, sync

POINTS = "point_id string, file_path string, n int"


def made(spark, at, *rows, n=16):
    buckets.create(spark, at, POINTS, "point_id", "file_path", n)
    return buckets.change(spark, at, spark.createDataFrame(list(rows), POINTS))


def held(spark, at, **how):
    return sorted(map(tuple, buckets.current(spark, at, **how).collect()), key=repr)


def test_one_file_of_many_rewrites_one_bucket(spark, tmp_path):
    at = str(tmp_path / "c")
    assert buckets.current(spark, at) is None and buckets.create(spark, at, POINTS, "point_id", "file_path", 64)
    assert not buckets.create(spark, at, POINTS, "point_id") and held(spark, at) == []
    many = spark.range(100_000).select(F.concat(F.lit("p"), F.col("id")).alias("point_id"), F.concat(F.lit("f"), F.col("id")).alias("file_path"), F.col("id").cast("int").alias("n"))
    assert buckets.change(spark, at, many)[2:] == (100_000, 0)
    before = buckets.version(spark, at)
    done = buckets.change(spark, at, spark.createDataFrame([("p7", "f7", -1), ("new", "f7", -2)], POINTS))
    assert len(done.rewritten) == 1 and done[2:] == (2, 1)
    after = buckets.version(spark, at)
    assert {b for b in before.files if before.files[b] != after.files[b]} == set(done.rewritten)
    assert buckets.current(spark, at).count() == 100_001 and sorted(r["n"] for r in buckets.found(spark, at, "f7").collect()) == [-2, -1]
    assert {r["bucket"] for r in buckets.manifests(spark, at).where("version = 3 AND written = 3").collect()} == set(done.rewritten)


def test_the_last_row_of_a_key_wins_and_nulls_are_keys(spark, tmp_path):
    at = str(tmp_path / "c")
    made(spark, at, ("a", "f", 1), ("b", "g", 1), (None, None, 1), ("c", None, 5))
    done = buckets.change(spark, at, spark.createDataFrame([("a", "f", 9, 1), ("a", "f", 2, 2), (None, None, 3, 1)], POINTS + ", at int").select("point_id", "file_path", "n", "at"), order=["at"])
    assert held(spark, at) == sorted([("a", "f", 2), ("b", "g", 1), (None, None, 3), ("c", None, 5)], key=repr) and done[2:] == (2, 2)
    done = buckets.change(spark, at, files=spark.createDataFrame([(None,), ("nowhere",)], "file_path string"), keys=spark.createDataFrame([("b", "g"), ("b", "f")], "point_id string, file_path string"))
    assert held(spark, at) == [("a", "f", 2)] and done[2:] == (0, 3)
    assert held(spark, at, number=2) == sorted([("a", "f", 1), ("b", "g", 1), (None, None, 1), ("c", None, 5)], key=repr)


def test_of_two_writers_one_wins(spark, tmp_path):
    at = str(tmp_path / "c")
    made(spark, at, ("a", "f", 1))
    row = lambda n: spark.createDataFrame([("a", "f", n)], POINTS)
    assert buckets.change(spark, at, row(2), parent=2).number == 3
    with pytest.raises(buckets.Conflict):
        buckets.change(spark, at, row(3), parent=2)
    assert held(spark, at) == [("a", "f", 2)]
    assert buckets.change(spark, at, row(4), parent=2, tries=2).number == 4 and held(spark, at) == [("a", "f", 4)]
    assert not list(tmp_path.glob("c/manifest/.[0-9a-f]*")) and not list(tmp_path.glob("c/batch/*"))


def test_unlisted_files_are_not_read_and_old_ones_go(spark, tmp_path):
    at = str(tmp_path / "c")
    made(spark, at, ("a", "f", 1), ("b", "g", 1))
    (tmp_path / "c" / "data" / "3-lost" / "_bucket=1").mkdir(parents=True)
    (tmp_path / "c" / "data" / "3-lost" / "_bucket=1" / "x.parquet").write_text("half a file")
    reader = buckets.current(spark, at)
    buckets.change(spark, at, spark.createDataFrame([("a", "f", 2)], POINTS))
    assert buckets.vacuum(spark, at, 2) == [] and sorted(r["n"] for r in reader.collect()) == [1, 1]
    assert len(buckets.vacuum(spark, at, 1)) == 1 and buckets.versions(spark, at) == [3]
    assert held(spark, at) == [("a", "f", 2), ("b", "g", 1)] and (tmp_path / "c" / "data" / "3-lost").exists()


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "TASK_ROWS", 10)
    at = str(tmp_path / "c")
    made(spark, at, *[(f"p{i}", "one", i) for i in range(95)], n=4)
    buckets.change(spark, at, spark.createDataFrame([("p0", "one", -1)], POINTS))
    (names, rows, by), = buckets.version(spark, at).files.values()
    assert rows == 95 and by == 3 and len(names) > 1 and sum(r[2] for r in held(spark, at)) == sum(range(95)) - 1


def test_null_digests_and_keys_in_a_difference(spark):
    d = spark.createDataFrame([("a", None), ("b", "1"), ("c", None), (None, "1")], "p string, h string")
    s = spark.createDataFrame([("a", None), ("b", None), ("e", None), (None, "2")], "p string, h string")
    assert {r["p"]: r["op"] for r in sync.diff(d, s, "p", "h").collect()} == {"a": "keep", "b": "update", "c": "add", "e": "delete", None: "update"}
    t = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    batch = spark.createDataFrame([("a", 7), ("a", 5), (None, 8)], "k string, n int")
    assert sorted(map(tuple, sync.upsert(t, batch, "k").collect()), key=repr) == sorted([("a", 7), (None, 8), ("b", 3)], key=repr)
    assert [r["k"] for r in sync.delete(t, batch, "k").collect()] == ["b"]
