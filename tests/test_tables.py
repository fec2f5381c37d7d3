"""The table queries against their SQL, and the operators' corner cases."""

import uuid

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgraph import plans
from corpusgraph.functions import chunking, ids, indented, modules, syntax, text
from corpusgraph.operators import aggregate, graph, search, sync

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_sql_agrees(spark, con, name):
    got, want = plans.QUERIES[name](spark, AT).toPandas(), con.execute(plans.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False)


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*columns).first()


def test_point_ids_are_uuid5(spark):
    names = ["a__chunk_0", "b", "x/ü__chunk_12"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.point_id(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert got[0] == "a7ceb03d-3609-538c-82ab-547e1ea9cd96"


def test_sizes_names_and_levels(spark):
    x = spark.createDataFrame([("",), ("abc",), ("abcdefgh",)], "t string").select(text.approx_tokens(F.col("t")))
    assert [r[0] for r in x.collect()] == [1, 1, 2]
    assert one(spark, text.module_name(F.col("h")), h="8. Material Issue With Job")[0] == "Material Issue With Job"
    levels = spark.createDataFrame([("8. A",), ("8.1 A",), ("3.2.4 A",), ("A",)], "h string").select(text.numbered_level(F.col("h")))
    assert [r[0] for r in levels.collect()] == [2, 3, 4, None]


def test_quoting(spark):
    values = ["true", "007", "-x", "plain", "", " a", "a,b", 'q"', "1.5", "True", "1x"]
    assert [indented.string(v) for v in values] == ['"true"', '"007"', '"-x"', "plain", '""', '" a"', '"a,b"', '"q\\""', '"1.5"', "True", "1x"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.quoted(F.col("v"))).collect()]
    assert got == [indented.string(v) for v in values]


def test_filters_and_intent(spark):
    assert search.build_filter({}) is None and search.build_filter({"a": None, "b": {}}) is None
    df = spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int")
    assert search.filtered(df, {"a": ["x", "z"], "b": 1}).count() == 1
    assert search.filtered(df, {"a": "x", "b": 2}, ["a"]).count() == 1
    assert search.classify_intent("how to filter") == {"code": 1.0, "config": 0.9, "doc": 1.2}
    assert search.classify_intent("FooBar hook")["code"] == 1.1 and search.classify_intent("an enum")["config"] == 1.2
    assert search.classify_intent("zzz") == {"code": 1.0, "config": 0.9, "doc": 0.7}
    assert search.classify_intent("how to set the config")["doc"] == 1.2


def test_division_corner_cases(spark):
    e = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f"), ("c", "f"), ("c", "f")], "src string, dst string")
    assert [r[0] for r in graph.division(e, ["f", "g"]).collect()] == ["a"]
    assert graph.division(e, []).count() == 0
    assert graph.division(e, ["f", "f", "f"], distinct=False).count() == 0
    assert sorted(r[0] for r in graph.division(e, ["f", "f"]).collect()) == ["a", "b", "c"]


def test_candidates_before_and_after_the_limit(spark):
    n = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, r int")
    pick = lambda **how: [r["id"] for r in graph.candidates(n, "id", [], F.col("r"), 2, **how).collect()]
    assert pick() == ["c", "b"] and pick(limit_first=True) == ["b", "a"]


def test_sync_diff_and_second_run(spark):
    d = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, h string")
    s = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "2")], "p string, h string")
    ops = {r["p"]: r["op"] for r in sync.diff(d, s, "p", "h").collect()}
    assert ops == {"a": "add", "b": "keep", "c": "update", "d": "delete"}
    assert {r["op"] for r in sync.diff(d, s, "p", "h", full_sync=True).collect()} == {"add"}
    after = sync.upsert(sync.delete(s, sync.orphans(s, d, "p"), "p"), d, "p")
    assert {r["op"] for r in sync.diff(d, after, "p", "h").collect()} == {"keep"}


def test_renamed_file_makes_its_folder_dirty(spark):
    d = spark.createDataFrame([("f", "a", "1"), ("g", "x", "2")], "f string, p string, h string")
    s = spark.createDataFrame([("f", "b", "1"), ("g", "x", "2"), ("gone", "y", "3")], "f string, p string, h string")
    assert {r["f"]: r["dirty"] for r in sync.dirty_folders(d, s, "f", "p", "h").collect()} == {"f": True, "g": False}


def test_merge_and_split():
    small, large = "a" * 400, "b" * 900
    assert syntax.merged([(small, "n0", "t"), (large, "n1", "t"), (small, "n2", "t")], 200) == [(f"{small}\n\n{large}", "n1", "t"), (small, "n2", "t")]
    para = "c" * 2000
    assert syntax.divided("\n\n".join([para, para, para]), 800) == [para, para, para]
    assert syntax.divided("d" * 9000, 800) == ["d" * 9000]


def test_markdown_sections(spark):
    t = "---\nx: 1\n---\nbefore\n# A\na\n## B\nb\n### C\nc\n## D\nd\n# E\ne"
    got = chunking.markdown_sections(spark.createDataFrame([(1, t), (2, "no heading\n#hash")], "k int, t string"), "k", "t").orderBy("k", "pos").collect()
    assert [r["path"] for r in got] == ["A", "A > B", "A > B > C", "A > D", "E", ""]
    assert got[1]["text"] == "## B\nb" and got[2]["parent"] == "B" and got[5]["text"] == "no heading\n#hash"


def test_source_files(spark):
    src = "import { A, type B } from './x'\nimport React from \"react\"\nimport './side.css'\nexport const one = 1\nexport async function two() {}\nexport { three as four, five }\n"
    r = one(spark, modules.imports(F.col("s")).alias("i"), modules.exports(F.col("s")).alias("e"), modules.scoped_imports(F.lit("import { typeX, type Y } from '@a/b'"), "@a/", strip_letters=True).alias("c"), s=src)
    assert r["i"] == ["./x", "react", "./side.css"] and r["e"] == ["one", "two", "four", "five"]
    assert r["c"]["symbols"] == ["X", "Y"]
    assert one(spark, modules.candidate_paths(F.lit("src/a"), F.lit("../b/./c")))[0] == ["src/b/c.ts", "src/b/c.tsx", "src/b/c.d.ts", "src/b/c/index.ts", "src/b/c/index.tsx"]


def test_an_import_takes_the_first_file_that_it_may_name(spark):
    from corpusgraph.operators import loads

    paths = ["s/a.ts", "s/a.tsx", "s/b.d.ts", "s/c/index.ts", "s/c/index.tsx", "s/c.tsx", "s/d/index.tsx", "s/e.d.d.ts", "index.ts", "s/index.ts", "x.js"]
    names = ["./a", "./b", "./b.d", "./c", "./c/index", "./d", "./d/", "./e.d", "./e", ".", "..", "../s", "../s/./a", "../index", "./none", "../x.js", "lib"]
    files = spark.createDataFrame([(p, "p", p) for p in paths], "path string, package_name string, rel_path string")
    found = spark.createDataFrame([("f", "s/q.ts", "p", "import", 0, n, []) for n in names], "file string, path string, package_name string, kind string, pos int, specifier string, names array<string>")
    got = {r["specifier"]: r["target"] for r in loads.resolved(found, files).collect()}
    asked = {n: one(spark, modules.candidate_paths(F.lit("s"), F.lit(n)))[0] for n in names if n.startswith(".")}
    assert got == {n: f"p::{hit}" for n, c in asked.items() if (hit := next((x for x in c if x in paths), None))}


def test_descendants_and_latest(spark):
    h = spark.createDataFrame([(1, i, lv) for i, lv in enumerate([1, 2, 3, 2, 1])], "d int, p int, l int")
    assert [r["descendants"] for r in aggregate.descendants(h, "d", "p", "l").orderBy("p").collect()] == [3, 1, 0, 0, 0]
    log = spark.createDataFrame([("j", "pending", None, 1), ("j", "completed", "r", 2), ("k", "failed", "no", 1)], "j string, s string, r string, t int")
    got = {r["j"]: (r["s"], r["r"]) for r in aggregate.job_view(log, "j", [F.col("t")], "s", "r").collect()}
    assert got == {"j": ("completed", "r"), "k": ("failed", None)}


def test_module_candidates_of_crowded_and_single_levels(spark):
    docs = {1: [1] + [2, 3] * 3, 2: [1, 2, 3], 3: [1] * 26, 4: [1] * 24 + [1, 2, 3, 3, 3] * 2, 5: [1] * 26 + [2, 2], 6: [1, 2, 2, 2, 2] + [1] * 25 + [2]}
    h = spark.createDataFrame([(d, i, lv) for d, levels in docs.items() for i, lv in enumerate(levels)], "d int, p int, l int")
    got = {d: [] for d in docs}
    for r in aggregate.module_candidates(h, "d", "p", "l").orderBy("d", "p").collect():
        got[r["d"]].append(r["p"])
    assert got == {1: [1, 3, 5], 2: [0, 1, 2], 3: list(range(26)), 4: [24, 29], 5: [26, 27], 6: [1, 2, 3, 4, 30]}


def test_imports_are_not_joined_by_a_broadcast(spark):
    from corpusgraph.operators import loads

    files = spark.createDataFrame([("packages/a/src/x.ts", "a", "src/x.ts", "import { y } from './y';"), ("packages/a/src/y.ts", "a", "src/y.ts", "")], "path string, package_name string, rel_path string, content string")
    plan = loads.resolved(loads.statements(files), files)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
