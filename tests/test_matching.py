"""Many strings in texts, many wish lists over bitmaps, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph import plans
from corpusgraph.operators import enrich
from corpusgraph.functions import matcher, text
from corpusgraph.operators import bitmaps


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghé "])
def test_strings_in_texts(letters):
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [word(rng.randint(0, 400)) for _ in range(60)] + ["", "é"]
    strings = [word(rng.choice([1, 2, 3, 5, 8, 30, 63, 64, 65, 130, 300])) for _ in range(60)]
    strings += [t[10 : 10 + rng.choice([4, 70, 129, 200])] for t in texts[:30]] + [texts[3], "", texts[5] + "x"]
    got = matcher.Matcher(strings).found([t.encode() for t in texts])
    assert got == [[i for i, s in enumerate(strings) if s in t] for t in texts]


def test_strings_of_a_table_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matcher, "BLOCK_BYTES", 60)
    strings = [(i, s) for i, s in enumerate(["water", "house", "the", "nothing at all here", "é", "a house by the water", "zz", None])]
    docs = [(1, "a house by the water"), (2, ""), (3, None), (4, "café"), (4, "café")]
    d, s = spark.createDataFrame(docs, "doc_id long, body string"), spark.createDataFrame(strings, "id long, s string")
    got = sorted(map(tuple, matcher.match_table(d, "body", s, "id", "s").collect()))
    assert got == sorted((i, k) for i, t in docs for k, x in strings if t is not None and x is not None and x in t)
    assert matcher.match_table(d, "body", s.limit(0), "id", "s").collect() == []
    with pytest.raises(ValueError, match="match_table"):
        matcher.matched(F.col("body"), ["x" * 100])


def test_names_in_texts_by_either_way(spark):
    names = [f"@x/p{i}" for i in range(30)]
    df = spark.createDataFrame([("uses @x/p1 and @x/p29",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.contained(F.col("t"), names)).collect()]
    assert got == [r[0] for r in df.select(text.contained(F.col("t"), names, few=99)).collect()] or got[2] is None
    assert got[0] == ["@x/p1", "@x/p2", "@x/p29"] and got[1] == []


def test_wish_lists_over_bitmaps(spark):
    rng = random.Random(4)
    nodes = [-70_000, -32_768, -1, 0, 1, 2, 32_767, 32_768, 32_769, 99_999, 5_000_000_000]
    edges = [(rng.choice(nodes), rng.choice("abcde")) for _ in range(60)] + [(None, "a"), (1, None)]
    wishes = [(n, rng.randint(0, 2), rng.choice("abcdef")) for n in range(12) for _ in range(rng.randint(1, 5))] + [(None, 0, "a"), (3, None, "a"), (4, 0, None)]
    e = spark.createDataFrame(edges, "src long, dst string")
    w = spark.createDataFrame(wishes, "list int, any int, feature string")
    has = {(s, d) for s, d in edges if s is not None and d}
    want = set()
    for n in range(12):
        groups = {}
        for x, g, f in wishes:
            if x == n and g is not None and f:
                groups.setdefault(g, set()).add(f)
        want |= {(n, s) for s in nodes if groups and all(any((s, f) in has for f in fs) for fs in groups.values())}
    found = bitmaps.divided(bitmaps.index(e), w)
    assert {tuple(r) for r in bitmaps.members(found).collect()} == want
    assert {tuple(r) for r in bitmaps.sizes(found).collect()} == {(n, sum(x == n for x, _ in want)) for n, _ in want}
    every = bitmaps.divided(bitmaps.index(e), w.drop("any"))  # each wish must hold
    one = {n: {f for x, _, f in wishes if x == n and f} for n in range(12)}
    assert {tuple(r) for r in bitmaps.members(every).collect()} == {(n, s) for n, fs in one.items() for s in nodes if fs and all((s, f) in has for f in fs)}


def test_equal_lists_are_answered_once(spark):
    e = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)] + [(i, "c") for i in range(5)], "src long, dst string")
    w = spark.createDataFrame([(n, k, f) for n in range(40) for k, f in ((0, "a"), (0, "b"), (1 + n % 2, "c"))] + [(99, 0, "zz")], "list int, any int, feature string")
    index = bitmaps.index(e)
    assert bitmaps.divided_kinds(index, bitmaps.kinds(w)).count() == 2  # one list and its two ranges of nodes, 0 and the rest
    assert {tuple(r) for r in bitmaps.list_sizes(index, w).collect()} == {(n, 5) for n in range(40)}
    assert {tuple(r) for r in bitmaps.list_members(index, w).collect()} == {(n, i) for n in range(40) for i in range(5)}


def test_made_files_are_dealt_to_all_cores_and_read_in_one_pass(spark):
    for name in ("unified_points", "example_points"):
        rows = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert plan.count("ArrowEvalPython") == 1


def test_chunks_of_each_kind(spark):
    files = [("a/b.ts", "types", "interface A extends B { x: string }"), ("a/c.ts", "types", "const z = 1"), ("a/d.tsx", "code", ""), ("a/e.css", "style", ".k { a: b }"), ("a/f.json", "config", "{}"), ("a/g.md", "markdown", "words"), ("a/h.md", "markdown", None), ("a/i", "other", "x"), ("a/j", None, "x")]
    rows = enrich.chunks(spark.createDataFrame(files, "rel_path string, k string, content string"), F.col("k")).select("rel_path", "chunk_kind", "total_chunks", "chunk_index", "chunk.*")
    got = {r["rel_path"]: (r["chunk_kind"], r["total_chunks"], r["chunk_index"], r["text"], r["name"], r["type"], r["exports"], r["imports"], r["props"], r["fields"], r["extends"]) for r in rows.collect()}
    assert got == {
        "a/b.ts": ("types", 1, 0, "interface A extends B { x: string }", "A", "interface", None, None, None, ["x"], ["B"]),
        "a/c.ts": ("types", 1, 0, "const z = 1", "z", "utility", [], [], [], None, None),
        "a/d.tsx": ("code", 1, 0, "", "d", "module", [], [], [], None, None),
        "a/e.css": ("style", 1, 0, ".k { a: b }", ".k", "style", None, None, None, None, None),
        "a/f.json": ("config", 1, 0, "{}", "f", "json_config", None, None, None, None, None),
        "a/g.md": ("markdown", 1, 0, "words", "g", "section", None, None, None, None, None),
    }
