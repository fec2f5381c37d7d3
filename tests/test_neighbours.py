"""Exact search of many queries against a plain version, and how much of it is proved away."""

import numpy as np
import pytest

from corpusgraph.operators import neighbours as nb


def plain(points, queries, k):
    out = {}
    for q, v, lanes, want in queries:
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        own = {p[2] for p in points if ok(p[1])} if lanes is None else set(lanes)
        for lane in own:
            hits = []
            for key, x, label, field in points:
                if label == lane and ok(x) and (want is None or field in set(want) - {None}):
                    a, b = np.array(x, float), np.array(v, float)
                    hits.append((-round(float(a / np.sqrt(a @ a) @ (b / np.sqrt(b @ b))), 6), key))
            out |= {(q, lane, r + 1, key): -s for r, (s, key) in enumerate(sorted(hits)[:k])}
    return out


def ok(x):
    return bool(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)


@pytest.mark.parametrize("pivots, blocks", [(1, 2048), (7, 5)])
def test_each_query_gets_its_best(spark, monkeypatch, pivots, blocks):
    monkeypatch.setattr(nb, "BLOCK_POINTS", blocks)
    monkeypatch.setattr(nb, "BLOCK_QUERIES", blocks)
    rng = np.random.default_rng(pivots)
    v = rng.normal(size=(150, 6))
    v[40:70] = v[40]  # ties
    points = [(i, v[i].tolist(), [None, "a", "b"][i % 3], [None, "x", "y"][i % 7 % 3]) for i in range(150)]
    points += [(900, None, "a", "x"), (901, [0.0] * 6, "a", "x"), (902, [float("nan")] * 6, "a", "x"), (903, [None] * 6, "a", "x"), (904, [], "a", "x")]
    queries = [(i, v[i * 3].tolist(), [None, ["a"], ["a", "b", "zz"], [None, "b"]][i % 4], [None, ["x"], ["y", None, "q"], []][i % 5 % 4]) for i in range(24)] + [(99, None, None, None), (98, [0.0] * 6, None, None)]
    p = spark.createDataFrame(points, "id long, embedding array<double>, lane string, kind string")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>, lanes array<string>, want_kind array<string>")
    best, counts = nb.top_of_lanes(p, q, "id", 4, fields=["kind"], pivots=pivots)
    got = {(r["query_id"], r["lane"], r["rank"], r["id"]): round(r["score"], 6) for r in best.collect()}
    assert got == plain(points, queries, 4)
    assert all(r["scored"] <= 50 for r in counts.collect())


def test_clusters_are_proved_away(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 4
    v = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    p = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "id long, embedding array<double>, lane string")
    q = p.where("id % 40 = 0").selectExpr("id AS query_id", "embedding", "cast(null AS array<string>) AS lanes")
    best, counts = nb.top_of_lanes(p, q, "id", 5, pivots=120)
    u = v / np.sqrt((v * v).sum(1))[:, None]
    for r in best.collect():
        want = sorted((-round(s, 9), i) for i, s in enumerate(u @ u[r["query_id"]]))[: 5]
        assert want[r["rank"] - 1][1] == r["id"]
    n = [r["scored"] for r in counts.collect()]
    assert len(n) == 100 and sum(n) < 0.2 * 100 * 4000


def test_nothing_to_search(spark):
    p = spark.createDataFrame([], "id long, embedding array<double>, lane string")
    q = spark.createDataFrame([(1, [1.0], None)], "query_id long, embedding array<double>, lanes array<string>")
    assert nb.top_of_lanes(p, q, "id", 3)[0].collect() == []


def test_a_visit_is_a_row_for_each_block_not_each_cell(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32))  # without clusters, so no cell is excluded
    p = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "id long, embedding array<double>, lane string")
    c = nb.cells(p, "id", "embedding", "lane", most=100)
    asked = p.where("id < 50").selectExpr("id AS query_id", "lane", "embedding AS _q")
    assert nb.visits(asked, c, 5, "query_id", None).count() <= 50
    floors = asked.selectExpr("query_id", "lane", "cast(-1 AS double) AS floor")
    assert nb.visits(asked, c, 5, "query_id", floors).count() <= 50
