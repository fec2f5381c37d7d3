"""Each stage of the pipeline against a plain version, on rows with null and repeated doc_ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import common, langid, pieces, simhash, toxicity
from tests.llm.test_llm import corpus, empty, odd, plain  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def docs_of(spark, at):
    return spark.read.parquet(f"{at}/documents.parquet")


def twins(spark):
    """Rows that share a doc_id, or have none, though their texts differ in what a stage looks for."""
    docs, labels = corpus(120, 6)
    good = next(d[1] for d, x in zip(docs, labels, strict=True) if not x[2])
    bad = next(d[1] for d, x in zip(docs, labels, strict=True) if x[2])
    more = [(i, t, None, "s0", 1) for i in (5000, None) for t in (good, bad, bad, "123 !!", None, "")]
    return spark.createDataFrame([(*d, len(d[1])) for d in docs] + more, COLUMNS)


@pytest.mark.parametrize("where", ["plain", "odd", "twins"])
def test_toxicity_goes_row_by_row(spark, request, plain, where):  # noqa: F811
    docs = twins(spark) if where == "twins" else docs_of(spark, request.getfixturevalue(where))
    net = toxicity.learn(docs, spark.read.parquet(f"{plain}/labels.parquet"), F.lit(True))
    scorer = toxicity.Scorer(net)
    want = sorted((r for r in rows_of(docs) if scorer.scores([r[1] or ""])[0] < 0.5), key=str)
    assert rows_of(corpus_pipeline.toxicity_stage(spark, docs, plain)) == want
    assert len(want) < docs.count()


@pytest.mark.parametrize("where", ["plain", "odd", "twins"])
def test_language_goes_row_by_row(spark, request, where):
    docs = twins(spark) if where == "twins" else docs_of(spark, request.getfixturevalue(where))
    found = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predicted(docs.select("text"), *langid.learn(docs)).collect()}
    sure = [(r, found[r[1]]) for r in rows_of(docs) if found[r[1]][0] != "und" and found[r[1]][1] >= 0.5]
    want = sorted(((r[0], r[1], r[2] or p, r[3], r[4]) for r, (p, _) in sure), key=str)
    assert rows_of(corpus_pipeline.language_stage(spark, docs, "")) == want


@pytest.mark.parametrize("where", ["plain", "odd", "twins"])
def test_one_row_of_each_group_stays(spark, request, where):
    docs = twins(spark) if where == "twins" else docs_of(spark, request.getfixturevalue(where))
    rows = rows_of(docs)
    sets = [set(simhash.shingle_set((r[1] or "").encode(), 5).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    got = rows_of(corpus_pipeline.dedup_stage(spark, docs, ""))
    assert len(got) == len(set(group))
    place = {}
    for r, g in zip(rows, group, strict=True):
        place.setdefault(r, g)
    assert sorted({place[r] for r in got}) == sorted(set(group))
    for r in got:  # the least doc_id of its group
        ids = [x[0] for x, g in zip(rows, group, strict=True) if g == place[r] and x[0] is not None]
        assert r[0] == min(ids, default=None)


def test_near_duplicates_broadcast_nothing_by_themselves(spark, plain, monkeypatch):  # noqa: F811
    """Tables of any size meet by shuffles: dozens of small broadcasts would pile up in the driver."""
    plans, write = [], simhash.materialize

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(simhash, "materialize", spy)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", -1)
    last = simhash.similar(docs_of(spark, plain).select(F.col("doc_id").cast("string").alias("key"), "text"))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]


def test_the_driver_gives_memory_back(spark):
    common.driver_gives_back(spark)
    assert spark.range(3).count() == 3


def test_the_driver_does_give_memory_back(spark):
    """The call used to fail unseen, whatever the JVM can do."""
    can = spark._jvm.java.lang.management.ManagementFactory.getOperatingSystemMXBean().getName() == "Linux" and spark._jvm.Runtime.version().feature() >= 17
    assert common.driver_gives_back(spark) == can


def test_tokens_of_every_row(spark, odd):  # noqa: F811
    docs, model = docs_of(spark, odd), pieces.model_of(pieces.model_bytes())
    want = sorted(((r[0], None if r[1] is None else model.encode(r[1]).tolist()) for r in rows_of(docs)), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in corpus_pipeline.tokens_stage(spark, docs, "").collect()), key=str) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, plain, odd, empty):  # noqa: F811
    for at in (plain, odd, empty):
        docs = docs_of(spark, at)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, at)
            if name != "tokens":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (at != empty)
    assert corpus_pipeline.run(spark, plain).count() > 0
