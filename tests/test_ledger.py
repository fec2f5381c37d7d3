"""The ledger of calls: nothing is asked twice, also after a killed run, and limits hold over all tasks."""

import os
import time

import pytest

from corpusgraph.operators import ledger


def model(log, fail=(), pause=0.0, die=()):
    """A model that writes down when it is called, in a folder that all tasks see."""

    def call(name, schema, prompt):
        began = time.time()
        with open(f"{log}/{prompt}-{began}-{os.getpid()}", "w"):
            pass
        time.sleep(pause)
        if prompt in fail:
            raise ValueError("no such thing")
        if prompt in die:
            os._exit(1)
        return f"{name}:{prompt}", len(prompt), 1

    return call


def requests(spark, n, extra=()):
    rows = [("m", None, f"p{i}", i) for i in range(n)] + list(extra)
    return spark.createDataFrame(rows, "model string, schema string, prompt string, answer int")


def calls(log):
    return sorted((float(f.split("-")[1]), f.split("-")[0]) for f in os.listdir(log))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def test_nothing_is_asked_twice(spark, tmp_path, log):
    at = str(tmp_path / "ledger")
    twice = [("m", None, "p1", 7), ("other", "s", "p1", 8)]
    got = {(r["model"], r["prompt"]): (r["answer"], r["tokens_in"], r["error"]) for r in ledger.asked(spark, at, requests(spark, 6, twice), model(log, fail=["p3"]), at_once=3).collect()}
    assert got[("m", "p1")] == ("m:p1", 2, None) and got[("other", "p1")][0] == "other:p1" and got[("m", "p3")] == (None, None, "no such thing")
    assert len(calls(log)) == 7 and len(got) == 7
    assert ledger.compact(spark, at) == 6 and ledger.compact(spark, at) == 0
    again = ledger.asked(spark, at, requests(spark, 8), model(log), at_once=2).collect()
    assert sorted(p for _, p in calls(log)[7:]) == ["p3", "p6", "p7"] and all(r["answer"] == f"m:{r['prompt']}" and r["error"] is None for r in again) and len(again) == 8
    assert ledger.asked(spark, at, requests(spark, 0), model(log)).collect() == []


def test_a_killed_run_repeats_no_finished_call(spark, tmp_path, log):
    at = str(tmp_path / "ledger")
    with pytest.raises(Exception):
        ledger.asked(spark, at, requests(spark, 12), model(log, die=["p5"]), at_once=2)
    before = calls(log)
    done = {r["answer"].partition(":")[2] for r in ledger.known(spark, at).collect()}
    assert done and "p5" not in done and all(sum(p == d for _, p in before) == 1 for d in done)
    assert len(ledger.asked(spark, at, requests(spark, 12), model(log), at_once=2).where("answer IS NOT NULL").collect()) == 12
    after = [p for _, p in calls(log)[len(before) :]]
    assert not done & set(after) and len(after) == 12 - len(done)


def test_limits_over_all_tasks(spark, tmp_path, log):
    ledger.asked(spark, str(tmp_path / "a"), requests(spark, 12), model(log, pause=0.3), at_once=3)
    when = [t for t, _ in calls(log)]
    assert max(sum(t <= x < t + 0.3 for x in when) for t in when) <= 3
    ledger.asked(spark, str(tmp_path / "b"), requests(spark, 12), model(log), at_once=2, per_minute=240)
    when = [t for t, _ in calls(log)][12:]
    assert len(when) == 12 and max(when) - min(when) >= (12 - 2 * 2) / 4 * 0.9  # 4 a second, each task's first at once


def test_a_token_bucket_by_its_clock():
    now, slept = [0.0], []
    b = ledger.Bucket(60, 2, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(5):
        b.take()
    assert now[0] == pytest.approx(3) and len(slept) == 3
    now[0] += 100
    b.take(), b.take()
    assert now[0] == pytest.approx(103)
