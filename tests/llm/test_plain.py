"""Operators of corpusgraph.llm against plain versions of the same definitions, written without their code."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusgraph.llm import common, html, langid, mixing, quality, sharding, simhash, toxicity, transport
from tests.llm.test_llm import corpus, odd, plain, write  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(at, name="documents"):
    return pq.read_table(f"{at}/{name}.parquet").to_pylist()


# sharding

@pytest.mark.parametrize("where", ["plain", "odd"])
def test_shards_hold_the_law_and_the_columns(spark, request, where):
    at = request.getfixturevalue(where)
    got, docs = sharding.op1_reshard_flow(spark, at).collect(), table(at)
    of = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(((d["doc_id"], *of(d["text"])) for d in docs), key=key)
    load = {k: sum(r["size"] for r in got if r["shard"] == k) for k in range(8)}
    assert max(load.values()) - min(load.values()) <= 4 * max(r["size"] for r in got)
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_one_doc_id_fills_all_shards_evenly(spark, tmp_path):
    at = write(tmp_path, [(7, "same", "en", "s")] * 900 + [(None, None, None, None)] * 900)
    load = {}
    for r in sharding.op1_reshard_flow(spark, at).collect():
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 20


# main text

ARTICLE = "<article><h1>Title here</h1><p>This is the first paragraph of a story, with words. It goes on.</p><p>And here is another one, just as long as it was before.</p></article>"
TEXT = "Title here\n\nThis is the first paragraph of a story, with words. It goes on.\n\nAnd here is another one, just as long as it was before."


@pytest.mark.parametrize("before, after", [
    ("<body><form><select><option>A<option>B</select></form>", ""),
    ("<body><form><button>x</form>", ""),
    ("<html><head><title>x</title><meta a=b>", ""),
    ("<head><noscript><p>no script</p></noscript></head><body>", "<svg/>"),
    ("<body><form method=post><div class=header>Site</div><nav><a href=1>Home</a></nav>", "<footer>© us</footer></form>"),
    ("<form>Search<input></form>", "<form class=search><label>Your mail</label><input><button>Go</button></form>"),
])
def test_articles_among_controls_and_optional_tags(before, after):
    assert html.main_text(before + ARTICLE + after, html.trained()) == TEXT


@pytest.mark.parametrize("page", ['<a href="x ' * 80_000, "<i>x</p>" * 100_000, "<a b" * 200_000, "<a b='\">" * 100_000, "<p><table><td>" + "<i><div></div>" * 60_000, "<!--" * 200_000, "<div>" * 150_000, "<a \"'>" * 150_000])
def test_hostile_pages_take_time_in_proportion(page):
    import time

    began = time.thread_time()
    html.tree(page)
    assert time.thread_time() - began < 5


# language

def plain_ngrams(text):
    letters = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in (c if c.isalpha() else " " for c in text)]
    letters = [c for i, c in enumerate(letters) if i == 0 or c != 32 or letters[i - 1] != 32]
    out, full = [], 0xFFFFFFFF
    finish = lambda h: ((h ^ h >> 15) * 0x27D4EB2F & full) >> 16
    for i, c in enumerate(letters):
        h = c * 0x9E3779B1 & full
        if c != 32:
            out.append(finish(h))
        for k, m in ((1, 0x85EBCA77), (2, 0xC2B2AE3D)):
            if i + k >= len(letters):
                break
            h = (h ^ letters[i + k]) * m & full
            out.append(finish(h))
    return out


def test_languages_by_a_plain_sum_of_logarithms(spark, plain):  # noqa: F811
    docs = table(plain)
    learned = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2]
    counts = {}
    for d in learned:  # fewer rows of a language than the sample's bound: all are learned from
        counts.setdefault(d["lang"], {})
        for g in plain_ngrams(d["text"]):
            counts[d["lang"]][g] = counts[d["lang"]].get(g, 0) + 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    got = {r["doc_id"]: r for r in langid.op3_naive_bayes_langid(spark, plain).collect()}
    for d in docs:
        s = {x: sum(math.log((counts[x].get(g, 0) + 0.5) / total[x]) for g in plain_ngrams(d["text"])) for x in langs}
        best = max(langs, key=s.get)
        assert got[d["doc_id"]]["lang_pred"] == best
        assert got[d["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), abs=1e-3)


# near duplicates

def test_parities_never_hide_a_link():
    rng = np.random.default_rng(4)
    for size in (1, 4, 30, 200, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(-(2**63), 2**63 - 1, size // 10)]))
            d = sum((x ^ y).bit_count() for x, y in zip(np.array(simhash.parities(a)).view(np.uint64).tolist(), np.array(simhash.parities(b)).view(np.uint64).tolist(), strict=True))
            assert d <= len(set(a.tolist()) ^ set(b.tolist()))


def test_blocks_of_bits_cover_the_word(spark):
    """Every pair of fingerprints within the radius shares a shard, however many blocks make a key."""
    rng = random.Random(2)
    for agree in (1, 2, 3):
        for _ in range(40):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), 3):
                b ^= 1 << k
            cut = [64 * k // (3 + agree) for k in range(4 + agree)]
            same = [k for k in range(3 + agree) if not (a ^ b) >> cut[k] & (1 << (cut[k + 1] - cut[k])) - 1]
            assert len(same) >= agree


# mixing

def plain_mix(rows):
    """What rows (doc_id, text, source) are taken, as counts of (doc_id, text, source)."""
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    target, open_, left = {}, list(sources), sum(total.values())
    while open_:  # give by weight; who is above its cap gets the cap, and the rest is given anew
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * total[s]]
        for s in over or open_:
            target[s] = 3 * total[s] if over else share * weight[s]
            left -= 3 * total[s] if over else 0
        open_ = [s for s in open_ if over and s not in over]
    return size, target, total


@pytest.mark.parametrize("where", ["plain", "odd"])
def test_mixed_rows_near_their_targets(spark, request, where):
    docs = spark.read.parquet(f"{request.getfixturevalue(where)}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    size, target, total = plain_mix(rows)
    got = [(r["doc_id"], r["text"], r["source"]) for r in mixing.mixed_documents(docs).collect()]
    assert set(got) <= set(rows)
    for s, t in target.items():
        mine = [r for r in got if r[2] == s]
        assert abs(sum(size(r[1]) for r in mine) - t) <= max(size(r[1]) for r in rows if r[2] == s) / 2 + 1
        epochs = int(t) // total[s] if total[s] else 0
        for r in {r for r in rows if r[2] == s}:
            assert epochs * rows.count(r) <= mine.count(r) <= (epochs + 1) * rows.count(r)


def test_mixed_rows_without_a_doc_id_stay_single(spark):
    rows = [(None, f"one two three {i}", "en", "s", 1) for i in range(10)] + [(i, f"four five six {i}", "en", "s", 1) for i in range(10)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r["text"] for r in got) == sorted(r[1] for r in rows)


def test_many_copies_of_a_row(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "COPIES", 7)
    at = write(tmp_path, [(1, "a b c", "en", "s")] * 100 + [(2, "d e", "en", "t")] * 3)
    got = mixing.op5_mix_sources(spark, at).collect()
    assert len(got) == 103
    for s, n in ((1, 3), (2, 2)):
        mine = [r for r in got if r["doc_id"] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"]) and all(r["taken"] <= 3 * n for r in mine)


# media

@pytest.mark.parametrize("where", ["plain", "odd"])
def test_media_columns_from_the_texts_bytes(spark, request, where):
    at = request.getfixturevalue(where)
    want = []
    for d in table(at):
        b = (d["text"] or "").encode()
        payload = b + bytes(-len(b) % 64 or 64 * (not b))
        stored = transport.mux(payload)
        want.append((d["doc_id"], len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    got = [tuple(r)[:7] for r in transport.op7_transport_streams(spark, at).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# toxicity

def small_net():
    net = toxicity.Net(1)
    words = ["vile", "good", "word", "x"]
    win = np.full((3, toxicity.WINDOW), 4)
    win[0, :3], win[1, :2], win[2, :1] = [0, 1, 2], [2, 3], [1]
    return net, toxicity.word_buckets(words), *toxicity.grams(words), win, np.array([1, 0, 0])


def plain_forward(net, e, window):
    """The logit of one window of word inputs, step by step."""
    p, H = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    states = []
    for k in (0, 1):
        h, seen = np.zeros(H), []
        for x in window if k == 0 else window[::-1]:
            g, hu = e[x] @ p["wx"][k] + p["bx"][k], h @ p["u"][k]
            z, r = sig(g[:H] + hu[:H]), sig(g[H : 2 * H] + hu[H : 2 * H])
            c = np.tanh(g[2 * H :] + r * hu[2 * H :])
            h = z * h + (1 - z) * c
            seen.append(h)
        states.append(seen if k == 0 else seen[::-1])
    rows = [np.concatenate([a, b, e[x]]) for a, b, x in zip(*states, window, strict=True)]
    s = np.array([np.tanh(r @ p["a"] + p["ba"]) @ p["v"] for r in rows])
    w = np.exp(s - s.max())
    return float((w / w.sum()) @ np.stack(rows) @ p["w"] + p["b"][0])


def test_the_network_step_by_step():
    net, bucket, ids, own, win, _ = small_net()
    e = net.inputs(bucket, ids, own)[0]
    got = net.forward(net.project(e), win, 4)
    for g, w in zip(got, win, strict=True):
        assert g == pytest.approx(plain_forward(net, e.astype(float), [x for x in w if x != 4]), abs=1e-4)


def test_gradients_by_differences():
    net, bucket, ids, own, win, y = small_net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        out = net.forward(net.project(net.inputs(bucket, ids, own)[0].astype(np.float64)), win, 4).astype(float)
        return float(np.mean(np.logaddexp(0, out) - y * out))

    g, de, dg = net.gradients(bucket, ids, own, win, y)
    rng = np.random.default_rng(0)
    checks = [(net.p[k], g[k]) for k in net.p]
    for values, slopes in checks:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in values.shape)
            was, step = values[at], 1e-2
            values[at] = was + step
            up = loss()
            values[at] = was - step
            down = loss()
            values[at] = was
            assert (up - down) / (2 * step) == pytest.approx(float(slopes[at]), abs=2e-4)
    for table_, rows, slopes in ((net.word, bucket, de[:, : toxicity.WIDTH]), (net.gram, ids, dg)):
        for i in range(0, len(rows), max(1, len(rows) // 4)):
            same = np.flatnonzero(rows == rows[i])
            was = table_[rows[i], 1]
            table_[rows[i], 1] = was + 1e-2
            up = loss()
            table_[rows[i], 1] = was - 1e-2
            down = loss()
            table_[rows[i], 1] = was
            assert (up - down) / 2e-2 == pytest.approx(float(slopes[same, 1].sum()), abs=2e-4)


def test_a_text_scores_as_its_worst_window():
    docs, labels = corpus(200, 3)
    net = toxicity.fit([d[1] for d in docs], [x[2] for x in labels])
    scorer = toxicity.Scorer(net)
    for d in docs[:25]:
        words = toxicity.find_words(d[1].lower())
        begins = [i for i in range(0, len(words), toxicity.STRIDE) if i == 0 or i + toxicity.STRIDE < len(words)]
        e = net.inputs(toxicity.word_buckets(words), *toxicity.grams(words))[0].astype(float)
        worst = max(plain_forward(net, e, list(range(i, min(i + toxicity.WINDOW, len(words))))) for i in begins)
        assert scorer.scores([d[1]])[0] == pytest.approx(1 / (1 + math.exp(-worst)), abs=2e-3)
    assert scorer.scores(["", " ?!"]).tolist() == [0, 0]


# quality

def test_the_risk_and_its_gradients():
    rng = np.random.default_rng(1)
    out, n, prior = rng.normal(size=9), 4, 0.3
    loss = lambda f, y: 1 / (1 + np.exp(y * f))
    plus, negative, g_plus, g_negative = quality.risk(out, n, prior)
    assert plus == pytest.approx(prior * np.mean([loss(f, 1) for f in out[:n]]))
    assert negative == pytest.approx(np.mean([loss(f, -1) for f in out[n:]]) - prior * np.mean([loss(f, -1) for f in out[:n]]))
    for i, which in itertools.product(range(9), (0, 1)):
        up, down = out.copy(), out.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (quality.risk(up, n, prior)[which] - quality.risk(down, n, prior)[which]) / 2e-5
        assert slope == pytest.approx((g_plus, g_negative)[which][i], abs=1e-7)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_the_class_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0, 1, (3000, 6)), rng.normal(2.2, 1, (3000, 6))
    n = int(2000 * share)
    found = quality.class_prior(good[:1000], np.vstack([good[1000 : 1000 + n], bad[: 2000 - n]]), rng)
    assert found == pytest.approx(share, abs=0.08)


# helpers

def test_tables_are_released(spark):
    import os

    place = lambda t: t._written_at.removeprefix("file:")
    other = common.materialize(spark.range(2))
    with common.tables_of() as own:
        a, b = common.materialize(spark.range(3)), common.materialize(spark.range(4))
        with common.tables_of() as inner:
            c = common.materialize(spark.range(5))
    after = common.materialize(spark.range(6))
    assert own == [a, b] and inner == [c]
    gone = place(a)
    common.release(*own, keep=b)
    assert not os.path.exists(gone) and all(os.path.exists(place(t)) for t in (b, c, other, after))
    gone = place(b)
    common.release(b, b, a, spark.range(2))
    assert not os.path.exists(gone)


def test_a_frequent_key_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_PARTS", 8)
    left = spark.range(400).selectExpr("CASE WHEN id < 250 THEN 7 ELSE id END AS k", "id AS v")
    right = spark.range(390).selectExpr("id AS k", "id * 2 AS w")
    got = common.spread_join(common.materialize(left), right, ["k"])
    want = left.join(right, "k")
    assert got.columns == ["k", "v", "w"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert common.spread_join(left.limit(0), right, ["k"]).count() == 0


def test_row_keys_tell_rows_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("", "ab"), ("1:", "a"), ("a", "1:")]
    keys = {r[0] for r in spark.createDataFrame(rows, "x string, y string").select(common.row_key("x", "y")).collect()}
    assert len(keys) == len(rows)
