"""Repeats inside and between texts: suffix arrays, removed substrings, phrases and runs, against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusgraph.llm import phrases, runs, substrings, suffixes
from tests.llm.test_llm import write


# suffix arrays

@pytest.mark.parametrize("letters, most", [(1, 40), (2, 60), (3, 60), (2000, 30)])
def test_suffixes_in_order_with_their_common_prefixes(letters, most):
    rng = random.Random(letters)
    for _ in range(60):
        texts = [[rng.randrange(letters) for _ in range(rng.randint(0, most))] for _ in range(rng.randint(1, 4))]
        s = np.array([x for k, t in enumerate(texts) for x in ([c + len(texts) for c in t] + [k])])
        order, rank = suffixes.suffix_array(s)
        tails = [s[i:].tolist() for i in range(len(s))]
        assert order.tolist() == sorted(range(len(s)), key=tails.__getitem__) and (order[rank] == np.arange(len(s))).all()
        shared = suffixes.common_prefixes(s, order, rank)
        for i in range(1, len(s)):
            a, b = tails[order[i - 1]], tails[order[i]]
            assert shared[i] == next(k for k in range(len(s) + 1) if a[k : k + 1] != b[k : k + 1])


def test_minima_and_next_smaller():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        x = rng.integers(0, 9, n)
        begin = rng.integers(0, n, 50)
        end = begin + 1 + rng.integers(0, n, 50) % (n - begin)
        assert suffixes.Minima(x).of(begin, end).tolist() == [x[a:b].min() for a, b in zip(begin, end, strict=True)]
        assert suffixes.next_smaller(x).tolist() == [next((j for j in range(i + 1, n) if x[j] < x[i]), n) for i in range(n)]


# runs

def plain_runs(w, least=24, periods=3):
    out, n = set(), len(w)
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            piece = w[i : j + p]
            if j + p - i >= max(least, periods * p) and not any(piece[q:] == piece[:-q] for q in range(1, p)):
                out.add((i, j + p - i, p))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_all_found():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 50))]
            if len(w) > 6 and rng.random() < 0.5:
                a, p = rng.randrange(len(w) - 5), rng.randint(1, 5)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
            texts.append(w)
        least, periods = rng.choice([2, 4, 24]), rng.choice([2, 3])
        assert runs.runs([np.array(t, np.int64) for t in texts], least, periods) == [plain_runs(t, least, periods) for t in texts]


def plain_row(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    w = (text or "").encode().split()
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    s, n, p = best[0] if best else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), s, n, p, best and 1000 * n // p or None, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def periodic(tmp_path_factory):
    rng = random.Random(8)
    words = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    docs = [(i, " \n"[i % 2].join(words(rng.randint(0, 150), 60)), "en", "s") for i in range(120)]
    for i in range(120, 160):
        base = words(rng.randint(1, 12), 4)
        docs.append((i, " ".join(words(5, 9) + base * rng.randint(2, 9) + base[: rng.randint(0, len(base))] + words(7, 9) + ["la"] * rng.randint(0, 60)), "en", "s"))
    return write(tmp_path_factory.mktemp("periodic"), docs + docs[-3:] + [(None, "x " * 40, None, None), (9, None, "en", "s"), (10, "é " * 30 + " é" * 30, "en", "s")])


def test_runs_of_whole_texts(spark, periodic):
    got = runs.op13_runs(spark, periodic)
    assert got.columns == [f.split()[0] for f in runs.SCHEMA.split(", ")]
    want = [plain_row(d["doc_id"], d["text"]) for d in pq.read_table(f"{periodic}/documents.parquet").to_pylist()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 30


def test_runs_of_a_very_long_text():
    words = [f"w{i}" for i in range(3000)] + ["a", "b"] * 40_000 + ["c"]
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    assert runs.runs([ids, ids[:0]]) == [[(3000, 80_000, 2)], []]
    assert len(runs.collapsed(words, [(3000, 80_000, 2)])) == 3003


# phrases (their SQL is run in test_llm)

def test_phrases_counted_by_hand(spark):
    docs = spark.createDataFrame(
        [("New York city. new york CITY", "en", 1), ("new york state, new york", "en", 2), (None, "en", 3), ("x\ty x\ty", None, 4), ("x y", "und", 5), ("", "de", 6), (".,;", "de", 7), ("É é É é", "fr", 8)],
        "text string, lang string, a int")
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"], r["rank"]) for r in phrases.collocations(docs, 3, 2, 5).collect()}
    # "new york" isn't covered: 100 * 2 >= 50 * 4 holds, so it is; "york city" is too; cuts of "new york city": 4, 2 and 4, 2
    assert got == {
        ("en", "new york city"): (2, 4, 2, 11, 500_000, 1),
        ("und", "x y"): (3, 3, 3, 6, 1_000_000, 1),
        ("fr", "É é"): (2, 2, 2, 4, 1_000_000, 1),
    }


def test_only_latin_capitals_are_lowered(spark):
    texts = ["ABC xyz É", "ABC", "ÄbC", "Straße AB", "ǅ A", "İ A", "Σ A", "日本 AB", "Ⓐ A", "é ñ ABC", "", "ſ A K"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(phrases.lowered(phrases.F.col("t"))).collect()]
    assert got == ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in texts]


def test_scores_of_huge_counts_are_exact(spark):
    big = 9_999_999_999_999_999
    counts = spark.createDataFrame([("en", "a b", big - 1), ("en", "a", big), ("en", "b", big - 1), ("en", "c", 3), ("en", "a c", 1)], "lang string, phrase string, a long")
    got = {r["phrase"]: r["score"] for r in phrases.scored(counts).collect()}
    assert got == {"a b": 10**6 * (big - 1) ** 2 // (big * (big - 1)), "a c": 0}


def test_a_phrase_goes_at_half_of_its_occurrences(spark):
    rows = spark.createDataFrame([("en", "a b", 20), ("en", "b c", 21), ("en", "a b c", 10), ("de", "a b", 20)], "lang string, phrase string, a long")
    assert {(r["lang"], r["phrase"]) for r in phrases.uncovered(rows).collect()} == {("en", "b c"), ("en", "a b c"), ("de", "a b")}


# substrings


@pytest.mark.parametrize("most", [1, 1 << 27])
def test_longer_phrases_are_counted_where_their_parts_are_frequent(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_BITS", most)  # 1: the smallest bitmap
    rng = random.Random(3)
    texts = [" ".join(["often", "said", "twice"] * rng.randint(0, 2) + [f"w{rng.randint(0, 4000)}" for _ in range(300)]) for _ in range(20)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    parts = spark.createDataFrame([("en", "often said"), ("en", "said twice"), ("de", "w1 w2")], "lang string, phrase string")
    rows = phrases.of_frequent_parts(phrases.word_rows(docs, 3), parts, 3).select(phrases.key_of(3)).collect()
    want = sum(t.count("often said twice") for t in texts)
    assert sum(r[0] == "often said twice\ten" for r in rows) == want and len(rows) < want + 60
    seen = {}
    for t in texts:
        w = t.split()
        for k in (1, 2, 3):
            for j in range(len(w) - k + 1):
                seen[" ".join(w[j : j + k])] = seen.get(" ".join(w[j : j + k]), 0) + 1
    got = {r["phrase"]: r["a"] for r in phrases.counted(docs, 3, 3).collect()}
    assert got == {p: a for p, a in seen.items() if a >= 3 or " " not in p}


def plain_cut(texts, width=200):
    """Of each text: bytes, removed bytes, removed runs, digest of what stays."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for k in range(len(b) - width + 1):
            seen[b[k : k + width]] = seen.get(b[k : k + width], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def sharing(seed, n):
    """Texts that share passages of about WIDTH bytes with unlike surroundings, copies, periodic texts, short ones."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdeé \n") for _ in range(k))
    shared = [noise(k) for k in (150, 180, 199, 200, 201, 260, 700)]
    texts = []
    for _ in range(n):
        t = noise(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(shared)
            t += x[rng.randint(0, 20) :] + noise(rng.randint(0, 250))
        texts.append(t)
    texts += [texts[0] * 2, texts[1], texts[1], noise(220), "ab" * 200, "ab" * 99 + "a", "ab" * 100 + "c", "x" * 1000, None, "", "y" * 199, "z" * 200, "z" * 200]
    return texts


@pytest.mark.parametrize("shard, range_", [(3000, 150_000), (8, 300)])
def test_repeated_bytes_go(spark, tmp_path, monkeypatch, shard, range_):
    monkeypatch.setattr(substrings, "SHARD", shard)  # small: pieces of an anchor are dealt over shards and their runs merged
    monkeypatch.setattr(substrings, "RANGE", range_)
    texts = sharing(shard, 120)
    at = write(tmp_path, [(i if i % 9 else None, t, "en", "s") for i, t in enumerate(texts)])
    got = substrings.op11_substrings(spark, at)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = plain_cut(texts)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i if i % 9 else None, *w)) for i, w in enumerate(want))
    assert sum(0 < w[1] < w[0] for w in want) > 40
    kept = substrings.kept_bytes(substrings.placed(spark.read.parquet(f"{at}/documents.parquet")).withColumn("kept", substrings.F.lit(1)))
    assert "source" in kept.columns and sorted(hashlib.sha256(r["kept"]).hexdigest() for r in kept.collect()) == sorted(w[3] for w in want)


@pytest.mark.parametrize("width, gram", [(200, 64), (9, 4), (5, 5)])
def test_equal_windows_have_equal_anchors(width, gram):
    rng = np.random.default_rng(width)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[1000:1600], data[2000:2400] = data[200:800], 97
    begins = np.array([0, 700, 1203, 1210, 2300])
    ends = np.append(begins[1:], 4000)
    at, windows, place, anchor = substrings.anchors(data, begins, ends, width, gram)
    owned = np.concatenate([np.arange(a, a + n) for a, n in zip(at, windows, strict=True)])
    assert owned.tolist() == [k for a, b in zip(begins, ends, strict=True) for k in range(a, b - width + 1)]
    of = {}
    for a, n, p, h in zip(at.tolist(), windows.tolist(), place.tolist(), anchor.tolist(), strict=True):
        for k in range(a, a + n):
            assert k <= p <= k + width - gram
            assert of.setdefault(data[k : k + width].tobytes(), (p - k, h)) == (p - k, h)


def test_long_texts_are_read_in_parts(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(2).choice("abc def") for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"_f": [1, 1], "_r": [0, 1], "text": [text, "é" * 300]})
    owned = lambda got: sorted({(r, a + k, h) for r, a, n, h in zip(got["_r"].tolist(), got["at"].tolist(), got["windows"].tolist(), got["anchor"].tolist(), strict=True) for k in range(n)})
    whole = owned(substrings.pieces_of(batch))
    monkeypatch.setattr(substrings, "PART", 700)
    assert owned(substrings.pieces_of(batch)) == whole and len(whole) == 3000 - 199 + 600 - 199


def test_runs_of_digests_are_merged():
    entry = np.dtype([("mark", "S32"), ("n", int)])
    rng = random.Random(3)
    for _ in range(50):
        a, b = (np.array(sorted((rng.choice("abcdef").encode(), k) for k in range(rng.randint(0, 9))), entry) for _ in range(2))
        got = substrings.merged(a, b)
        assert got["mark"].tolist() == sorted(a["mark"].tolist() + b["mark"].tolist()) and sorted(got["n"].tolist()) == sorted(a["n"].tolist() + b["n"].tolist())


def test_near_pairs_come_from_the_trees(monkeypatch):
    import numpy as np

    from corpusgraph.llm import simhash

    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, (12, simhash.DECIDING + simhash.PARITIES))
    w = base[rng.integers(0, 12, 90)]
    w[::3, 0] ^= 1 << rng.integers(0, 60, 30)  # near ones; the rest are exact or far
    task = np.sort(rng.integers(0, 4, 90))
    col = {"w": list(w), "n": rng.integers(80, 120, 90), "label": rng.integers(0, 40, 90), "id": np.arange(90), "indexed": rng.random(90) < 0.8, "asks": rng.random(90) < 0.8}
    built, old = [], simhash.Forest.__init__
    monkeypatch.setattr(simhash.Forest, "__init__", lambda self, keys, group: (built.append(len(keys)), old(self, keys, group))[1])
    for nearest in (False, True):
        for below in (False, True):
            want = {}
            for a in np.flatnonzero(col["asks"]):
                for b in np.flatnonzero(col["indexed"]):
                    sizes = sorted((col["n"][a], col["n"][b]))
                    bits = lambda x, y: sum(((i ^ j) & 2**64 - 1).bit_count() for i, j in zip(map(int, x), map(int, y), strict=True))
                    d, odd = bits(w[a][:4], w[b][:4]), bits(w[a][4:], w[b][4:])
                    if task[a] == task[b] and (col["label"][b] < col["label"][a] if below else col["label"][b] != col["label"][a]) and 5 * sizes[0] >= 4 * sizes[1] and d <= simhash.WIDE_RADIUS and 9 * odd <= sum(sizes):
                        want.setdefault(int(a), []).append((d, int(b)))
            u, v = simhash.near_pairs(col, task, nearest, below, most=200)
            assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted((a, b) for a, x in want.items() for _, b in (sorted(x)[:1] if nearest else x))
    assert len(built) == 4
