"""Substrings of 200 bytes that start in more than one place, by suffix arrays of shards.

A window is a string of WIDTH bytes inside a text. Its anchor is the GRAM bytes in it with the least hash, so equal
windows have equal anchors, and a run of windows with one anchor, a piece, stands for all of them. Pieces are counted by
anchor: a window whose anchor occurs once occurs once. Whole pieces that are alike are counted too, before anything
large is shuffled: all their windows repeat, whatever number of texts share them. What is left to decide are the
windows of unlike pieces with one anchor. Each distinct piece goes, with its bytes, to the shard of its anchor, where a
suffix array (Larsson-Sadakane) and Kasai's common prefixes bring equal windows together. The pieces of a frequent
anchor are dealt over several shards; each of these gives its windows as a sorted run of digests, and the runs are
merged, in ranges of digests, by binary search of one run's entries in another.

No task holds more than a shard, a range of digests, or one row with its ranges; a row's text is read in parts of PART
bytes where windows are found. Bytes and offsets are of UTF-8. Anchors are told apart by 64 bits (two that share them are
compared in one shard, which changes nothing), whole pieces by 128 bits of BLAKE2b and windows of frequent anchors by 128.

Nulls: a null text is empty; doc_id is carried only. Texts under WIDTH bytes keep all. Copies of a row are other places,
so they go whole if they are long enough. An empty table gives no rows; extra columns aren't read by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import give_back, map_slices, materialize, read, spread_join
from .suffixes import common_prefixes, suffix_array

WIDTH, GRAM = 200, 64
#: Bytes of a text that are looked through at once.
PART = 1 << 20
#: Pieces of a shard, and of an anchor in one shard, on average.
SHARD = 3000
#: Windows of a range of digests, on average.
RANGE = 150_000
KEY = ("_f", "_r")
ODD = 0x9E3779B97F4A7C15


@lru_cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    up, down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of all texts data[begin:end], which don't overlap: where each begins, its windows, its anchor's place and hash."""
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    up, down = powers(1 << (n + 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)  # ties go to the first place
    grams, held = width - gram + 1, 1
    while held * 2 <= grams:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    if held < grams:
        least = np.minimum(least[: held - grams], least[grams - held :])
    out = np.zeros(n + 1, np.int32)
    fits = ends - begins >= width
    np.add.at(out, begins[fits], 1)
    np.add.at(out, ends[fits] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(out[: len(least)]) > 0)
    anchor = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1))[: len(at)])
    windows = np.diff(np.append(first, len(at)))
    return at[first], windows, anchor[first], h[anchor[first]].view(np.int64)


def pieces_of(batch: pa.RecordBatch) -> dict:
    """Rows of SCHEMA: the pieces of a batch's texts."""
    keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in KEY]
    texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "at", "windows", "anchor", "one", "two")}

    def look(data: bytes, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray, offset: int) -> None:
        at, windows, place, anchor = anchors(np.frombuffer(data, np.uint8), begins, ends)
        row = np.searchsorted(ends, at, side="right")
        marks = b"".join([hashlib.blake2b(data[a : a + n + WIDTH - 1], digest_size=16).digest() for a, n in zip(at.tolist(), windows.tolist(), strict=True)])
        two = np.frombuffer(marks, np.int64).reshape(-1, 2)
        for name, x in (("row", rows[row]), ("at", at - begins[row] + offset), ("windows", windows), ("anchor", anchor), ("one", two[:, 0] ^ (place - at)), ("two", two[:, 1])):
            out[name].append(x)

    short = [k for k, t in enumerate(texts) if WIDTH <= len(t) <= PART]
    if short:
        ends = np.cumsum([len(texts[k]) for k in short])
        look(b"".join(texts[k] for k in short), np.array(short), ends - [len(texts[k]) for k in short], ends, 0)
    for k, t in enumerate(texts):
        for a in range(0, len(t) - WIDTH + 1, PART) if len(t) > PART else ():
            part = t[a : a + PART + WIDTH - 1]
            look(part, np.array([k]), np.array([0]), np.array([len(part)]), a)
    found = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    row = found.pop("row")
    return {"_f": keys[0][row], "_r": keys[1][row], **found}


SCHEMA = "_f long, _r long, at long, windows long, anchor long, one long, two long"


def equal_windows(texts: list[bytes], windows: list[int], copies: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all windows that the pieces own: piece, offset, a number that equal windows share, and whether it repeats.

    A piece of several copies counts so often."""
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    data[ends] = np.arange(len(texts))
    order, rank = suffix_array(data)
    shared = common_prefixes(data, order, rank)
    group = np.cumsum(shared < WIDTH)
    begins = ends - [len(t) for t in texts]
    piece = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    same = group[rank[begins[piece] + offset]]
    often = np.bincount(same, weights=copies[piece].astype(np.float64))
    return piece, offset, same, often[same] > 1


def spans(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjacent numbers `at` with the same `of`, both in order: of, first, last."""
    if not len(of):
        return of, at, at
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (np.diff(at) != 1)))
    return of[first], at[first], at[np.append(first[1:], len(of)) - 1]


#: Of a shard: ranges of repeated windows of a row (kind 0), and sorted runs of digests (kind 1), of which `open` says
#: where the place (row, offset) of an entry is still to be decided.
SHARD_SCHEMA = "kind int, _f long, _r long, first long, last long, part long, digests binary, fs binary, rs binary, ats binary, open binary"


def decided(parts: int) -> Callable[[pa.Table], pa.Table]:
    kind = to_arrow_schema(StructType.fromDDL(SHARD_SCHEMA))

    def run(shard: pa.Table) -> pa.Table:
        texts, windows = shard.column("bytes").to_pylist(), shard.column("windows").to_numpy()
        f, r, at, copies, split = (shard.column(c).to_numpy() for c in ("_f", "_r", "at", "copies", "split"))
        piece, offset, same, repeats = equal_windows(texts, windows, copies)
        told = repeats & (copies[piece] == 1)  # copies are decided by their number already
        p, first, last = spans(piece[told], offset[told])
        rows: dict[str, list] = {x.name: [] for x in kind}
        many = len(p)
        for name, x in (("kind", np.zeros(many, int)), ("_f", f[p]), ("_r", r[p]), ("first", at[p] + first), ("last", at[p] + last)):
            rows[name] = x.tolist()
        for name in kind.names[5:]:
            rows[name] = [None] * many
        ours = np.flatnonzero(split[piece] > 1)
        ours = ours[np.unique(same[ours], return_index=True)[1]]  # one of equal windows stands for them
        if len(ours):
            marks = np.array([hashlib.blake2b(texts[p][o : o + WIDTH], digest_size=16).hexdigest().encode() for p, o in zip(piece[ours].tolist(), offset[ours].tolist(), strict=True)], "S32")
            by = np.argsort(marks)
            marks, ours = marks[by], ours[by]
            cuts = np.array([b"%08x" % (-(-k << 32) // parts) for k in range(1, parts)], "S32")
            edges = [0, *np.searchsorted(marks, cuts).tolist(), len(marks)]  # where each range begins, by binary search
            open_ = ~repeats & (copies[piece] == 1)
            for k in range(parts):
                here = slice(edges[k], edges[k + 1])
                if edges[k] < edges[k + 1]:
                    w = ours[here]
                    values = (1, None, None, None, None, k, marks[here].tobytes(), f[piece[w]].tobytes(), r[piece[w]].tobytes(), (at[piece[w]] + offset[w]).tobytes(), open_[w].tobytes())
                    for name, v in zip(kind.names, values, strict=True):
                        rows[name].append(v)
        give_back()
        return pa.table({x.name: pa.array(rows[x.name], x.type) for x in kind})

    return run


def merged(a: np.ndarray, b: np.ndarray, key: str = "mark") -> np.ndarray:
    """Two sorted runs as one: each entry of b is looked up in a."""
    out = np.empty(len(a) + len(b), a.dtype)
    to = np.searchsorted(a[key], b[key], side="right") + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[to] = False
    out[to], out[rest] = b, a
    return out


MERGED_SCHEMA = "_f long, _r long, first long, last long"


def met(runs: pa.Table) -> pa.Table:
    """The open windows of a range of digests that another shard has too."""
    entry = np.dtype([("mark", "S32"), ("_f", np.int64), ("_r", np.int64), ("at", np.int64), ("open", bool)])
    heap = []
    for marks, *more in zip(*[runs.column(c).to_pylist() for c in ("digests", "fs", "rs", "ats", "open")], strict=True):
        run = np.empty(len(marks) // 32, entry)
        run["mark"] = np.frombuffer(marks, "S32")
        for name, x in zip(entry.names[1:], more, strict=True):
            run[name] = np.frombuffer(x, entry[name])
        heap.append(run)
    while len(heap) > 1:
        heap = [merged(*heap[k : k + 2]) if k + 1 < len(heap) else heap[k] for k in range(0, len(heap), 2)]
    run = heap[0]
    same = np.append(run["mark"][1:] == run["mark"][:-1], False)
    found = run[(same | np.append(False, same[:-1])) & run["open"]]
    give_back()
    return pa.table({"_f": found["_f"], "_r": found["_r"], "first": found["at"], "last": found["at"]})


def repeated(rows: DataFrame) -> DataFrame:
    """Ranges first..last of the starts of windows that start elsewhere too, by row. rows: _f and _r, which tell rows
    apart, and text; read again several times, so they must come from a table."""
    spark, thin = rows.sparkSession, rows.select(*KEY, "text")
    found = map_slices(thin, pieces_of, SCHEMA)
    counts = found.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("one").alias("low"), F.max("one").alias("high")).where(F.col("_n") > 1)
    counts = materialize(counts.select("anchor", "_n", (F.col("low") != F.col("high")).alias("unlike")))
    often = counts.agg(F.sum("_n")).first()[0] or 0
    pieces = spread_join(found, counts.withColumnRenamed("_n", "n"), ["anchor"], counts.select("anchor", "_n"), often)
    pieces = materialize(pieces.withColumn("last", F.col("at") + F.col("windows") - 1))
    alike = pieces.where("NOT unlike").select(*KEY, F.col("at").alias("first"), "last")

    unlike, piece = pieces.where("unlike"), ["anchor", "one", "two"]
    distinct = materialize(unlike.groupBy(*piece).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in (*KEY, "at", "windows", "n")]))
    copies = materialize(distinct.where("copies > 1").select(*piece, F.col("copies").alias("_n")))
    counted = copies.agg(F.sum("_n")).first()[0] or 0
    copied = spread_join(unlike, copies.select(*piece), piece, copies, counted).select(*KEY, F.col("at").alias("first"), "last")

    texts = thin.select(*KEY, F.col("text").cast("binary").alias("bytes"))
    held = distinct.hint("shuffle_hash").join(texts, list(KEY)).withColumn("bytes", F.substring("bytes", F.col("at").cast("int") + 1, F.col("windows").cast("int") + WIDTH - 1))
    many = distinct.count()
    shards, split = max(1, many // SHARD), F.ceil(F.col("n") / SHARD).cast("long")
    held = held.withColumn("split", split).withColumn("shard", F.pmod(F.xxhash64("anchor", F.pmod("one", "split")), F.lit(shards)))
    wide = distinct.where(F.col("n") > SHARD).agg(F.sum("windows")).first()[0] or 0
    parts = max(1, wide // RANGE)
    both = materialize(held.select("shard", *KEY, "at", "windows", "copies", "split", "bytes").groupBy("shard").applyInArrow(decided(parts), SHARD_SCHEMA))
    inside = both.where("kind = 0").select(*KEY, "first", "last")
    across = both.where("kind = 1").groupBy("part").applyInArrow(met, MERGED_SCHEMA)
    return alike.unionByName(copied).unionByName(inside).unionByName(across)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without(text: bytes, firsts: list[int], lasts: list[int]) -> tuple[bytes, int, int]:
    """A text without the bytes of windows that start in first..last, how many bytes go, and in how many runs."""
    if not firsts:
        return text, 0, 0
    by = np.argsort(firsts, kind="stable")
    first, end = np.array(firsts)[by], np.maximum.accumulate(np.array(lasts)[by] + WIDTH)
    new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
    begins, ends = first[new].tolist(), end[np.append(new[1:], len(first)) - 1].tolist()
    kept, at = [], 0
    for a, b in zip(begins, ends, strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), sum(ends) - sum(begins), len(begins)


def cleaned(rows: DataFrame) -> DataFrame:
    """rows (_f, _r, text and others) with removed: starts first and last of their repeated windows."""
    ranges = repeated(rows).groupBy(*KEY).agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    return rows.join(ranges.hint("shuffle_hash"), list(KEY), "left")


def digests(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {f.split()[0]: [] for f in DIGEST.split(", ")}
    for doc_id, text, firsts, lasts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "firsts", "lasts")], strict=True):
        data = (text or "").encode()
        kept, gone, runs = without(data, firsts or [], lasts or [])
        for name, v in zip(out, (doc_id, len(data), gone, runs, hashlib.sha256(kept).hexdigest()), strict=True):
            out[name].append(v)
    return out


def kept_bytes(rows: DataFrame) -> DataFrame:
    """rows (_f, _r, text and others) with `kept`: the text's bytes without repeated ones (a cut may part a character)."""
    own = [c for c in rows.columns if c not in (*KEY, "kept")]
    cut = lambda b: {"kept": [without((t or "").encode(), f or [], x or [])[0] for t, f, x in zip(*[b.column(c).to_pylist() for c in ("text", "firsts", "lasts")], strict=True)]}
    return map_slices(cleaned(rows.select(*own, *KEY)), cut, "kept binary", whole=True).select(*own, "kept")


def placed(table: DataFrame) -> DataFrame:
    """A table read from files with _f and _r: a row's file, and its number there."""
    return table.withColumns({"_f": F.xxhash64("_metadata.file_path"), "_r": F.col("_metadata.row_index")})


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = placed(read(spark, sf_dir, "documents")).select("doc_id", "text", *KEY)
    return map_slices(cleaned(docs), digests, DIGEST)
