"""SimHash near-duplicates by BK-trees.

A fingerprint is made from the XXH64 of word shingles. Cut into radius + k blocks of bits, fingerprints within the
radius agree on k of them, so a shard of the search is k blocks and their values; k grows with the number of
fingerprints (see agreeing), so that shards stay small, and whatever it is, no link is lost. A BK-tree over the shard's
distinct fingerprints (children keyed by Hamming distance to their parent) is searched along the edges within the
radius. A shard of more than SHARD_ROWS fingerprints is split by a hash; the tree of each part meets the fingerprints of every part. Trees reach
their queries through the shuffle, not through the driver: all of them together grow with the corpus, so a broadcast
would have no bound. A search hands on a spanning forest of its links, never all pairs; components come from rounds of
contraction, cut by written tables.

Nulls and texts without words have fingerprint zero and are linked like any other. Repeated rows each get a row. Null
doc_ids never name a component unless it has no other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import driver_gives_back, give_back, map_slices, materialize, met_by_shuffle, read, release

RADIUS = 3
#: Fingerprints of a part of a shard.
SHARD_ROWS = 512


def bit_majorities(hashes: np.ndarray) -> np.ndarray:
    """Of big-endian bytes (a row for each hash): the bits set in over half the rows, as bytes."""
    n, ones = len(hashes), np.zeros(hashes.shape[1] * 8, np.int64)
    for i in range(0, n, 255):  # sums of 255 bits fit a byte
        ones += np.unpackbits(hashes[i : i + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n)


def shingle_digests(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle of lower-cased (A-Z) UTF-8, a row of 8 bytes each; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)] if words else []
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes | None, width: int, many: int = 1) -> list[int]:
    """Of lower-cased (A-Z) UTF-8: `many` signed 64-bit numbers. The first is made from the XXH64 of shingles, others from mixes of it."""
    digests = shingle_digests(text, width)
    return majority_words(digests, many) if len(digests) else [0] * many


def majority_words(digests: np.ndarray, many: int) -> list[int]:
    """The fingerprint of shingles that have these digests (a row of 8 bytes each)."""
    if many > 1:
        h = digests.view(">u8").astype(np.uint64)
        mixed = (h ^ h >> np.uint64(29)) * (2 * np.arange(1, many, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        digests = np.hstack([digests, (mixed ^ mixed >> np.uint64(32)).astype(">u8").view(np.uint8)])
    return bit_majorities(digests).view(">i8").tolist()


def fingerprints(docs: DataFrame, width: int, many: int = 1) -> DataFrame:
    """doc_id and prints (array<long>) of each row."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        return {"doc_id": batch.column("doc_id"), "prints": [fingerprint(t, width, many) for t in texts]}

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, prints array<long>")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words. (bitwise_count counts the bits of a signed number's absolute value.)"""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees, one for each group of distinct keys, built and searched level by level for all groups at once."""

    def __init__(self, keys: np.ndarray, group: np.ndarray):
        """keys: rows of 64-bit words. group: of each key, in ascending order; the first key of a group is its root."""
        self.keys, n, self.span = keys, len(keys), 64 * keys.shape[1] + 1
        self.groups, first = np.unique(group, return_index=True)
        self.roots = first
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        at = first[np.searchsorted(self.groups, group)]
        todo = np.flatnonzero(at != np.arange(n))
        at = at[todo]
        while len(todo):
            d = distance(keys[todo], keys[at])
            slot = at * self.span + d
            _, new, inverse = np.unique(slot, return_index=True, return_inverse=True)
            child = todo[new]
            parent[child], edge[child] = at[new], d[new]
            stay = np.ones(len(todo), bool)
            stay[new] = False
            at, todo = child[inverse][stay], todo[stay]
        self.child = np.flatnonzero(parent >= 0)
        slot = parent[self.child] * self.span + edge[self.child]
        order = np.argsort(slot, kind="stable")
        self.child, self.slot = self.child[order], slot[order]

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in queries, position in keys) within the radius."""
        g = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        q = np.flatnonzero(self.groups[g] == group)
        node = self.roots[g[q]]
        while len(q):
            d = distance(queries[q], self.keys[node])
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.slot, node * self.span + np.maximum(d - radius, 0))
            n = np.searchsorted(self.slot, node * self.span + np.minimum(d + radius, self.span - 1), side="right") - low
            q = np.repeat(q, n)
            node = self.child[np.arange(len(q)) + np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)]


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays: labels are always roots, the smallest member of a set."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def local_links(keys: np.ndarray, task: np.ndarray, indexed: np.ndarray, asks: np.ndarray, radius: int, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each task, as pairs of positions. Rows come sorted by task; indexed rows stand in its tree, asking rows search it."""
    label, tree = np.arange(len(keys)), np.flatnonzero(indexed)
    if len(tree):
        forest, ask = Forest(keys[tree], task[tree]), np.flatnonzero(asks)
        for i in range(0, len(ask), most):
            part = ask[i : i + most]
            for q, node in forest.search(keys[part], task[part], radius):
                union(label, part[q], tree[node])
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return moved, label[moved]


def tasked(tasks: DataFrame, solve: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(u, v): the pairs of ids that solve gets from the columns of whole tasks and the number of each row's task. tasks: id, shard, i, j and what solve reads."""
    tasks = tasks.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            col = {c: t.column(c).to_numpy() for c in t.column_names}
            same = (np.diff(col["shard"]) == 0) & (np.diff(col["i"]) == 0) & (np.diff(col["j"]) == 0)
            task = np.concatenate(([0], np.cumsum(~same)))
            u, v = solve(col, task)
            return pa.RecordBatch.from_arrays([pa.array(col["id"][u]), pa.array(col["id"][v])], ["u", "v"])

        held: list = []
        for batch in batches:
            for k in range(0, batch.num_rows, 5000):
                held.append(pa.Table.from_batches([batch.slice(k, 5000)]))
                ends = [[held[x].column(c)[y].as_py() for c in ("shard", "i", "j")] for x, y in ((0, 0), (-1, -1))]
                if ends[0] == ends[1] or sum(t.num_rows for t in held) < 5000:
                    continue
                rest = pa.concat_tables(held)
                key = [rest.column(c).to_numpy() for c in ("shard", "i", "j")]
                cut = int(np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))[-1]) + 1  # the last task may go on in the next batch
                yield solved(rest.slice(0, cut))
                held = [rest.slice(cut)]
        if held:
            yield solved(pa.concat_tables(held))

    return tasks.mapInArrow(run, "u long, v long")


def linked(tasks: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(u, v): a spanning forest of the links in each task. tasks: id, shard, i, j, indexed, asks and the fingerprint's words."""
    return tasked(tasks, lambda col, task: local_links(np.stack([col[w] for w in words], axis=1), task, col["indexed"], col["asks"], radius)).distinct()


def agreeing(n: int, radius: int) -> int:
    """How many blocks a shard's key has, for n fingerprints: the fewest that leave SHARD_ROWS or fewer random ones in a shard."""
    return next((k for k in (1, 2) if n >> 64 * k // (radius + k) <= SHARD_ROWS), 3)


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, agree: int | None = None) -> DataFrame:
    """(u, v): enough of the links between distinct fingerprints fp within the radius to connect what all of them connect."""
    agree = agree or agreeing(nodes.count(), radius)
    n = radius + agree
    cut = [64 * b // n for b in range(n + 1)]
    masks = [sum(((1 << cut[b + 1]) - (1 << cut[b])) for b in chosen) for chosen in combinations(range(n), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # the key: the bits of the chosen blocks, mixed with the number of the choice; equal keys of unlike bits only cost a comparison
    shard = F.explode(F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)]))
    spread = materialize(nodes.select("fp", shard.alias("shard")))
    sizes = spread.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    parts = spread.join(sizes, "shard").withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("parts")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))  # its own part also builds the tree there
    tasks = parts.select("fp", "shard", "own", meets.alias("other"))
    tasks = tasks.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("fp").alias("id"), "fp", "own")
    return linked(tasks.withColumn("indexed", F.col("own") == F.col("i")).withColumn("asks", F.col("own") == F.col("j")).drop("own"), ["fp"], radius)


#: Edges that one task joins at most, 16 bytes each; more are contracted before.
LOCAL_EDGES = 1 << 19


def labelled(edges: DataFrame) -> DataFrame:
    """components of LOCAL_EDGES edges or fewer, by one task; label is the least of a component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches]
        fp, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), return_inverse=True)
        label, at = np.arange(len(fp)), at.reshape(2, -1)
        union(label, at[0], at[1])
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp[label])], ["fp", "label"])
        give_back()

    return materialize(edges.select("u", "v").coalesce(1).mapInArrow(run, "fp long, label long"))


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) for every fp in edges; label is the same over a component. Each round maps nodes to smaller neighbours and
    contracts, until the edges are few enough for one task: a round has a dozen shuffles, which the driver plans and keeps
    threads and records of however few the edges are."""
    edges = materialize(edges)
    label = None
    while (n := edges.count()) > LOCAL_EDGES:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        for _ in range(2):
            p = p.join(met_by_shuffle(p.select(F.col("u").alias("p"), F.col("p").alias("up"))), "p", "left").select("u", F.coalesce("up", "p").alias("p"))
        p = materialize(p)
        to = lambda c: met_by_shuffle(p.select(F.col("u").alias(c), F.col("p").alias(f"{c}p")))
        old, edges = edges, materialize(edges.join(to("u"), "u").join(to("v"), "v").where("up <> vp").select(F.col("up").alias("u"), F.col("vp").alias("v")).distinct())
        release(old)
        if label is None:
            label = p.select(F.col("u").alias("fp"), F.col("p").alias("label"))
        else:
            label = materialize(label.join(to("label"), "label", "left").select("fp", F.coalesce("labelp", "label").alias("label")))
    if label is None:
        return labelled(edges)
    if not n:
        return label
    last = labelled(edges).select(F.col("fp").alias("label"), F.col("label").alias("up"))
    return materialize(label.join(met_by_shuffle(last), "label", "left").select("fp", F.coalesce("up", "label").alias("label")))


def joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """components of the edges that label (fp, label) comes from and of more edges: those are laid between labels first."""
    of = lambda c: met_by_shuffle(label.select(F.col("fp").alias(c), F.col("label").alias(f"{c}l")))
    between = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ul", "u").alias("u"), F.coalesce("vl", "v").alias("v"))
    between = materialize(between.where("u <> v").distinct())
    if between.isEmpty():
        return label
    more = components(between)
    moved = more.select(F.col("fp").alias("label"), F.col("label").alias("up"))
    old = label.join(met_by_shuffle(moved), "label", "left").select("fp", F.coalesce("up", "label").alias("label"))
    new = more.join(met_by_shuffle(label.select("fp")), "fp", "left_anti").select("fp", "label")
    return materialize(old.unionByName(new))


def near_duplicates(docs: DataFrame, width: int, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row, by one fingerprint; docs needs doc_id and text."""
    prints = materialize(fingerprints(docs, width).select("doc_id", F.col("prints")[0].alias("fp")))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(nodes, radius))
    named = materialize(nodes.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = named.join(least, "label", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: The least similarity of near duplicates: common shingles to all shingles of two texts.
SIMILAR = (4, 5)
#: Two texts of it differ in 39 of 256 fingerprint bits (48 where they have 4 and 5 shingles); pairs beyond WIDE_RADIUS
#: aren't compared, which by the binomial model leaves out one in a million of the latter and far fewer of others.
DECIDING, WIDE_RADIUS = 4, 80
#: 64-bit words of a set's parities: bit b is the parity of the number of its shingles whose hash falls on b. Parities of
#: two sets differ in no more bits than the sets have unshared shingles, so too many differing bits prove a pair unlike.
PARITIES = 16
#: Documents whose shingles are counted for the order of shingles, and how many of the common ones are told apart. The
#: order only decides how much is compared, never what is found.
COUNTED, COMMON = 20_000, 1 << 16
#: Ids that are broadcast at most, 8 bytes each; more are met by a shuffle.
BROADCAST_IDS = 1 << 20


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_digests(text, width).view(">i8").ravel().astype(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are SIMILAR or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * common >= SIMILAR[0] * (len(a) + len(b) - common)


def parities(hashes: np.ndarray) -> list[int]:
    """PARITIES words of a set's parities."""
    at = (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * PARITIES)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * PARITIES).astype(np.uint8) & 1).view(np.int64).tolist()


def leading(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first, rare ones before common ones: of two SIMILAR sets these have one in common."""
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    most = len(hashes) + SIMILAR[0] * len(hashes) // -SIMILAR[1] + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, rank))[:most]]


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that many of COUNTED documents have."""
    every = max(1, docs.count() // COUNTED)

    def run(batch: pa.RecordBatch) -> dict:
        return {"hashes": [shingle_set(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]}

    some = map_slices(docs.where(F.pmod(F.xxhash64("key", F.lit(9)), F.lit(every)) == 0).select("text"), run, "hashes array<long>")
    n = some.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n >= 8")
    top = n.orderBy(F.col("n").desc(), "hash").limit(COMMON).toPandas().sort_values("hash")
    return top["hash"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Of each row (key, text): key, id (a hash of its shingles), n (how many), w (the fingerprint, then the parities) and keys (the leading shingles)."""
    common, counts = common_shingles(docs, width)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        prints = [majority_words(h.astype(">i8").view(np.uint8).reshape(-1, 8), DECIDING) if len(h) else [0] * DECIDING for h in sets]
        ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], np.uint64).view(np.int64)
        return {"key": batch.column("key"), "id": ids, "n": [len(h) for h in sets], "w": [p + parities(h) for p, h in zip(prints, sets, strict=True)], "keys": [leading(h, common, counts) for h in sets]}

    kind = docs.schema["key"].dataType.simpleString()
    return map_slices(docs.select("key", "text"), run, f"key {kind}, id long, n long, w array<long>, keys array<long>")


def near_pairs(col: dict[str, np.ndarray], task: np.ndarray, nearest: bool, below: bool, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions, an asking and an indexed row of one task, whose labels differ and that may be SIMILAR. Those
    within WIDE_RADIUS come from a BK-tree over each task's indexed fingerprints; sizes and parities then rule out others.

    nearest: of each asking row only the nearest partner. below: only partners of a smaller label."""
    words, n, label = np.stack(col["w"]) if len(col["w"]) else np.zeros((0, DECIDING + PARITIES), np.int64), col["n"], col["label"]
    prints, odd = np.ascontiguousarray(words[:, :DECIDING]), np.ascontiguousarray(words[:, DECIDING:])
    stand, ask = np.flatnonzero(col["indexed"]), np.flatnonzero(col["asks"])
    found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if not len(stand) or not len(ask):
        return found[0]
    # a tree holds each fingerprint of a task once, and so do the queries; rows that share it are met after the search
    trees, tree_of = distinct_prints(prints[stand], task[stand])
    queries, query_of = distinct_prints(prints[ask], task[ask])
    forest = Forest(prints[stand[trees]], task[stand[trees]])
    owners, askers = (np.argsort(x, kind="stable") for x in (tree_of, query_of))
    held, asked = (np.bincount(x) for x in (tree_of, query_of))
    first, begin = np.cumsum(held) - held, np.cumsum(asked) - asked
    low = np.searchsorted(task[stand], task[ask[queries]])
    many = (np.searchsorted(task[stand], task[ask[queries]], side="right") - low) * asked
    for part in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(np.cumsum(many) // most)) + 1):
        near: list = [(np.zeros(0, np.int64),) * 3]
        for q, node in forest.search(prints[ask[queries[part]]], task[ask[queries[part]]], WIDE_RADIUS):
            q = part[q]
            m = asked[q] * held[node]
            pair, i = np.repeat(np.arange(len(q)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a = ask[askers[begin[q[pair]] + i // held[node[pair]]]]
            b = stand[owners[first[node[pair]] + i % held[node[pair]]]]
            may = label[b] < label[a] if below else label[b] != label[a]
            may &= SIMILAR[1] * np.minimum(n[a], n[b]) >= SIMILAR[0] * np.maximum(n[a], n[b])
            a, b = a[may], b[may]
            # unshared shingles of a SIMILAR pair are a ninth of both sets at most
            may = (SIMILAR[0] + SIMILAR[1]) * distance(odd[a], odd[b]) <= (SIMILAR[1] - SIMILAR[0]) * (n[a] + n[b])
            a, b = a[may], b[may]
            near.append((a, b, distance(prints[a], prints[b])))
        a, b, d = (np.concatenate(x) for x in zip(*near, strict=True))
        if nearest:
            order = np.lexsort((col["id"][b], d, a))
            a, b = a[order], b[order]
            kept = np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]
            a, b = a[kept], b[kept]
        found.append((a, b))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def distinct_prints(prints: np.ndarray, task: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first row of each task and fingerprint, by task; and of each row the place of its own among them."""
    order = np.lexsort((*prints.T, task))
    new = np.ones(len(order), bool)
    new[1:] = np.any(prints[order[1:]] != prints[order[:-1]], axis=1) | (task[order[1:]] != task[order[:-1]])
    place = np.zeros(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def shared_counts(us: pa.ListArray, vs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of sets (lists of distinct numbers): how many both have, and how many there are in both lists together."""
    nu, nv = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (us, vs))
    pair = np.concatenate([np.repeat(np.arange(len(us)), nu), np.repeat(np.arange(len(vs)), nv)])
    hashes = np.concatenate([us.flatten().to_numpy(), vs.flatten().to_numpy()])
    order = np.lexsort((hashes, pair))
    pair, hashes = pair[order], hashes[order]
    twice = (pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(pair[1:][twice], minlength=len(us)), nu + nv


def bodies(docs: DataFrame, owners: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, hashes): the whole sets of shingles of some ids, made again from the text of the row that owners (id, key) names."""
    first = materialize(owners.join(met_by_shuffle(ids), "id", "left_semi"))
    few = first.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(first) if few else met_by_shuffle(first), "key").select("id", "text")

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "hashes": [shingle_set(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]}

    return materialize(map_slices(rows, run, "id long, hashes array<long>").dropDuplicates(["id"]))


def verified(pairs: DataFrame, of_id: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (u, v) whose shingles are SIMILAR or more. of_id gets ids and gives (id, hashes)."""
    found = of_id(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    of = lambda c: met_by_shuffle(found.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}h")))
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "uh", "vh")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                common, total = shared_counts(part.column("uh"), part.column("vh"))
                yield part.select(["u", "v"]).filter(pa.array(SIMILAR[1] * common >= SIMILAR[0] * (total - common)))

    return both.mapInArrow(run, "u long, v long")


def similar(docs: DataFrame, width: int = 5) -> DataFrame:
    """key and component_id (the least key) of every row of docs (key, text), which should be cheap to read again; keys aren't
    null. Components of texts whose shingles are 0.8 similar or more; every link is decided by the texts' own shingles.

    Two such texts share a leading shingle, which is their shard. First each row of a part of a shard is held against
    its nearest one there; then rows outside the shard's largest component so far against the nearest of every part,
    and last against all. Two members of a component needn't be compared: a link would connect nothing new. Of pairs in
    a shard only those go on that sizes, fingerprints and parities can't tell apart from a link.
    """
    sets = materialize(shingle_sets(docs, width))
    nodes = materialize(sets.groupBy("id").agg(F.first("n").alias("n"), F.first("w").alias("w"), F.min("key").alias("least")))
    spread = sets.groupBy("id").agg(F.first("keys").alias("keys")).select("id", F.explode("keys").alias("shard"))
    spread = materialize(spread)
    sizes = spread.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
    met = spread.join(met_by_shuffle(sizes), "shard").withColumn("parts", F.ceil(F.col("size") / SHARD_ROWS).cast("int"))
    met = materialize(met.withColumn("i", F.pmod(F.xxhash64("id", "shard"), F.col("parts")).cast("int")).withColumn("j", F.lit(0)).drop("size"))
    release(spread)
    yes, no = F.lit(True), F.lit(False)

    def decided(tasks: DataFrame, nearest: bool, below: bool, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        pairs = tasked(tasks.join(met_by_shuffle(nodes.select("id", "n", "w")), "id"), lambda col, task: near_pairs(col, task, nearest, below))
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(met_by_shuffle(tried), ["u", "v"], "left_anti"))
        driver_gives_back(docs.sparkSession)
        return pairs, materialize(verified(pairs, lambda ids: bodies(docs, nodes.select("id", F.col("least").alias("key")), ids, width)))

    own = met.withColumn("label", F.col("id")).withColumn("indexed", yes).withColumn("asks", yes).drop("parts")
    tried, links = decided(own, True, True, None)
    label = components(links)
    for nearest in (True, False):
        now = materialize(met.join(met_by_shuffle(label.withColumnRenamed("fp", "id")), "id", "left").withColumn("label", F.coalesce("label", "id")))
        large = now.groupBy("shard", "label").agg(F.count("*").alias("m")).groupBy("shard").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.count("*").alias("labels"))
        outside = now.join(met_by_shuffle(large.where("labels > 1").select("shard", "largest")), "shard").where(F.col("label") != F.col("largest")).drop("largest")
        asking = outside.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("indexed", no).withColumn("asks", yes)
        standing = now.join(met_by_shuffle(outside.select("shard").distinct()), "shard", "left_semi").withColumn("indexed", yes).withColumn("asks", no)
        driver_gives_back(docs.sparkSession)  # here the driver has planned some twenty jobs since the last time
        more, links = decided(standing.unionByName(asking).drop("parts"), nearest, False, tried)
        tried, label = tried.unionByName(more), joined(label, links)
    named = materialize(nodes.select("id", "least").join(met_by_shuffle(label.withColumnRenamed("fp", "id")), "id", "left").select("id", "least", F.coalesce("label", "id").alias("label")))
    first = named.groupBy("label").agg(F.min("least").alias("component_id"))
    release(met)
    driver_gives_back(docs.sparkSession)
    return sets.select("key", "id").join(met_by_shuffle(named.join(met_by_shuffle(first), "label").select("id", "component_id")), "id").select("key", "component_id")


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"), 3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
