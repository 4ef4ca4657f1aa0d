"""Operator 8: SimHash near-duplicates, linked exactly through vantage-point trees.

1. Fingerprints: 64 bits over the text's word shingles; only (id, fingerprint) goes on.
2. Equal fingerprints are one node (partial aggregation, so a hot group is one row).
3. Vantage points chosen from a bounded sample (``SAMPLE_PER_SHARD`` nodes for each shard,
   ``MAX_SAMPLE`` at most) split the space of fingerprints at median distances into shards of
   about ``SHARD_NODES`` nodes. Every node goes to its home shard and, as a visitor, to each
   shard whose boundary lies within the maximum distance (triangle bound), so that each pair
   within it meets in some shard. A shard of many visitors is dealt in parts: its own nodes go
   to all of them, a visitor to one, so that no task holds more than about ``VISITORS`` of them.
4. A task builds its shard's vantage-point tree, prunes branches by the same bound and
   compares what is left bit by bit. It emits one row for each linked node (its group in this
   shard), a spanning forest and never all pairs.
5. Groups that share a node are merged until nothing changes (min label over joins and
   partial aggregates; each round is written to the shared folder).

Distances in 64 bits crowd around 32, so a bound of 3 prunes about a fifth of a branch at a
level: the work is about n^1.7, with visitors of about n^0.7 for each node. README has figures.

Defined results: texts that are null, empty or blank have fingerprint zero, linked like any
other; fewer words than a shingle are one shingle; a null id takes part, and is a component's
id only where no document of the component has one; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_batches, row_key, text_words, whole_row

BITS = 64
SEED = 42
SAMPLE, SAMPLE_PER_SHARD, MAX_SAMPLE = 4096, 16, 1 << 18  # nodes: at least, for each shard, at most
SHARD_NODES = 1 << 16  # about a second of comparisons; fewer, larger shards have fewer visitors
VISITORS = 4 * SHARD_NODES
LEAF = 256
HASH_CHUNK = 1 << 16


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bit j is set if it is set in over half the shingles' XXH64."""
    if not words:
        return 0
    shingle = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    stops = ends[shingle - 1:].tolist()
    count = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(starts), HASH_CHUNK):
        spans = zip(starts[lo:lo + HASH_CHUNK], stops[lo:lo + HASH_CHUNK])
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans), dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, fp): fp is the fingerprint's 64 bits as a signed long, body the XXH64 of the text."""
    row_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(text_words(t), shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "body", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col))
    return rows.mapInArrow(run, "id long, body long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of a few points, the one whose distances spread most, and the distance that halves the points."""
    some = points[rng.integers(0, len(points), 256)]
    tries = points[rng.integers(0, len(points), 8)]
    v = max(tries, key=lambda t: distance(some, t).std())
    d = distance(points, v)
    mid = int(np.median(d))
    # distances are few whole numbers: take the cut that is nearest to halves
    cut = min((mid - 1, mid), key=lambda c: abs(int((d <= c).sum()) * 2 - len(points)))
    return v, cut


def split(d: np.ndarray, home: np.ndarray, cut: int, reach: int) -> tuple[tuple, tuple]:
    """((inner rows, their home flags), (outer rows, theirs)) of rows at distances ``d`` from the vantage point.

    A pair of members that the cut parts meets inside, where its outer one visits; a visitor
    goes to every side that can hold a member within reach.
    """
    d = d.astype(np.int16)
    inner = home & (d <= cut)
    outer = home & (d > cut)
    to_inner = inner | (outer & (d <= cut + reach)) | (~home & (d <= cut + reach))
    to_outer = outer | (~home & (d > cut - reach))
    return (to_inner, inner), (to_outer, outer)


def shard_tree(sample: np.ndarray, n_shards: int, reach: int) -> list:
    """Splits of the sample until there are ``n_shards`` leaves, the fullest leaf first.

    A node of the tree is [vantage point, cut, inner, outer] or a leaf's number; the largest
    leaf counts visitors too, so that a dense group is split further than the rest.
    """
    rng = np.random.default_rng(SEED)
    root: list = [None]
    heap = [(-len(sample), 0, sample, np.ones(len(sample), bool), root, 0)]
    n, leaves = 1, []
    while heap:
        _, _, pts, home, parent, slot = heapq.heappop(heap)
        members = pts[home]
        if len(leaves) + len(heap) + 1 >= n_shards or len(members) < 8 or (members == members[0]).all():
            parent[slot] = len(leaves)
            leaves.append(len(members))
            continue
        v, cut = vantage(members, rng)
        d = distance(pts, v)
        if not 0 < (d[home] <= cut).sum() < len(members):
            parent[slot] = len(leaves)
            leaves.append(len(members))
            continue
        node = [v, cut, None, None]
        parent[slot] = node
        for side, (rows, own) in zip((2, 3), split(d, home, cut, reach)):
            n += 1
            heapq.heappush(heap, (-int(rows.sum()), n, pts[rows], own[rows], node, side))
    return root[0]


def deal(node, pts: np.ndarray, home: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, points, home flags) of the points that belong to or visit each shard."""
    if not len(pts):
        return
    if isinstance(node, int):
        yield node, pts, home
        return
    v, cut, inner, outer = node
    for child, (rows, own) in zip((inner, outer), split(distance(pts, v), home, cut, reach)):
        yield from deal(child, pts[rows], own[rows], reach)


class Groups:
    """Union-find over 0..n-1 by arrays; the root of a group is its smallest number."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                return r
            r = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def link_shard(pts: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """The group (its first row) of each row, over all pairs within reach that hold a member."""
    groups, rng = Groups(len(pts)), np.random.default_rng(SEED)
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        own, visit = stack.pop()
        if not len(own) or len(own) + len(visit) < 2:
            continue
        cut = -1
        if len(own) > LEAF:
            v, cut = vantage(pts[own], rng)
            d_own = distance(pts[own], v).astype(np.int16)
            inner = d_own <= cut
        if cut < 0 or inner.all() or not inner.any():
            both = np.concatenate([own, visit])
            for lo in range(0, len(both), 4096):
                rows = both[lo:lo + 4096]
                for col in range(0, len(own), 1024):
                    cols = own[col:col + 1024]
                    i, j = np.nonzero(distance(pts[rows][:, None], pts[cols][None, :]) <= reach)
                    groups.link(rows[i], cols[j])
            continue
        d_visit = distance(pts[visit], v).astype(np.int16)
        crossing = own[~inner & (d_own <= cut + reach)]
        stack.append((own[inner], np.concatenate([visit[d_visit <= cut + reach], crossing])))
        stack.append((own[~inner], visit[d_visit > cut - reach]))
    return groups.roots(np.arange(len(pts)))


def sample_nodes(nodes: DataFrame, n: int, size: int) -> np.ndarray:
    """At most ``size`` of the ``n`` fingerprints, by hash; about twice as many pass the scan."""
    lot = F.pmod(F.xxhash64("fp", F.lit("vp")), F.lit(1 << 30))
    few = nodes.select("fp", lot.alias("lot")).where(F.col("lot") < int((1 << 30) * min(1.0, 2 * size / max(n, 1))))
    return few.orderBy("lot", "fp").limit(size).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)


def visitor_parts(tree, sample: np.ndarray, n: int, reach: int) -> dict[int, int]:
    """The parts of each shard, from the visitors that it has of the sample."""
    guests = {shard: int((~home).sum()) for shard, _, home in deal(tree, sample, np.ones(len(sample), bool), reach)}
    return {shard: max(1, -(-g * n // (len(sample) * VISITORS))) for shard, g in guests.items()}


def shard_groups(nodes: DataFrame, max_distance: int) -> DataFrame:
    """(fp, rep): the groups of linked nodes that each shard finds; rep is a node of the group."""
    n = nodes.count()
    n_shards = max(1, -(-n // SHARD_NODES))
    sample = sample_nodes(nodes, n, min(MAX_SAMPLE, max(SAMPLE, SAMPLE_PER_SHARD * n_shards)))
    tree = shard_tree(sample, n_shards, max_distance) if len(sample) else 0
    parts = visitor_parts(tree, sample, n, max_distance)

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pts = b.column(0).to_numpy().view(np.uint64)
            for shard, p, home in deal(tree, pts, np.ones(len(pts), bool), max_distance):
                k = parts.get(shard, 1)
                for part in range(k):
                    here = home | (p % np.uint64(k) == part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(here.sum()), shard, np.int32)), pa.array(np.full(int(here.sum()), part, np.int32)),
                         pa.array(p[here].view(np.int64)), pa.array(home[here])], ["shard", "part", "fp", "home"])

    def link(table: pa.Table) -> pa.Table:
        pts = table.column("fp").to_numpy().view(np.uint64)
        root = link_shard(pts, table.column("home").to_numpy(), max_distance)
        linked = np.bincount(root, minlength=len(pts))[root] > 1
        fp = pts.view(np.int64)
        return pa.table({"fp": fp[linked], "rep": fp[root[linked]]})

    shards = nodes.select("fp").mapInArrow(to_shards, "shard int, part int, fp long, home boolean")
    return shards.groupBy("shard", "part").applyInArrow(link, "fp long, rep long")


def merge_groups(groups: DataFrame) -> DataFrame:
    """(fp, root): one root for all groups (fp, rep) that are connected through shared nodes."""
    groups = materialize(groups.distinct(), "simhash-groups")
    while True:
        least = groups.withColumn("least", F.min("rep").over(Window.partitionBy("fp")))  # few groups hold one node
        new = materialize(least.groupBy("rep").agg(F.min("least").alias("new")), "simhash-roots")
        if new.where("new <> rep").isEmpty():
            return groups.withColumnRenamed("rep", "root")
        groups = materialize(groups.join(new, "rep").select("fp", F.col("new").alias("rep")).distinct(), "simhash-groups")


def components(fps: DataFrame, max_distance: int) -> DataFrame:
    """``fps`` with root, a fingerprint that names the component, and component_id, its smallest id."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = merge_groups(shard_groups(nodes, max_distance))
    linked = materialize(nodes.join(roots, "fp"), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(least, "root").select("fp", "root", F.struct("component").alias("c"))
    by_fp = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("c").isNull(), F.col("first")).otherwise(F.col("c.component")).alias("component_id"))
    return fps.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, body, fp, root, component_id) for every row of ``docs``."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    return components(fps, max_distance).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id's, null after all (of its texts the smallest hash)."""
    found = near_duplicates(docs, shingle, max_distance, id_col, text_col)
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("body").alias("body"))).alias("m")
    stay = found.groupBy("root").agg(first).select(row_key(F.col("m.id"), F.col("m.body")))
    rows = docs.select(row_key(F.col(id_col).cast("long"), F.xxhash64(text_col)), whole_row(docs))
    # rows that repeat share their key, by which the join has already dealt and sorted them
    return rows.join(stay, "_key").dropDuplicates(["_key"]).select("_doc.*")
