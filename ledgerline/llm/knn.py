"""Operator 1: exact top-k inner-product search with a KD-tree per shard.

1. A coarse KD-tree (median splits of a bounded sample) deals the vectors into at most
   ``REGIONS`` regions; a region of many vectors - or of many equal ones, which no split
   parts - is cut into shards of about ``SHARD_ROWS`` by hash.
2. Each shard becomes one row: its vectors in the order of a KD-tree of median splits, with
   the tight bounding box of every node.
3. A first round searches, for each query, one shard of the region with the highest bound;
   the kth score found there is propagated. Regions whose box can't reach it are pruned.
4. The second round joins blocks of queries with the shards that are left. The shards are in
   at most ``PARTS`` parts, and a block goes once to each part that a query of it can need, so
   copies of queries are bounded however many shards there are. Within a shard a query goes
   best first: nodes by box-to-query bound, until the bound is below the kth score. The
   shards' best rows are merged by one window for each query.

Components are whole numbers; scores are exact 64-bit sums (products beyond that wrap).

Defined results: a null vector, or one with a null or non-finite component, takes no part,
nor does a row with a null id; vectors of different lengths are compared as if the shorter
ended in zeros; rows that repeat an id are candidates of their own for other queries, and as
queries the smallest vector of the id is taken; a query's own id is never its candidate;
a query without candidates has no rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE, REGIONS = 4096, 512
SHARD_ROWS = 4096
LEAF = 64
QUERY_BLOCK = 1024
PARTS = 128
EXACT = 2.0 ** 52  # sums of products below this are exact as doubles, which have fast products


def whole_components(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled with zeros to ``dim``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    at = 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at:at + n]
        at += n
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest whole-number type that holds all of ``x``."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def kd_tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """(order, nodes, low, high): nodes are (start, end, left, right), left -1 for a leaf; boxes are tight."""
    order = np.arange(len(x))
    nodes, low, high, stack = [], [], [], [(0, len(x), -1, 0)]
    while stack:
        a, b, parent, side = stack.pop()
        me = len(nodes)
        own = x[order[a:b]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        low.append(lo)
        high.append(hi)
        nodes.append([a, b, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if b - a > leaf and (hi > lo).any():
            axis = int((hi - lo).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            stack += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
    return order, [tuple(n) for n in nodes], np.array(low), np.array(high)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): the most that an inner product with a point of the box can be."""
    if low.size and q.size and float(np.abs(q).max()) * float(max(np.abs(low).max(), np.abs(high).max())) * q.shape[1] < EXACT:
        q, low, high = q.astype(np.float64), low.astype(np.float64), high.astype(np.float64)
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def search(q: np.ndarray, own: np.ndarray, least: np.ndarray, tree: tuple, x: np.ndarray, ids: np.ndarray, k: int):
    """For each query (scores, ids) of its k best in the shard; ``least``: a score the kth of all reaches."""
    nodes, low, high = tree
    bound = bounds(q, low, high)
    if x.size and q.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        x, q = x.astype(np.float64), q.astype(np.float64)
    for i in range(len(q)):
        kth, score, found = int(least[i]), np.zeros(0, x.dtype), np.zeros(0, np.int64)
        row = bound[i]
        heap = [(-row[0], 0)]
        while heap:
            up, n = heapq.heappop(heap)
            if -up < kth:
                break
            a, b, left, right = nodes[n]
            if left >= 0:
                for child in (left, right):
                    if row[child] >= kth:
                        heapq.heappush(heap, (-row[child], child))
                continue
            s = x[a:b] @ q[i]
            ok = np.flatnonzero((s >= kth) & (ids[a:b] != own[i]))
            if len(ok):
                score, found = np.concatenate([score, s[ok]]), np.concatenate([found, ids[a + ok]])
                top = best(score, found, k)
                score, found = score[top], found[top]
                if len(score) == k:
                    kth = max(kth, int(score[-1]))
        yield score.astype(np.int64), found


def regions_of(sample: np.ndarray, n: int) -> list:
    """Median splits of the sample into at most ``n`` regions: [axis, cut, left, right] or a region's number."""
    root: list = [None]
    heap, count, done = [(-len(sample), 0, sample, root, 0)], 0, 0
    while heap:
        _, _, x, parent, side = heapq.heappop(heap)
        axis = int((x.max(axis=0) - x.min(axis=0)).argmax()) if x.size else 0
        cut = float(np.median(x[:, axis])) if x.size else 0.0
        left = x[:, axis] < cut if x.size else np.zeros(len(x), bool)
        if done + len(heap) + 1 >= n or len(x) < 8 or not left.any():
            parent[side] = done
            done += 1
            continue
        parent[side] = node = [axis, cut, None, None]
        for s, rows in ((2, x[left]), (3, x[~left])):
            count += 1
            heapq.heappush(heap, (-len(rows), count, rows, node, s))
    return root[0]


def region(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, int):
        return np.full(len(x), node, dtype=np.int32)
    left = x[:, node[0]] < node[1]
    out = np.empty(len(x), dtype=np.int32)
    out[left], out[~left] = region(node[2], x[left]), region(node[3], x[~left])
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best of all other rows for each row that ``queries`` holds for."""
    v = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    v = v.select(F.col(id_col).cast("long").alias("id"), whole_components(F.col(vector_col), scale).alias("x"),
                 F.coalesce(queries, F.lit(False)).alias("is_query"))
    v = materialize(v, "knn-vectors")
    n, dim = v.agg(F.count("*"), F.max(F.size("x"))).first()
    dim = max(dim or 0, 1)
    few = v.select("x").orderBy(F.xxhash64("id", "x")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    tree = regions_of(_matrix(few, dim), max(1, min(REGIONS, -(-n // SHARD_ROWS))))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(region(tree, _matrix(b.column(1), dim)))],
                                             ["id", "x", "is_query", "region"])

    v = materialize(v.mapInArrow(locate, "id long, x array<long>, is_query boolean, region int"), "knn-regions")
    # a row for each region, of which there are REGIONS at most: how many shards it has
    counts = {r.region: -(-r["count"] // SHARD_ROWS) for r in v.groupBy("region").count().collect()}
    salts = F.create_map(*[F.lit(y) for r, s in counts.items() for y in (r, s)]) if counts else F.create_map(F.lit(0), F.lit(1))
    names = sorted(counts)
    before = dict(zip(names, np.cumsum([0] + [counts[r] for r in names]).tolist()))
    total = sum(counts.values())
    n_parts = min(PARTS, total)

    def part(r: int, salt: int) -> int:
        return (before[r] + salt) * n_parts // total

    members = [[i for i, r in enumerate(names) if part(r, 0) <= p <= part(r, counts[r] - 1)] for p in range(n_parts)]
    shard = F.pmod(F.xxhash64("id", "x"), salts[F.col("region")].cast("long")).cast("int")

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("x").combine_chunks(), dim)
        order, nodes, low, high = kd_tree(x, LEAF)
        x = _small(x[order])
        boxes = [_small(low), _small(high)]
        r, salt = table.column("region")[0].as_py(), table.column("salt")[0].as_py()
        return pa.table({
            "region": pa.array([r], pa.int32()), "salt": pa.array([salt], pa.int32()), "part": pa.array([part(r, salt)], pa.int32()),
            "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()),
            "nodes": pa.array([np.array(nodes, dtype=np.int32).tobytes()], pa.binary()),
            "low": pa.array([boxes[0].tobytes()], pa.binary()), "high": pa.array([boxes[1].tobytes()], pa.binary()),
            "kinds": pa.array(["".join(a.dtype.char for a in (x, *boxes))]),
            "box": pa.array([np.stack([low[0], high[0]]).astype(np.int64).tobytes()], pa.binary())})

    shards = v.select("id", "x", "region", shard.alias("salt")).groupBy("region", "salt").applyInArrow(
        build, "region int, salt int, part int, ids binary, x binary, nodes binary, low binary, high binary, kinds string, box binary")
    shards = materialize(shards, "knn-shards")
    boxes = region_boxes(shards, dim)

    def deal(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """A row for each block of queries and region of their highest bound (first), or part with a box that reaches their kth score."""
        low, high = (np.array([boxes[r][s] for r in names]) for s in (0, 1))
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                b = batch.slice(at, QUERY_BLOCK)
                own, x, least = b.column(0).to_numpy(), _matrix(b.column(1), dim), b.column(2).to_numpy()
                up = bounds(x, low, high)
                if first:
                    to = up.argmax(axis=1)
                    rows = ((names[i], np.flatnonzero(to == i)) for i in np.unique(to))
                else:
                    reach = up >= least[:, None]
                    rows = ((p, np.flatnonzero(reach[:, m].any(axis=1))) for p, m in enumerate(members))
                for key, i in rows:
                    if len(i):
                        q = _small(x[i])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (own[i], q, least[i])),
                             pa.array([q.dtype.char])], ["to", "own", "q", "least", "kind"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                c = {f: b.column(f)[row] for f in b.schema.names}
                ids, own, least = (np.frombuffer(c[f].as_py(), dtype=np.int64) for f in ("ids", "own", "least"))
                kinds = c["kinds"].as_py()
                x, low, high = (np.frombuffer(c[f].as_py(), dtype=t).reshape(-1, dim) for f, t in zip(("x", "low", "high"), kinds))
                nodes = np.frombuffer(c["nodes"].as_py(), dtype=np.int32).reshape(-1, 4).tolist()
                q = np.frombuffer(c["q"].as_py(), dtype=c["kind"].as_py()).reshape(-1, dim).astype(np.int64)
                got = list(search(q, own, least, (nodes, low, high), x, ids, k))
                sizes = [len(s) for s, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([f for _, f in got])),
                     pa.array(np.concatenate([s for s, _ in got]))], ["query_id", "id", "score"])

    def round_of(q: DataFrame, first: bool) -> DataFrame:
        dealt = q.coalesce(max(1, -(-n_queries // QUERY_BLOCK))).mapInArrow(
            lambda it: deal(it, first), "to int, own binary, q binary, least binary, kind string")
        into = shards.where("salt = 0").withColumn("to", F.col("region")) if first else shards.withColumn("to", F.col("part"))
        # Spark's estimate of the dealt blocks is the queries' own size, without their copies: they must never be broadcast
        pairs = dealt.hint("merge").join(into.drop("box", "region", "salt", "part"), "to")
        return pairs.drop("to").mapInArrow(answer, "query_id long, id long, score long")

    low_end = -(2 ** 63)
    q = v.where("is_query").groupBy("id").agg(F.min("x").alias("x"))
    q = materialize(q.withColumn("least", F.lit(low_end).cast("long")), "knn-queries")
    n_queries = q.count()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    seen = round_of(q, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    seen = seen.select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    q = materialize(q.join(seen, "id", "left").select("id", "x", F.coalesce("kth", "least").alias("least")), "knn-bounded")
    found = round_of(q, False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def region_boxes(shards: DataFrame, dim: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Box of each region: made of its shards' boxes, a row for each region (``REGIONS`` at most) to the driver."""

    def join(table: pa.Table) -> pa.Table:
        b = np.stack([np.frombuffer(x.as_py(), dtype=np.int64).reshape(2, dim) for x in table.column("box")])
        box = np.stack([b[:, 0].min(axis=0), b[:, 1].max(axis=0)])
        return pa.table({"region": table.column("region").slice(0, 1), "box": pa.array([box.tobytes()], pa.binary())})

    rows = shards.select("region", "box").groupBy("region").applyInArrow(join, "region int, box binary").collect()
    return {r.region: tuple(np.frombuffer(r.box, dtype=np.int64).reshape(2, dim)) for r in rows}
