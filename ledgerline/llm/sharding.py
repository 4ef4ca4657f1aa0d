"""Operator 11: byte-balanced shards by histogram sort.

Rows are sorted by a key of 48 hex digits: 16 of the text's MD5, so that equal texts adjoin, 16 of the
id's and 16 of a row number's, so that no two rows are alike. Splitters are found by probing: a round
counts the exact bytes below ``16 ** PROBE_DIGITS`` candidate boundaries of each interval that still
holds a splitter (one aggregation over keys and sizes), keeps the boundary nearest to the target once it
is within ``tolerance`` of a shard's share, and otherwise narrows the interval to the cell that holds the
target. Where a group of equal texts straddles a target by more than the tolerance, the probes go on
inside the group; a splitter that no boundary satisfies falls on the nearest row's. Then the rows
move in a single exchange, which numbers them by key within their shard.

The exchange deals rows by (shard, chunk), a chunk being a prefix of the key. A prefix that holds far
more rows than its like is a hot group of equal texts; it goes on to the id's digits, and to the row
number's where rows repeat, so no task holds a whole shard or group. The rows of a shard before a chunk
come from the chunks' counts.

Defined results: law ``bytes`` holds for every row, ``grown_shard`` is null; a null text is a text of no
bytes (size 1, CRC 0), a null id sorts as the empty one; repeated rows are rows of their own, in any order
among each other; a text that is larger than a shard's share leaves neighbours short or empty; an empty table
gives no rows; of a kept column with a name of the result's, the result's stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_row

TOLERANCE = 0.005  # of a shard's share of all bytes
PROBE_DIGITS = 3
PART = 16  # hex digits of each part of the key
KEY = 3 * PART
CHUNK_ROWS = 512  # rows that a chunk holds about, until there are 16 ** MAX_CHUNK_DIGITS of them
MAX_CHUNK_DIGITS = 5
HOT = 8  # a chunk with so many times its like is split further
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _digits(c: Column) -> Column:
    return F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, PART)


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None) -> DataFrame:
    """(_doc, size, text_crc32, key) written once: row numbers must not change between rounds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.columns if keep is None else keep
    key = F.concat(_digits(text), _digits(F.col(id_col)), _digits(F.monotonically_increasing_id()))
    rows = docs.select(whole_row(docs, tuple({c for c in docs.columns if c not in kept} | set(OWN))),
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       key.alias("key"))
    return materialize(rows, "shard-keys")


def splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """``n_shards`` - 1 ascending boundaries of ``keys`` (key, size): a row's shard is the number of those that are not above its key.

    A round collects at most 16 ** PROBE_DIGITS cells for each splitter that is still open.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    share = total / n_shards
    found: dict[int, str] = {}
    still_open = {i: ("", 0) for i in range(1, n_shards)}  # splitter: (prefix of its interval, bytes below that)
    depth = 0
    while still_open:
        prefixes, depth_before, depth = sorted({p for p, _ in still_open.values()}), depth, depth + PROBE_DIGITS
        inside = keys if depth_before == 0 else keys.where(F.substring("key", 1, depth_before).isin(prefixes))
        counted = inside.groupBy(F.substring("key", 1, depth).alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        cells: dict[str, list] = {p: [] for p in prefixes}
        for cell, size, n in sorted(tuple(r) for r in counted.collect()):
            cells[cell[:depth_before]].append((cell, size, n))
        for i, (prefix, below) in list(still_open.items()):
            target, at, edges, inner = share * i, below, [], None
            for cell, size, n in cells[prefix]:
                edges.append((abs(at - target), at, cell))
                if at < target < at + size:
                    inner = (cell, at, n)
                at += size
            edges.append((abs(at - target), at, prefix + "g"))  # above every key that starts with the prefix
            error, _, edge = min(edges)
            if error <= tolerance * share or inner is None or inner[2] == 1 or depth >= KEY:
                found[i] = edge
                del still_open[i]
            else:
                still_open[i] = inner[:2]
    return [found[i] for i in sorted(found)]


def _chunked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``chunk``; ``keys`` are the same rows, as written. Chunks hold at most about HOT times their like."""
    n = keys.count()
    digits = min(MAX_CHUNK_DIGITS, max(1, math.ceil(math.log(max(n, 1) / CHUNK_ROWS, 16))))
    limit = max(CHUNK_ROWS, HOT * n // 16 ** digits)
    chunk = F.substring("key", 1, digits)
    rows, keys = rows.withColumn("chunk", chunk), keys.select("key").withColumn("chunk", chunk)
    for part in (1, 2):
        counts = keys.groupBy("chunk").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
        hot = materialize(counts.select(F.col("chunk").alias("_hot")), "shard-hot")
        if hot.isEmpty():
            break
        # n / limit rows at most, so at most 16 ** MAX_CHUNK_DIGITS / HOT of them
        deeper = F.when(F.col("_hot").isNotNull(), F.substring("key", 1, part * PART + digits)).otherwise(F.col("chunk"))
        rows, keys = (x.join(F.broadcast(hot), F.col("chunk") == F.col("_hot"), "left").withColumn("chunk", deeper).drop("_hot")
                      for x in (rows, keys))
        keys = keys.where(F.length("chunk") > (part - 1) * PART + digits)  # only what was hot can be hot again
    return rows


def shard_rows(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
               tolerance: float = TOLERANCE) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with size, text_crc32, law, shard, slot and grown_shard."""
    keys = keyed(docs, id_col, text_col, keep)
    shard = F.lit(0)
    for edge in splitters(keys.select("key", "size"), n_shards, tolerance):
        shard = shard + (F.col("key") >= edge).cast("int")
    rows = _chunked(keys.withColumn("shard", shard), keys.select("key"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("_n"))
    counts = materialize(counts.select("shard", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "shard-chunks")
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("key"))
    placed = rows.withColumn("_nth", nth).join(counts, ["shard", "chunk"])
    return placed.select("_doc.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("_before") + F.col("_nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the sharded rows in folders ``shard=<n>`` (order by ``slot`` within one) and read them back."""
    shard_rows(docs, **options).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
