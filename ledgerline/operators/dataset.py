"""Dataset construction (D1-D9): split, names, JSON targets, manifest, order.

The split is a hash of a stable key, not a random draw, so a retried task or
a rerun puts every page in the same split; ``by="file"`` keeps all pages of a
statement together (no leakage between train and validation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import GT_SCHEMA, INFO_PAGE

c = F.col

# Split weights of the target format (train / validation).
TRAIN_FRACTION = 0.8


def page_key() -> Column:
    return F.concat_ws("#", c("file"), c("page_idx").cast("string"))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """0..buckets-1 from the first 32 bits of md5(key); same value in DuckDB."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def assign_split(df: DataFrame, train: float = TRAIN_FRACTION, by: str = "page") -> DataFrame:
    """D1: 'train' / 'validation' by hash bucket of the page (or file) key."""
    key = page_key() if by == "page" else c("file")
    cut = int(round(train * 100))
    return df.withColumn("split", F.when(hash_bucket(key) < cut, F.lit("train")).otherwise(F.lit("validation")))


def pn_text() -> Column:
    return F.when(c("is_info"), F.lit(INFO_PAGE)).otherwise(c("pn").cast("string"))


def image_name(df: DataFrame) -> DataFrame:
    """images/<vendor>_<page number>_<md5 of page key>.jpg, stable across retries."""
    name = F.concat(F.lit("images/"), c("vendor"), F.lit("_"), pn_text(), F.lit("_"),
                    F.substring(F.md5(page_key()), 1, 16), F.lit(".jpg"))
    return df.withColumn("file_name", name)


def gt_struct() -> Column:
    """The `gt_parse` object of one page record, fields in code order."""
    fields = []
    for f in GT_SCHEMA.fields:
        if f.name == "pn":
            fields.append(pn_text().alias("pn"))
        elif f.dataType.simpleString().startswith("struct"):
            fields.append(c(f.name).alias(f.name))
        else:
            fields.append(c(f.name).cast("string").alias(f.name))
    return F.struct(*fields)


def ground_truth(df: DataFrame) -> DataFrame:
    """D3: ground_truth = JSON text of {"gt_parse": record}; NULL fields dropped.

    Page numbers are JSON numbers and the info page the string "info", as in
    the target format; everything else follows ``to_json``.
    """
    js = F.to_json(F.struct(gt_struct().alias("gt_parse")))
    js = F.regexp_replace(js, r'"pn":"(\d+)"', '"pn":$1')
    return df.withColumn("ground_truth", js)


def metadata(accepted: DataFrame, by: str = "page") -> DataFrame:
    """metadata(split, file_name, ground_truth) + manifest columns."""
    df = image_name(ground_truth(assign_split(accepted, by=by)))
    return df.withColumn("page_number", (c("page_idx") + 1).cast("int"))


def manifest(meta: DataFrame, base_dir: str = "dataset") -> DataFrame:
    """manifest(src, dest, page_number); page_number is 1-based position."""
    return meta.select(c("file").alias("src"),
                       F.concat_ws("/", F.lit(base_dir), c("split"), c("file_name")).alias("dest"),
                       "page_number")


def shuffle_key(id_col: Column, epoch: Column | int, seed: int = 42) -> Column:
    """Per-epoch pseudo-random order key (hex md5 of id, epoch, seed)."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.md5(F.concat_ws("|", id_col.cast("string"), e.cast("string"), F.lit(str(seed))))


class PositionIndex:
    """0-based position of every row in ``order``, without a one-task window.

    Only the order's columns are sorted: range-partitioned, sorted and written
    once to the checkpoint folder, so that the positions are fixed. A key's
    position is its partition's offset (a running sum over one count for each
    partition) plus its place inside the partition; rows take theirs by a join
    on the key. ``order`` must be unique per row (add key columns as tie-breaks).
    """

    def __init__(self, df: DataFrame, order: list[Column]):
        from ..session import materialize
        self.names = [f"_o{i}" for i in range(len(order))]
        self.df = df.withColumns(dict(zip(self.names, order)))
        keys = self.df.select(*self.names).orderBy(*self.names).withColumn("_mid", F.monotonically_increasing_id())
        self.keys = materialize(keys, "index")
        self.offsets = _offsets(self.keys)

    @property
    def n_rows(self) -> int:
        return self.offsets.agg(F.max(c("_off") + c("_n"))).first()[0] or 0

    def positions(self, name: str) -> DataFrame:
        return _placed(self.keys, self.offsets).select(*self.names, c("_at").alias(name))

    def attach(self, name: str = "row_idx", where: Column | None = None) -> DataFrame:
        """The rows with their position; ``where`` picks positions before any row is touched."""
        pos = self.positions(name)
        pos = pos if where is None else pos.filter(where)
        pos = pos.select(*[c(n).alias("p" + n) for n in self.names], name)
        same = [c(n).eqNullSafe(c("p" + n)) for n in self.names]
        return self.df.join(pos, same).drop(*self.names, *["p" + n for n in self.names])

    def row(self, position: int, name: str = "row_idx") -> DataFrame:
        """One row: its partition of keys is found by the offsets, its key picks it."""
        off = self.offsets.filter((c("_off") <= position) & (c("_off") + c("_n") > position)).first()
        if off is None:
            return self.attach(name, F.lit(False))
        key = self.keys.filter(c("_mid") == off["_first"] + position - off["_off"]).first()
        same = [c(n).eqNullSafe(F.lit(key[n])) for n in self.names]
        return self.df.filter(_all(same)).withColumn(name, F.lit(position).cast("bigint")).drop(*self.names)


def _offsets(table: DataFrame) -> DataFrame:
    """One row for each partition that ``table`` was written with: its number of rows and those before them."""
    pid = F.shiftright("_mid", 33)
    counts = table.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def _placed(table: DataFrame, offsets: DataFrame) -> DataFrame:
    """``table`` with the position ``_at``; the offsets, a row for each partition, are broadcast."""
    placed = table.withColumn("_pid", F.shiftright("_mid", 33)).join(F.broadcast(offsets), "_pid")
    return placed.withColumn("_at", c("_off") + c("_mid") - c("_first"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out & x
    return out


def global_index(df: DataFrame, order: list[Column], name: str = "row_idx") -> DataFrame:
    """``df`` with the position of every row in ``order`` (see ``PositionIndex``).

    Where the order holds all of the rows' columns, a row is nothing but its key: the rows
    themselves are dealt by ranges of the order, sorted and written once, and none is joined
    back. What else the order has (a hash of the key) is computed on either side of the one
    exchange and neither shuffled nor written. Rows that repeat are counted in their sorted
    range; each comes with each of their positions, as by the join.
    """
    if not set(df.columns) <= set(df.select(*order).columns):
        return PositionIndex(df, order).attach(name)
    from ..session import lean_disk, materialize
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.repartitionByRange(*order).withColumns(dict(zip(names, order)))
    rows = rows.withColumn("_alike", F.count(F.lit(1)).over(Window.partitionBy(*names)).cast("int")).sortWithinPartitions(*names)
    with lean_disk(df.sparkSession):
        rows = materialize(rows.drop(*names).withColumn("_mid", F.monotonically_increasing_id()), "index")
    placed = _placed(rows, _offsets(rows)).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), c("_alike"))))
    return placed.select(*df.columns, c("_at").alias(name))


def batches(df: DataFrame, order: list[Column], batch_size: int = 1) -> DataFrame:
    """Consecutive mini-batches of ``batch_size`` over a global order."""
    idx = global_index(df, order)
    return idx.withColumn("batch", F.floor(c("row_idx") / F.lit(batch_size)).cast("bigint"))


def row_at(df: DataFrame, order: list[Column], position: int) -> DataFrame:
    """Random access by position."""
    return PositionIndex(df, order).row(position)
