"""Operator 6: line dedup over levelled sorted runs of line hashes.

The documents are taken in batches of ascending doc_id. The distinct line hashes of a batch
are merge-joined with the runs of the batches before it: a hash that a run holds belongs to
that run's document, the others (the anti-join) are the batch's own new run. Runs are
bucketed and sorted by hash; when a level holds ``FANOUT`` runs they are compacted into one
run of the next level, so a batch meets a logarithmic number of runs.

A line's key is the line without white space at its ends, A-Z lower-cased; keys under
``MIN_KEY`` code points are never dropped. The key's hash has 128 bits (two XXH64 of the key).
Every other key found in two or more documents stays only in the smallest doc_id holding it.

Defined results: a null or empty text is one empty line (a null text stays null); a null doc_id counts as one document
after all others; rows that repeat a doc_id are the same document, and each keeps or drops
its lines alike; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import delete_path

from .common import STRIP_CHARS, ascii_lower, materialize, row_key, shared_path, whole_row

MIN_KEY = 10
BATCHES = 4
FANOUT = 2
HASH = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP_CHARS)))


class Runs:
    """Levelled runs (h1, h2, owner, owner_null): bucketed, sorted tables in the shared folder."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [[]], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", shared_path(self.spark, name))
         .format("parquet").saveAsTable(name))
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        """Forget the tables and delete their files, once no plan reads them any more."""
        for name in self.names:
            path = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {name}")
            delete_path(self.spark, path)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the owner that a run holds for the hash; runs share no hash."""
        for run in (r for level in self.levels for r in level):
            found = run.select(*HASH, F.col("owner").alias("_owner"), F.lit(True).alias("_there"))
            keys = keys.join(found, HASH, "left").withColumn(
                "seen", F.coalesce(F.col("_there"), F.col("seen"))).withColumn(
                "owner", F.when(F.col("_there"), F.col("_owner")).otherwise(F.col("owner"))).drop("_owner", "_there")
        return keys

    def add(self, df: DataFrame, compact: bool = True) -> None:
        self.levels[0].append(self._write(df.repartition(self.buckets, *HASH)))
        level = 0
        while compact and len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0]
            for run in self.levels[level][1:]:
                merged = merged.unionByName(run)
            self.levels += [[]] * (level + 2 > len(self.levels))
            self.levels[level + 1].append(self._write(merged.repartition(self.buckets, *HASH)))
            self.levels[level] = []
            level += 1


def hashed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body, pos, h1, h2) of every line whose key counts; ``body`` tells rows of one id apart."""
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("body"),
                        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= MIN_KEY)
    return lines.select("id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))


def owners(lines: DataFrame, n_batches: int, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, owner) of every hash found in two or more documents; ``lines`` has ``batch``."""
    runs, shared = Runs(lines.sparkSession, fanout), None
    doc = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))  # null after all ids
    for b in range(n_batches):
        keys = lines.where(F.col("batch") == b).groupBy(*HASH).agg(F.min(doc).alias("owner"), F.max(doc).alias("most"))
        keys = keys.withColumn("many", ~F.col("owner").eqNullSafe(F.col("most"))).drop("most").withColumn("seen", F.lit(False))
        looked = materialize(runs.look_up(keys), "line-batch")
        if b < n_batches - 1:
            runs.add(looked.where("not seen").select(*HASH, "owner"), compact=b < n_batches - 2)
        hits = looked.where("seen or many").select(*HASH, "owner")
        shared = hits if shared is None else shared.unionByName(hits)
    runs.drop()  # every batch's look-up is written
    return shared.groupBy(*HASH).agg(F.min("owner").alias("owner"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_batches: int = BATCHES) -> DataFrame:
    """``docs`` with the text's lines that stay, joined by a line feed; n_lines and n_dropped are added (or replaced)."""
    # equal batches by id; the bounds are approximate quantiles, the batches any split in order of id
    parts = [i / n_batches for i in range(1, n_batches)]
    cuts = docs.agg(F.percentile_approx(id_col, parts, 1000).alias("c")).first()["c"] or []
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.coalesce(F.col("id") > F.lit(c), F.lit(True))).cast("int")
    path = shared_path(docs.sparkSession, "lines")
    hashed_lines(docs, id_col, text_col).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema("id long, body long, pos int, h1 long, h2 long, batch int").parquet(path)
    # a table of its own: AQE splits the lines of a hot hash only where both sides are plain shuffles
    owner = materialize(owners(lines, n_batches), "line-owners")
    drops = lines.join(owner, HASH).where(~F.col("id").eqNullSafe(F.col("owner.id")))
    drops = drops.groupBy(row_key(F.col("id"), F.col("body"))).agg(F.collect_set("pos").alias("_drop"))
    own = (text_col, "n_lines", "n_dropped")
    rows = docs.select(row_key(F.col(id_col).cast("long"), F.xxhash64(text_col)), F.col(text_col).alias("_text"), whole_row(docs, own))
    rows = rows.join(drops, "_key", "left").withColumn("_lines", split_lines(F.col("_text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    return rows.select("_doc.*", kept.alias(text_col), F.size("_lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
