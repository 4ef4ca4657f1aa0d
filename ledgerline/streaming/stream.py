"""Streaming build: new documents arriving in a folder -> metadata per micro-batch.

The reference walks folders once; this is the continuous form. Pages of one
document must be seen together (telecom's page-2 check needs page 1), so the
stream reads whole documents (``wholetext``) and each micro-batch runs the
same batch build in ``foreachBatch`` (the file-level aggregation is not a
time window, which a stream cannot run directly). Each batch owns the folder
``batch=<id>`` of ``metadata`` (under ``split=``) and ``rejects`` and
overwrites it, so a batch that is run again after a failure replaces its rows
instead of adding them again. The intermediate records of a batch are deleted
after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import vendors as V
from ..plans import build as B
from ..session import _write_table, delete_path
from ..sources.pages import PAGE_BREAK

c = F.col


def stream_pages(spark: SparkSession, path: str, vendor: str, glob: str = "*.txt",
                 max_files_per_trigger: int = 1000) -> DataFrame:
    """Documents under ``path``, nested folders too; ``max_files_per_trigger`` is a rate, no file is left out."""
    raw = (spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", max_files_per_trigger).text(path, wholetext=True))
    return raw.select(F.lit(vendor).alias("vendor"), c("_metadata.file_path").alias("file"),
                      F.posexplode_outer(F.split("value", PAGE_BREAK)).alias("page_idx", "text")) \
        .withColumn("page_idx", c("page_idx").cast("int"))


def build_batch(batch: DataFrame, batch_id: int, out_path: str, vendors: list[str] | None = None) -> None:
    """One micro-batch's build: metadata and rejected files (vendor, file, reason) into the batch's own folders."""
    spark = batch.sparkSession
    recs_path = _write_table(V.extract_records(batch, vendors), "stream-records")
    b = B.build_from_pages(None, vendors, records=spark.read.parquet(recs_path))
    folder = f"batch={batch_id}"
    b.metadata.select("split", "file_name", "ground_truth").write.mode("overwrite") \
        .partitionBy("split").json(f"{out_path}/metadata/{folder}")
    R.reasons_table(b.verdicts).write.mode("overwrite").json(f"{out_path}/rejects/{folder}")
    delete_path(spark, recs_path)


def start_build_stream(pages: DataFrame, out_path: str, checkpoint: str, vendors: list[str] | None = None,
                       trigger_once: bool = False):
    """Run the build on each micro-batch and write its metadata and rejects."""
    w = pages.writeStream.foreachBatch(lambda batch, i: build_batch(batch, i, out_path, vendors)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
