"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns
of ``documents``; the last one adds the columns of the mix. ``run`` writes each stage's result
to the shared folder and hands the table that it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language_id, line_dedup, mixing, simhash
from ledgerline.llm.common import materialize


def keep_told_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: no letter, or a calibrated probability under the threshold."""
    told = language_id.predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text"),
                               language_id.train(docs))
    return told.where("not rejected").select("_doc.*")


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that a smaller doc_id holds."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def keep_one_of_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 3 bits, the smallest doc_id's document stays."""
    return simhash.keep_one(docs, shingle=3, max_distance=3)


def drop_benchmark_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap an item of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and the words taken."""
    return mixing.mixed_documents(docs)


STAGES = [("language-id", keep_told_languages), ("line-dedup", drop_repeated_lines),
          ("near-duplicates", keep_one_of_near_duplicates), ("decontamination", drop_benchmark_passages),
          ("mixing", mix_sources)]

# The stages hash and learn in ways that SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
