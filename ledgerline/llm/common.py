"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir, materialize, row_batches

__all__ = ["ascii_lower", "chunk_bits", "materialize", "row_batches", "row_key", "running_sum", "shared_path", "text_words",
           "whole_row", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"
STRIP_CHARS = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` in the folder that driver and executors share."""
    import uuid

    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def text_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes.split() splits at exactly \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8").lower().split() if text else []


def chunk_bits(rows: int) -> int:
    """Bits of a two-level prefix: about sqrt(rows) chunks of sqrt(rows) rows each."""
    return max(1, math.ceil(math.log2(max(rows, 2)) / 2))


def running_sum(df: DataFrame, part: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of ``part`` before this one in (``chunk``, ``order``).

    Two levels, so that a hot ``part`` never meets in one task: rows are summed within
    (part, chunk) and the chunk totals, one row each, within part.
    """
    totals = df.groupBy(*part, chunk).agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(w), F.lit(0))).drop("_total")
    inner = Window.partitionBy(*part, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [rows[k].eqNullSafe(totals[k]) for k in [*part, chunk]]
    keep = [rows[c] for c in df.columns]
    return rows.join(totals, on).select(*keep, (F.col("_base") + F.col("_within")).alias(out))


def whole_row(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A row's columns as one struct ``_doc``: whatever their names, none clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("_doc")


def row_key(id_col: Column, body: Column) -> Column:
    """Key of a document by id and XXH64 of its text, never null; alike for rows that repeat."""
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("-")), body.cast("string")).alias("_key")
