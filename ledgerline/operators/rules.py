"""Validation and reconciliation (V1-V12) as data, not aborts.

Every check is a boolean column. Page-local checks are computed by the
extractors (``e_<reason>``); file-level checks come from one aggregation by
file over the narrow page records, using only decomposable aggregates
(count, count_if, bool_or, max). Map-side partial aggregation therefore
combines a file's pages before the shuffle, so even a file holding a large
share of all pages costs one partial row per map task, never a collected
group. A file is rejected when any of its checks fails (file-level
atomicity, as in the target format where one bad page stops its file).

``strict`` turns any reject into a query failure via ``raise_error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vendors import PAGE_REASONS, REASONS

c = F.col


def _reason_list(flags: dict[str, Column]) -> Column:
    """Comma-joined reason codes in code order, '' when none."""
    return F.concat_ws(",", *[F.when(flags[r], F.lit(r)) for r in REASONS if r in flags])


def file_verdicts(records: DataFrame, extra_aggs: list[Column] | None = None) -> DataFrame:
    """One row per file: vendor, file, n_pages, n_records, reasons, ok.

    V8 (records per file = pages per file) and V9 (a file yields records) are
    file-level; a page that an extractor dropped is still a row here (not
    kept), so both count source pages. The telecom cross-page balance (V4)
    compares page 1's new balance with the sum of page 2's parts; both are
    carried as minimum and maximum, so that each of several page 1s or page
    2s must agree.
    """
    aggs = [F.count(F.lit(1)).alias("n_pages"),
            F.count_if(c("kept")).alias("n_records")]
    aggs += [F.bool_or(c(f"e_{r}")).alias(f"e_{r}") for r in PAGE_REASONS]
    aggs += [F.bool_or(c("xp_has_parts")).alias("xp_has_parts"),
             F.min("xp_parts").alias("xp_parts"), F.max("xp_parts").alias("xp_parts_max"),
             F.min("xp_total").alias("xp_total"), F.max("xp_total").alias("xp_total_max")]
    extra = extra_aggs or []
    aggs += extra
    g = records.groupBy("vendor", "file").agg(*aggs)
    flags = {r: c(f"e_{r}") for r in PAGE_REASONS}
    differ = (c("xp_parts") != c("xp_total")) | (c("xp_parts_max") != c("xp_total")) | (c("xp_total_max") != c("xp_total"))
    cross = F.coalesce(c("xp_has_parts") & differ, F.lit(False))
    flags["balance_mismatch"] = flags["balance_mismatch"] | cross
    flags["page_count"] = c("n_records") != c("n_pages")
    flags["empty_file"] = c("n_records") == 0
    reasons = _reason_list(flags)
    internal = {"vendor", "file", "n_pages", "n_records", "xp_has_parts", "xp_parts", "xp_total",
                "xp_parts_max", "xp_total_max"}
    internal |= {f"e_{r}" for r in PAGE_REASONS}
    carried = [x for x in g.columns if x not in internal]
    return g.select("vendor", "file", "n_pages", "n_records", *carried, reasons.alias("reasons"),
                    (reasons == F.lit("")).alias("ok"))


def page_reasons(records: DataFrame) -> DataFrame:
    """Per page: reasons raised by the page itself (V1-V3, V5-V7)."""
    flags = {r: c(f"e_{r}") for r in PAGE_REASONS}
    return records.withColumn("page_reasons", _reason_list(flags))


def split_accepted(records: DataFrame, verdicts: DataFrame,
                   rows_per_split: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(accepted page records, rejected page records with file reasons).

    Joined on (vendor, file, salt). A file with more than ``rows_per_split``
    pages is split: its pages take salt ``page_idx % n_salt`` and its one
    verdict row is repeated once per salt, so no join task receives more
    than about ``rows_per_split`` pages of one file. Other files keep salt 0
    and pay nothing extra. The hot-file list, at most one row for each
    ``rows_per_split`` pages, is broadcast, so that the pages are shuffled for
    the verdicts only. The verdict side is not hinted: Spark broadcasts it
    only when its size check (static estimate or AQE's measured size) passes;
    otherwise sort-merge.
    """
    hot = verdicts.filter(c("n_pages") > rows_per_split).select(
        "vendor", "file", F.ceil(c("n_pages") / F.lit(rows_per_split)).cast("int").alias("n_salt"))
    hot = F.broadcast(hot)
    rec = records.filter(c("kept")).join(hot, ["vendor", "file"], "left") \
        .withColumn("_salt", F.when(c("n_salt").isNull(), F.lit(0)).otherwise(F.pmod(c("page_idx"), c("n_salt")))) \
        .drop("n_salt")
    ver = verdicts.select("vendor", "file", "reasons", "ok").join(hot, ["vendor", "file"], "left") \
        .withColumn("_salt", F.explode(F.when(c("n_salt").isNull(), F.array(F.lit(0)))
                                       .otherwise(F.sequence(F.lit(0), c("n_salt") - 1)))) \
        .drop("n_salt")
    j = rec.join(ver, ["vendor", "file", "_salt"]).drop("_salt")
    return j.filter(c("ok")).drop("reasons", "ok"), j.filter(~c("ok")).drop("ok")


def strict(verdicts: DataFrame) -> DataFrame:
    """Fail the query on the first rejected file (the reference's abort mode)."""
    msg = F.concat(F.lit("rejected "), c("file"), F.lit(": "), c("reasons"))
    return verdicts.withColumn("ok", F.when(c("ok"), F.lit(True)).otherwise(F.raise_error(msg).cast("boolean")))


def reasons_table(verdicts: DataFrame) -> DataFrame:
    """(vendor, file, reason): one row per failed check."""
    return verdicts.filter(~c("ok")).select(
        "vendor", "file", F.explode(F.split(c("reasons"), ",")).alias("reason"))


def rejects_by_reason(verdicts: DataFrame) -> DataFrame:
    return reasons_table(verdicts).groupBy("vendor", "reason").agg(F.count(F.lit(1)).alias("n_files"))


def nonempty_guard(df: DataFrame, what: str) -> None:
    """Refuse to write an empty result (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
