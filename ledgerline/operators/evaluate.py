"""Evaluation (E1-E13): edit distance, batch / epoch statistics, field accuracy.

Scores are a table ``scores(epoch, batch, key, type, score)``. Batch means
come first and epoch statistics are taken over batch means (the format's
two-level mean, which differs from the row mean when the last batch is
short). Epoch-level windows run over one row per epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import GT_SCHEMA
from . import dataset as D

c = F.col


NEAR_EDITS = 32
FEW_EDITS = 7


def edit_distance(pred: Column, answer: Column) -> Column:
    """Levenshtein distance. Equal texts need no table, and texts a few edits apart only the diagonals
    within ``FEW_EDITS`` or ``NEAR_EDITS`` of it (-1 beyond them); the whole table is filled for the rest."""

    def within(steps: list[Column]) -> Column:
        near = F.array(steps[0])  # an array's element is computed once, whatever refers to it
        if len(steps) == 1:
            return steps[0]
        return F.get(F.transform(near, lambda d: F.when(d >= 0, d).otherwise(within(steps[1:]))), F.lit(0))

    least = within([F.levenshtein(pred, answer, FEW_EDITS), F.levenshtein(pred, answer, NEAR_EDITS), F.levenshtein(pred, answer)])
    return F.when(pred == answer, F.lit(0)).otherwise(least)


def normed_edit_distance(pred: Column, answer: Column) -> Column:
    """Levenshtein / longer length; 0.0 when both are empty."""
    longest = F.greatest(F.length(pred), F.length(answer))
    return F.when(longest == 0, F.lit(0.0)).otherwise(
        F.try_divide(edit_distance(pred, answer).cast("double"), longest.cast("double")))


def pair(predictions: DataFrame, answers: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Predictions with their answers by key (outer joins report missing ones)."""
    return predictions.join(answers, on, how)


def batch_means(scores: DataFrame) -> DataFrame:
    """E3."""
    return scores.groupBy("epoch", "batch").agg(F.avg("score").alias("batch_mean"),
                                               F.count(F.lit(1)).alias("n"))


def epoch_stats(scores: DataFrame) -> DataFrame:
    """Mean / min / max of the batch means of each epoch."""
    return batch_means(scores).groupBy("epoch").agg(
        F.avg("batch_mean").alias("mean_score"), F.min("batch_mean").alias("min_score"),
        F.max("batch_mean").alias("max_score"), F.count(F.lit(1)).alias("n_batches"))


def running_mean(stats: DataFrame, value: str = "mean_score") -> DataFrame:
    """E5: mean over all epochs so far (one row per epoch)."""
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stats.select("epoch", c(value), F.avg(value).over(w).alias("running_mean"))


def gate(scores: DataFrame, start_epoch: int = 0, every: int = 2) -> DataFrame:
    """Only epochs from start_epoch on, every n-th epoch."""
    return scores.filter((c("epoch") >= start_epoch) & (((c("epoch") + 1) % every) == 0))


def early_stop(metrics: DataFrame, value: str, patience: int = 3, mode: str = "min") -> DataFrame:
    """Per checked epoch: best so far, checks since the last improvement, stop flag
    (first epoch where that count reaches ``patience``). Checks are counted, not epoch
    numbers: every second epoch checked makes one check of two epochs."""
    w_prev = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best_prev = F.min(value).over(w_prev) if mode == "min" else F.max(value).over(w_prev)
    better = (c(value) < c("_bp")) if mode == "min" else (c(value) > c("_bp"))
    df = metrics.select("epoch", c(value).alias(value)).withColumn("_bp", best_prev)
    df = df.withColumn("_check", F.row_number().over(Window.orderBy("epoch")))
    df = df.withColumn("improved", c("_bp").isNull() | better)
    df = df.withColumn("_last", F.max(F.when(c("improved"), c("_check"))).over(w_all))
    df = df.withColumn("since_best", (c("_check") - c("_last")).cast("int"))
    df = df.withColumn("best", F.min(value).over(w_all) if mode == "min" else F.max(value).over(w_all))
    first_stop = F.min(F.when(c("since_best") >= patience, c("epoch"))).over(Window.partitionBy(F.lit(1)))
    return df.withColumn("stop", F.coalesce(c("epoch") == first_stop, F.lit(False))) \
        .drop("_bp", "_last", "_check")


def flatten_fields(df: DataFrame, key_cols: list[str], gt: str, schema: T.StructType = GT_SCHEMA) -> DataFrame:
    """(keys, path, value) for every non-NULL leaf of a gt struct."""
    items = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                items.append(F.struct(F.lit(f"{f.name}.{g.name}").alias("path"),
                                      c(gt).getField(f.name).getField(g.name).cast("string").alias("value")))
        else:
            items.append(F.struct(F.lit(f.name).alias("path"), c(gt).getField(f.name).cast("string").alias("value")))
    arr = F.filter(F.array(*items), lambda x: x.getField("value").isNotNull())
    return df.select(*key_cols, F.explode(arr).alias("_f")).select(*key_cols, "_f.path", "_f.value")


def field_diff(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, truth_value, pred_value, kind) with kind in match / changed / missing / extra."""
    t = truth.withColumnRenamed("value", "truth_value")
    p = pred.withColumnRenamed("value", "pred_value")
    j = t.join(p, keys + ["path"], "full_outer")
    kind = (F.when(c("pred_value").isNull(), F.lit("missing"))
            .when(c("truth_value").isNull(), F.lit("extra"))
            .when(c("truth_value") == c("pred_value"), F.lit("match"))
            .otherwise(F.lit("changed")))
    return j.withColumn("kind", kind)


def _leaf_values(col: Column, schema: T.StructType) -> list[tuple[str, Column]]:
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                out.append((f"{f.name}.{g.name}", col.getField(f.name).getField(g.name).cast("string")))
        else:
            out.append((f.name, col.getField(f.name).cast("string")))
    return out


def field_diff_inline(df: DataFrame, keys: list[str], truth: str, pred: str,
                      schema: T.StructType = GT_SCHEMA) -> DataFrame:
    """Same rows as ``field_diff`` when truth and prediction sit in one row.

    Each leaf of the known schema is compared in place (an array of
    (path, truth, prediction) per row, exploded), so no join and no shuffle:
    the diff stays in the stage that produced the row.
    """
    t, p = dict(_leaf_values(c(truth), schema)), dict(_leaf_values(c(pred), schema))
    items = [F.struct(F.lit(path).alias("path"), t[path].alias("truth_value"), p[path].alias("pred_value"))
             for path in t]
    arr = F.filter(F.array(*items), lambda x: x.getField("truth_value").isNotNull() | x.getField("pred_value").isNotNull())
    out = df.select(*keys, F.explode(arr).alias("_f")).select(*keys, "_f.path", "_f.truth_value", "_f.pred_value")
    kind = (F.when(c("pred_value").isNull(), F.lit("missing"))
            .when(c("truth_value").isNull(), F.lit("extra"))
            .when(c("truth_value") == c("pred_value"), F.lit("match"))
            .otherwise(F.lit("changed")))
    return out.withColumn("kind", kind)


def field_accuracy(diff: DataFrame, keys: list[str]) -> DataFrame:
    """E8 (own definition): max(0, 1 - (missing + extra + changed) / truth fields)."""
    g = diff.groupBy(*keys).agg(
        F.count_if(c("truth_value").isNotNull()).alias("n_truth"),
        F.count_if(c("kind") != "match").alias("n_wrong"))
    return accuracy_of(g)


def row_accuracy(df: DataFrame, truth: str, pred: str, schema: T.StructType = GT_SCHEMA) -> DataFrame:
    """E8 of truth and prediction in one row, counted in the row: no explode, no shuffle.

    A document without a leaf on either side has accuracy 1.0: nothing was asked, nothing was wrong."""
    t, p = dict(_leaf_values(c(truth), schema)), dict(_leaf_values(c(pred), schema))
    n_truth = sum((t[x].isNotNull().cast("int") for x in t), F.lit(0))
    n_wrong = sum(((~t[x].eqNullSafe(p[x])).cast("int") for x in t), F.lit(0))
    return accuracy_of(df.withColumn("n_truth", n_truth).withColumn("n_wrong", n_wrong))


def accuracy_of(counts: DataFrame) -> DataFrame:
    acc = F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(c("n_wrong").cast("double"), c("n_truth").cast("double")))
    none = (c("n_wrong") == 0).cast("double")  # no truth leaf: right only if nothing was predicted
    return counts.withColumn("accuracy", F.when(c("n_truth") == 0, none).otherwise(acc))


def by_field(diff: DataFrame) -> DataFrame:
    """Per field path: share of truth fields predicted exactly."""
    return diff.filter(c("truth_value").isNotNull()).groupBy("path").agg(
        F.avg((c("kind") == "match").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def sample_every(df: DataFrame, order: list[Column], fraction: float = 0.2) -> DataFrame:
    """Every int(n * fraction)-th row by position (every row when n * p < 1)."""
    index = D.PositionIndex(df, order)  # its offsets hold the number of rows
    step = max(1, int(index.n_rows * fraction))
    return index.attach("row_idx", (c("row_idx") % step) == 0)


def bad_cases(scores: DataFrame, order_col: str, threshold: float = 0.5) -> DataFrame:
    """The first item of each batch when its score exceeds the threshold."""
    w = Window.partitionBy("epoch", "batch").orderBy(order_col)
    return scores.withColumn("_rn", F.row_number().over(w)) \
        .filter((c("_rn") == 1) & (c("score") > threshold)).drop("_rn")
