"""Comparison and inspection (C1-C7, I1-I3) as joins over tables.

Settings, token lists, key -> array states and sequences are all data here:
a diff is a full outer join (or ``exceptAll`` both ways for multisets), so
it runs distributed whatever the sizes.
"""

from __future__ import annotations

import json
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def flatten(df: DataFrame, keys: list[str], js: str) -> DataFrame:
    """(keys, path, value) of every leaf of a JSON settings text.

    Nested objects give dotted paths. A list is a multiset: its items share the
    path ``name[]``, and leaves that repeat are numbered (``n``) in value order,
    so that two lists that differ only in order have the same rows. Empty
    objects and lists are leaves of their own. NULL or broken JSON has one row,
    its text at the empty path. A small Arrow helper walks one text at a time."""
    def leaves(value, path):
        if isinstance(value, dict) and value:
            for k, v in value.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list) and value:
            for v in value:
                # an object in a list stays whole: which of its leaves belong together matters
                yield f"{path}[]", json.dumps(v, sort_keys=True)
        else:
            yield path, json.dumps(value, sort_keys=True)

    def one(text):
        try:
            found = sorted(leaves(json.loads(text), ""))
        except (TypeError, ValueError):
            found = [("", text)]
        seen, out = {}, []
        for pair in found:
            seen[pair] = seen.get(pair, -1) + 1
            out.append((pair[0], seen[pair] if pair[0].endswith("[]") else 0, pair[1]))
        return out

    @F.arrow_udf("array<struct<path:string,n:int,value:string>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [one(text) for text in texts.to_pylist()]
        path, n, value = zip(*(leaf for row in rows for leaf in row)) if any(rows) else ((), (), ())
        fields = pa.StructArray.from_arrays([pa.array(path, pa.string()), pa.array(n, pa.int32()), pa.array(value, pa.string())], ["path", "n", "value"])
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), fields)

    return df.select(*keys, F.explode(run(c(js))).alias("_l")).select(*keys, "_l.path", "_l.n", "_l.value")


def flat_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, kind, a_value, b_value) for added / removed / changed entries.

    Presence is a column of its own, so an entry whose value is NULL on both
    sides is equal, not added."""
    left = a.select(*[c(k).alias(f"_a_{k}") for k in keys], c(value).alias("a_value"), F.lit(True).alias("_in_a"))
    right = b.select(*[c(k).alias(f"_b_{k}") for k in keys], c(value).alias("b_value"), F.lit(True).alias("_in_b"))
    j = left.join(right, [c(f"_a_{k}").eqNullSafe(c(f"_b_{k}")) for k in keys], "full_outer").select(
        *[F.when(c("_in_a"), c(f"_a_{k}")).otherwise(c(f"_b_{k}")).alias(k) for k in keys], "a_value", "b_value", "_in_a", "_in_b")
    kind = (F.when(c("_in_a").isNull(), F.lit("added"))
            .when(c("_in_b").isNull(), F.lit("removed"))
            .when(~c("a_value").eqNullSafe(c("b_value")), F.lit("changed")))
    return j.withColumn("kind", kind).filter(c("kind").isNotNull()).drop("_in_a", "_in_b")


def settings_diff(a: DataFrame, b: DataFrame, keys: list[str], js: str = "settings") -> DataFrame:
    """C1/C4 of JSON settings: lists as multisets (an item is there or not), else by path.
    (keys, path, kind, a_value, b_value)"""
    left, right = flatten(a, keys, js), flatten(b, keys, js)
    item = F.when(c("path").endswith("[]"), c("value")).otherwise(F.lit(""))
    by = [*keys, "path", "_item", "n"]
    return flat_diff(left.withColumn("_item", item), right.withColumn("_item", item), by).drop("_item", "n")


def identical(diff: DataFrame) -> bool:
    """C4: True when a diff has no rows (a one-row probe)."""
    return diff.isEmpty()


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Order-free list difference; rows only in a ('a') or only in b ('b'), as often as
    one side has them more. Two empty sides are refused: nothing would be compared."""
    if a.isEmpty() or b.isEmpty():
        raise ValueError("a side of the comparison is empty")
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("b")))


def state_diff(a: DataFrame, b: DataFrame, key: str = "key", values: str = "values", shape: str | None = None) -> DataFrame:
    """(key, kind) by exact equality of shape and values; keys on one side only are reported too.

    Only a digest of the values and the shape are shuffled; ``state_values``
    fetches the arrays of the keys that differ."""
    def side(df, name):
        sh = c(shape) if shape else F.array(F.size(values))
        return df.select(c(key).alias("_k" + name), F.sha2(F.to_json(F.struct(c(values).alias("v"))), 256).alias(name + "_digest"),
                         sh.alias(name + "_shape"), F.lit(True).alias("_in_" + name))
    l, r = side(a, "a"), side(b, "b")
    j = l.join(r, c("_ka").eqNullSafe(c("_kb")), "full_outer")
    kind = (F.when(c("_in_a").isNull(), F.lit("added"))
            .when(c("_in_b").isNull(), F.lit("removed"))
            .when(~c("a_shape").eqNullSafe(c("b_shape")), F.lit("shape"))
            .when(c("a_digest") != c("b_digest"), F.lit("changed")))
    k = F.when(c("_in_a"), c("_ka")).otherwise(c("_kb")).alias(key)
    return j.select(k, kind.alias("kind")).filter(c("kind").isNotNull())


def state_values(diff: DataFrame, a: DataFrame, b: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """The arrays of both sides for the keys of a state diff."""
    return diff.join(a.select(key, c(values).alias("a_values")), key, "left").join(
        b.select(key, c(values).alias("b_values")), key, "left")


# The settings that two models must share beside their token sequences.
SETTING_FIELDS = ["max_position_embeddings", "image_size", "pad_token_id", "eos_token_id", "unk_token_id"]


def compare_settings(a: DataFrame, b: DataFrame, keys: list[str], tokens: str = "tokens",
                     fields: list[str] | None = None) -> DataFrame:
    """(keys, rule, ok): each setting and the token array equal on both sides.
    NULL equals NULL; keys on one side only fail every rule."""
    names = [*(fields or SETTING_FIELDS), tokens]
    l = a.select(*keys, F.struct(*names).alias("_a"))
    r = b.select(*keys, F.struct(*names).alias("_b"))
    both = c("_a").isNotNull() & c("_b").isNotNull()
    return rule_results(l.join(r, keys, "full_outer"), keys,
                        [(n, both & c("_a").getField(n).eqNullSafe(c("_b").getField(n))) for n in names])


def rule_results(settings: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """C5/C7 as a table: (keys, rule, ok) for every named rule of every settings row
    (a rule that cannot be evaluated counts as failed)."""
    checks = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(cond, F.lit(False)).alias("ok"))
                       for n, cond in rules])
    return settings.select(*keys, F.explode(checks).alias("r")).select(*keys, "r.rule", "r.ok")


def rule_violations(settings: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """Only the failed rules (the reference prints one message per difference)."""
    return rule_results(settings, keys, rules).filter(~c("ok"))


def sequence_equal(a: DataFrame, b: DataFrame, keys: list[str], seq: str = "sequence") -> DataFrame:
    """Equality of two sequence tables per key."""
    j = a.select(*keys, c(seq).alias("a_seq")).join(b.select(*keys, c(seq).alias("b_seq")), keys, "full_outer")
    return j.select(*keys, F.coalesce(c("a_seq") == c("b_seq"), F.lit(False)).alias("equal"))


def split_sizes(meta: DataFrame) -> DataFrame:
    """Rows and files per split."""
    return meta.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").alias("n_files"))
