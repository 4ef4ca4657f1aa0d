"""Operator 3: mix sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the point frac(i * golden ratio); the source whose interval of
cumulative target shares holds the point owns the slot, and the slot's rank among the
slots of its source names the block it takes. The blocks of a source are equal runs of
``block`` words of its documents in a shuffled order, repeated while the target asks for
it. Slots and blocks are equi-joined on (source, rank).

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; they share all
words, but no source more than ``MAX_REPEATS`` times its own size; what is above is
reshared by weight. Ranks beyond a source's target are cut, the few that the schedule
lacks (its discrepancy, a handful for each source) are appended at its end, and the last
block ends at the target, so a source gives round(target) words.

Defined results: a null text has size 0 and takes nothing; a null source is a source;
null ids are shuffled as empty ones; repeated rows are documents of their own (of rows that
agree in id and size, which one comes first is open, the rows of the result are not);
an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_bits, materialize, row_key, running_sum, whole_row, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 512
# fixed values: a full-period Weyl sequence, an odd multiplier nearest 2^30 / golden ratio
POINT_BITS = 30
POINT_STEP = 663608941
CELL_BITS = 10  # cells of the unit interval by which points find their source


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, body: str | None = None) -> DataFrame:
    """Narrow table of documents: id, body (XXH64 of the text), source, size in words, shuffled order."""
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("id"), (F.col(body) if body else F.xxhash64(text_col)).alias("body"),
                       F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("ord"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, words): water level over the sources, a row for each.

    With sources sorted by cap / weight, the level if all before k are capped is
    (T - caps before k) / (weights from k on); the first k that it doesn't overflow sets it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    src = src.withColumn("cap", F.col("source_size") * max_repeats)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    src = (src.withColumn("total", F.sum("source_size").over(everything))
           .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("w_rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    level = F.col("rest").cast("double") / F.col("w_rest")
    src = src.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    src = src.withColumn("level", F.first("level", ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("level") * F.col("w"), F.col("cap").cast("double"))
    words = F.least(F.round(target).cast("long"), F.col("cap"))
    return src.select("source", "source_size", target.alias("target"), words.alias("words"))


def slots(plan: DataFrame, block: int) -> DataFrame:
    """(source, rank, slot): the schedule. ``plan`` has a row for each source."""
    spark = plan.sparkSession
    need = plan.withColumn("need", F.ceil(F.col("words") / F.lit(block)).cast("long")).where("need > 0")
    n_slots = need.agg(F.sum("need")).first()[0] or 0
    span = 1 << POINT_BITS
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    edges = need.withColumn("hi", F.sum("need").over(by_name)).withColumn("lo", F.col("hi") - F.col("need"))
    edges = edges.select("source", "need", *[F.floor(F.col(c).cast("double") * span / max(n_slots, 1)).cast("long").alias(c)
                                             for c in ("lo", "hi")]).where("lo < hi")
    cell = 1 << (POINT_BITS - CELL_BITS)
    cells = edges.select("*", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("cell"))
    point = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") % span) * POINT_STEP % span).alias("x"))
    point = point.withColumn("cell", F.expr(f"x div {cell}"))
    owned = point.join(cells, "cell").where("x >= lo and x < hi").select("source", "slot", "need")
    bits = chunk_bits(n_slots)
    ranked = running_sum(owned.withColumn("one", F.lit(1)).withColumn("chunk", F.shiftright("slot", bits)),
                         ["source"], "chunk", ["slot"], "one", "rank")
    ranked = materialize(ranked.where("rank < need").select("source", "rank", "slot"), "mix-slots")
    got = ranked.groupBy("source").agg(F.count("*").alias("got")).withColumnRenamed("source", "s")
    short = need.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    tail = short.where("got < need").select(
        "source", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    # a handful of slots for each source, after all others
    last = F.row_number().over(Window.orderBy("rank", F.col("source").asc_nulls_last()))
    return ranked.unionByName(tail.withColumn("slot", F.lit(n_slots) + last - 1))


def place(sized: DataFrame) -> DataFrame:
    """``sized`` with ``start``: a row's offset in words in the shuffled stream of its source."""
    bits = chunk_bits(sized.count())
    chunk = F.shiftright(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long"), 32 - bits)
    return running_sum(sized.withColumn("chunk", chunk), ["source"], "chunk", ["ord", "id", "size", "body"], "size",
                       "start").drop("ord", "chunk")


def blocks(placed: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """Pieces of documents by block: (source, rank, id, size, start, pos, from_word, taken_words)."""
    p = plan.withColumnRenamed("source", "s")
    rows = placed.where("size > 0").join(p, F.col("source").eqNullSafe(F.col("s"))).where("words > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(words - 1) div source_size"))))
    rows = rows.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("start"))
    rows = rows.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words"))).where("lo < hi")
    rows = rows.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    first = F.col("rank") * block
    left, right = F.greatest("lo", first), F.least("hi", first + block)
    return rows.select("source", "rank", "id", "size", "start", (left - first).alias("pos"),
                       (left - F.col("lo")).alias("from_word"), (right - left).alias("taken_words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK_WORDS, body: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(schedule, documents).

    schedule: slot, pos, source, id, from_word, taken_words; read in (slot, pos) order it is the mix.
    documents: id, body, source, size, source_size, target, taken; a row for each row of ``docs``.
    """
    sized = materialize(sizes(docs, id_col, text_col, source_col, body), "mix-sizes")
    plan = materialize(targets(sized), "mix-targets")
    placed = materialize(place(sized), "mix-placed")
    s = slots(plan, block).select(F.col("source").alias("s"), F.col("rank").alias("r"), "slot")
    pieces = blocks(placed, plan, block)
    schedule = pieces.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r"))).drop("s", "r")
    schedule = materialize(schedule, "mix-schedule")
    key = ["source", "id", "size", "start"]  # of a row of its own, unless the rows are empty
    taken = schedule.groupBy(*[F.col(k).alias(f"t_{k}") for k in key]).agg(F.sum("taken_words").alias("taken"))
    rows = placed.join(taken, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in key], "left")
    p = plan.select(F.col("source").alias("s"), "source_size", "target")
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("s")))
    return schedule, rows.select(F.col("id").alias(id_col), "body", F.col("source").alias(source_col), "size", "source_size",
                                 "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    block: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target and taken added (or replaced)."""
    own = ("size", "source_size", "target", "taken")
    key = row_key(F.col(id_col).cast("long"), F.xxhash64(text_col, source_col))
    taken = mix(docs.withColumn("_both", F.xxhash64(text_col, source_col)), id_col, text_col, source_col, block, body="_both")[1]
    # rows that repeat adjoin in their source's stream, so they take all alike, but where the target ends: three amounts at most
    facts = F.struct("taken", *own[:3]).alias("fact")
    taken = taken.where("taken > 0").groupBy(row_key(F.col(id_col), F.col("body")), facts).agg(F.count("*").alias("rows"))
    taken = taken.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("fact", "rows")), asc=False).alias("_facts"))
    rows = docs.select(key, whole_row(docs, own)).join(taken, "_key")
    # rows that repeat share a key: the n-th row has the n-th take
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    upto = lambda k: sum((F.coalesce(F.get("_facts", F.lit(i))["rows"], F.lit(0)) for i in range(k + 1)), F.lit(0))
    fact = F.coalesce(*[F.when(F.col("_nth") <= upto(k), F.get("_facts", F.lit(k))["fact"]) for k in range(3)])
    rows = rows.withColumn("_fact", fact).where("_fact is not null")
    return rows.select("_doc.*", *[F.col(f"_fact.{c}").alias(c) for c in own])
