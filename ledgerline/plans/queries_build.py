"""Registered queries for dataset build, sequences, evaluation and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.schema import FIELD_CODES
from ..operators import dataset as D
from ..operators import diff as C
from ..operators import evaluate as E
from ..operators import sequence as S
from ..operators import subword as SW
from ..sources import fixtures as fx
from ..sources import pages as P
from ..session import row_batches
from ..sources.tables import table
from . import build as B
from . import oracle_truth as T
from .queries import query

c = F.col
TW = T.ALL_WITH_TARGETS
PW = T.ALL_WITH_PREDS
R9 = 9  # decimals kept on averaged doubles, in both engines


# =========================================================== S: sources
@query("s_union_vendors", T.ALL_TRUTH + """
SELECT vendor, count(*) AS n_files, 2 * count(*) AS n_pages FROM (
  SELECT 'bank' AS vendor FROM bank_t UNION ALL SELECT 'savings' FROM savings_t
  UNION ALL SELECT 'credit' FROM credit_t UNION ALL SELECT 'utility' FROM utility_t
  UNION ALL SELECT 'telecom' FROM telecom_t) GROUP BY vendor""")
def s_union_vendors(spark, sf):
    """All five vendors' pages in one table."""
    pages = fx.doc_pages(spark, sf)
    return pages.groupBy("vendor").agg(F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_pages"))


@query("s_subset", T.with_truth(T.BANK, T.deposit_truth("bank")) + """
SELECT count(*) AS n_files, count(*) + count(*) FILTER (WHERE NOT (k % 29 = 7)) AS n_records FROM bank_t""")
def s_subset(spark, sf):
    """A run over one vendor only (the subset run)."""
    recs = B.build(spark, sf, ["bank"]).records
    return recs.agg(F.count_distinct("file").alias("n_files"), F.count_if(c("kept")).alias("n_records"))


@query("s_manifest_missing", TW + """
SELECT file AS src, 'dataset/' || split || '/images/' || vendor || '_' ||
  CASE WHEN is_info THEN 'info' ELSE CAST(pn AS VARCHAR) END || '_' ||
  substr(md5(file || '#' || CAST(page_idx AS VARCHAR)), 1, 16) || '.jpg' AS dest,
  CAST(page_idx + 1 AS INTEGER) AS page_number
FROM targets WHERE k % 19 = 0""")
def s_manifest_missing(spark, sf):
    """Manifest rows whose destination is absent from a listing (left anti).

    The listing is the manifest minus destinations of accounts with k % 19 = 0, as URIs."""
    man = B.build(spark, sf).manifest
    k = F.regexp_extract("src", r"/(\d+)\.pdf$", 1).cast("bigint")
    listing = man.filter(k % 19 != 0).select(c("dest").alias("path"))
    return P.missing_outputs(man, listing.withColumn("path", F.concat(F.lit("file:///data//"), c("path"))))


@query("s_pages_roundtrip", T.ALL_TRUTH + """
SELECT vendor, count(*) AS n_files, 2 * count(*) AS n_pages, count(*) AS n_records_files FROM (
  SELECT 'bank' AS vendor FROM bank_t UNION ALL SELECT 'savings' FROM savings_t
  UNION ALL SELECT 'credit' FROM credit_t UNION ALL SELECT 'utility' FROM utility_t
  UNION ALL SELECT 'telecom' FROM telecom_t) GROUP BY vendor""")
def s_pages_roundtrip(spark, sf):
    """Rendered documents written as a nested document table, read
    back recursively with a suffix filter, split into pages and extracted."""
    import uuid

    from ..session import ensure_checkpoint_dir
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/docs-{uuid.uuid4().hex}"
    P.write_documents(fx.doc_files(spark, sf), path)
    pages = P.read_documents(spark, path)
    recs = B.V.extract_records(pages)
    return recs.groupBy("vendor").agg(F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_pages"),
                                      F.count_distinct(F.when(c("kept"), c("file"))).alias("n_records_files"))


# =========================================================== D: dataset
@query("d_split_counts", TW + """
SELECT vendor, split, count(*) AS n_pages FROM targets GROUP BY vendor, split""")
def d_split_counts(spark, sf):
    """Accepted pages per vendor and split (hash split 0.8 / 0.2 by page)."""
    return B.build(spark, sf).metadata.groupBy("vendor", "split").agg(F.count(F.lit(1)).alias("n_pages"))


def _n_keys_sql() -> str:
    names = T.GT_CODES
    lv = dict(T.GT_LEAVES)
    terms = []
    for n in names:
        probe = f"{n}_d" if n in ("bd", "ed", "sd") else (lv[n] if n in lv else n)
        terms.append(f"CASE WHEN {probe} IS NOT NULL THEN 1 ELSE 0 END")
    return " + ".join(terms)


@query("d_metadata", TW + f"""
SELECT 'images/' || vendor || '_' || CASE WHEN is_info THEN 'info' ELSE CAST(pn AS VARCHAR) END || '_' ||
  substr(md5(file || '#' || CAST(page_idx AS VARCHAR)), 1, 16) || '.jpg' AS file_name,
  split, CAST(page_idx + 1 AS INTEGER) AS page_number, CAST({_n_keys_sql()} AS INTEGER) AS n_keys
FROM targets""")
def d_metadata(spark, sf):
    """File name, split, 1-based page position, keys in the JSON target."""
    meta = B.build(spark, sf).metadata
    keys = F.json_object_keys(F.get_json_object("ground_truth", "$.gt_parse"))
    return meta.select("file_name", "split", "page_number", F.size(keys).cast("int").alias("n_keys"))


@query("d_batches", TW + """
SELECT file, page_idx, row_number() OVER (ORDER BY doc_key, file, page_idx) - 1 AS row_idx,
  CAST(floor((row_number() OVER (ORDER BY doc_key, file, page_idx) - 1) / 3) AS BIGINT) AS batch
FROM targets WHERE split = 'validation'""")
def d_batches(spark, sf):
    """Consecutive batches of 3 over the validation order (global index, no one-task window)."""
    val = B.targets(spark, sf).filter(c("split") == "validation")
    return D.batches(val, [c("doc_key"), c("file"), c("page_idx")], 3).select("file", "page_idx", "row_idx", "batch")


@query("d_shuffle", TW + """
SELECT e.epoch, file, page_idx,
  row_number() OVER (PARTITION BY e.epoch ORDER BY
    md5(file || '#' || CAST(page_idx AS VARCHAR) || '|' || CAST(e.epoch AS VARCHAR) || '|42'), file, page_idx) - 1 AS position
FROM targets, (SELECT range AS epoch FROM range(3)) e WHERE split = 'train'""")
def d_shuffle(spark, sf):
    """Per-epoch order of the training rows (3 epochs), positions from a global index."""
    tr = B.targets(spark, sf).filter(c("split") == "train").select("file", "page_idx")
    ep = tr.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(2))))
    # The page key is unique (a 32-bit hash is not), so the order has no ties.
    idx = D.global_index(ep, [c("epoch"), D.shuffle_key(D.page_key(), c("epoch")), c("file"), c("page_idx")])
    # Epoch start offsets: one row per epoch (a bounded table), broadcast back.
    starts = idx.groupBy("epoch").agg(F.min("row_idx").alias("_start"))
    out = idx.join(F.broadcast(starts), "epoch")
    return out.select(c("epoch").cast("bigint").alias("epoch"), "file", "page_idx",
                      (c("row_idx") - c("_start")).alias("position"))


# =========================================================== T: sequences
@query("t_linearise_record", TW + """
SELECT file, page_idx, seq || '</s>' AS sequence FROM targets""")
def t_linearise_record(spark, sf):
    """T1 + T4: sorted-key tagged sequence of each accepted record, end marker appended."""
    return B.targets(spark, sf).select("file", "page_idx", "sequence")


@query("t_linearise_props", """
SELECT event_id,
  '<s_k>' || json_extract_string(props, '$.k') || '</s_k><s_type>' || event_type || '</s_type>' AS sorted_seq,
  '<s_type>' || event_type || '</s_type><s_k>' || json_extract_string(props, '$.k') || '</s_k>' AS unsorted_seq
FROM events""")
def t_linearise_props(spark, sf):
    """T1/T2 on raw JSON: {type, k from props}, sorted and in declared order."""
    from pyspark.sql import types as TT
    ev = table(spark, sf, "events").select("event_id", "event_type", "props")
    obj = F.struct(c("event_type").alias("type"), F.from_json("props", "k bigint").getField("k").alias("k"))
    schema = TT.StructType([TT.StructField("type", TT.StringType()), TT.StructField("k", TT.LongType())])
    return ev.select("event_id", S.linearise(obj, schema, True).alias("sorted_seq"),
                     S.linearise(obj, schema, False).alias("unsorted_seq"))


@query("t_categorical", """
SELECT event_id, '<s_type>' || CASE WHEN event_type IN ('click', 'view') THEN '<' || event_type || '/>'
  ELSE event_type END || '</s_type>' AS seq FROM events""")
def t_categorical(spark, sf):
    """Registered categorical values are emitted as <value/> tokens."""
    from pyspark.sql import types as TT
    ev = table(spark, sf, "events").select("event_id", "event_type")
    schema = TT.StructType([TT.StructField("type", TT.StringType())])
    return ev.select("event_id", S.linearise(F.struct(c("event_type").alias("type")), schema,
                                             categorical=["click", "view"]).alias("seq"))


_VOCAB_SQL = T.VOCAB_SQL
_IDS_SQL = T.LABEL_IDS_SQL
_TOK_SQL = T.TOKENS_SQL


@query("t_labels", TW + f"""
SELECT file, page_idx, CAST(least(len(ids), 1536) AS INTEGER) AS n_tokens, CAST(len(ids) AS INTEGER) AS n_tokens_full,
  len(ids) > 1536 AS truncated, CAST(1536 - least(len(ids), 1536) AS INTEGER) AS n_ignored,
  md5(array_to_string(ids[1:1536] || list_transform(range(1536 - least(len(ids), 1536)), lambda x: -100), ',')) AS labels_md5
FROM (SELECT file, page_idx, {_IDS_SQL} AS ids FROM targets)""")
def t_labels(spark, sf):
    """Label ids in order (vocabulary tokens and markers, other characters by code point), padded to 1536 with -100."""
    df = S.label_ids(B.targets(spark, sf).select("file", "page_idx", "sequence"), "sequence")
    n = F.size(F.array_remove("labels", F.lit(S.IGNORE_ID)))
    return df.select("file", "page_idx", n.cast("int").alias("n_tokens"), "n_tokens_full", "truncated",
                     (F.size("labels") - n).cast("int").alias("n_ignored"), F.md5(S.labels_text(c("labels"))).alias("labels_md5"))


_TAGS_SQL = "regexp_extract_all(seq, '</?s_[A-Za-z0-9_]+>')"


@query("t_vocab", TW + f"""
SELECT token, count(*) AS n_uses, list_contains({_VOCAB_SQL}, token) AS in_vocab
FROM (SELECT unnest({_TAGS_SQL}) AS token FROM targets) GROUP BY token""")
def t_vocab(spark, sf):
    """T5: tags used by the targets, their use count and vocabulary coverage."""
    voc = S.vocabulary_df(spark).select("token", F.lit(True).alias("in_vocab"))
    used = B.targets(spark, sf).select(F.explode(F.regexp_extract_all("sequence", F.lit(r"</?s_[A-Za-z0-9_]+>"), 0)).alias("token"))
    g = used.groupBy("token").agg(F.count(F.lit(1)).alias("n_uses"))
    return g.join(F.broadcast(voc), "token", "left").select("token", "n_uses",
                                                             F.coalesce(c("in_vocab"), F.lit(False)).alias("in_vocab"))


@query("t_new_tokens", TW + f"""
SELECT DISTINCT token FROM (SELECT unnest({_TAGS_SQL}) AS token FROM targets) WHERE token LIKE '</%'""")
def t_new_tokens(spark, sf):
    """Tags used by the targets that a base vocabulary (open tags only) lacks."""
    base = spark.createDataFrame([(f"<s_{x}>",) for x in FIELD_CODES.values()], "token string")
    used = B.targets(spark, sf).select(F.explode(F.regexp_extract_all("sequence", F.lit(r"</?s_[A-Za-z0-9_]+>"), 0)).alias("token")).distinct()
    return S.new_tokens(used, F.broadcast(base))


@query("t_clean", PW + """
SELECT epoch, file, page_idx,
  replace(replace(regexp_replace(regexp_replace(replace(replace(raw, '</s>', ''), '<pad>', ''), '<.*?>', ''),
    '^\\s+|\\s+$', '', 'g'), '> ', '>'), ' </s_', '</s_') AS pred_clean
FROM preds""")
def t_clean(spark, sf):
    """Remove end/pad markers, the task tag, outer spaces and tag-side spaces."""
    return B.scores(B.predictions(spark, sf)).select(c("epoch").cast("bigint").alias("epoch"), "file", "page_idx",
                                                      "pred_clean")


@query("t_parse_back", TW + """
SELECT file, page_idx, TRUE AS roundtrip_ok FROM targets""")
def t_parse_back(spark, sf):
    """parse(linearise(record)) == record for every accepted page."""
    t = B.targets(spark, sf).select("file", "page_idx", "gt", S.clean_answer(c("sequence")).alias("answer"))
    back = S.parse_sequence(c("answer"))
    return t.select("file", "page_idx", (back == c("gt")).alias("roundtrip_ok"))


# =========================================================== E: evaluation
@query("e_edit_distance", PW + """
SELECT CAST(epoch AS BIGINT) AS epoch, file, page_idx, score FROM scores""")
def e_edit_distance(spark, sf):
    """Normalised edit distance of each cleaned prediction to its answer."""
    return B.scores(B.predictions(spark, sf)).select(c("epoch").cast("bigint").alias("epoch"), "file", "page_idx", "score")


@query("e_epoch_stats", PW + f"""
SELECT CAST(epoch AS BIGINT) AS epoch, round(avg(bm), {R9}) AS mean_score, round(min(bm), {R9}) AS min_score,
  round(max(bm), {R9}) AS max_score, count(*) AS n_batches
FROM (SELECT epoch, batch, avg(score) AS bm FROM scores GROUP BY epoch, batch) GROUP BY epoch""")
def e_epoch_stats(spark, sf):
    """Batch means, then mean / min / max of batch means per epoch."""
    st = E.epoch_stats(B.scores(B.predictions(spark, sf)))
    return st.select(c("epoch").cast("bigint").alias("epoch"),
                     *[F.round(x, R9).alias(x) for x in ("mean_score", "min_score", "max_score")], "n_batches")


@query("e_running_mean", PW + f"""
SELECT epoch, round(m, {R9}) AS mean_score,
  round(avg(m) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {R9}) AS running_mean
FROM (SELECT CAST(epoch AS BIGINT) AS epoch, avg(bm) AS m
      FROM (SELECT epoch, batch, avg(score) AS bm FROM scores GROUP BY epoch, batch) GROUP BY epoch)""")
def e_running_mean(spark, sf):
    """E5: mean over all epochs so far."""
    rm = E.running_mean(E.epoch_stats(B.scores(B.predictions(spark, sf))))
    return rm.select(c("epoch").cast("bigint").alias("epoch"), F.round("mean_score", R9).alias("mean_score"),
                     F.round("running_mean", R9).alias("running_mean"))


@query("e_gate", PW + """
SELECT CAST(epoch AS BIGINT) AS epoch, count(*) AS n FROM scores WHERE (epoch + 1) % 2 = 0 GROUP BY epoch""")
def e_gate(spark, sf):
    """Evaluate every second epoch from epoch 0."""
    g = E.gate(B.scores(B.predictions(spark, sf)), 0, 2)
    return g.groupBy(c("epoch").cast("bigint").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))


@query("e_early_stop", PW + f"""
SELECT epoch, round(v, {R9}) AS mean_score, round(best, {R9}) AS best, improved, since_best,
  COALESCE(epoch = min(CASE WHEN since_best >= 3 THEN epoch END) OVER (), FALSE) AS stop
FROM (SELECT *, CAST(epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS INTEGER) AS since_best
  FROM (SELECT *, bp IS NULL OR v < bp AS improved, min(v) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best
    FROM (SELECT *, min(v) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bp
      FROM (SELECT CAST(epoch AS BIGINT) AS epoch, avg(bm) AS v
            FROM (SELECT epoch, batch, avg(score) AS bm FROM scores GROUP BY epoch, batch) GROUP BY epoch))))""")
def e_early_stop(spark, sf):
    """Min-mode early stopping with patience 3 over the epoch mean distance."""
    st = E.epoch_stats(B.scores(B.predictions(spark, sf)))
    es = E.early_stop(st, "mean_score", 3, "min")
    return es.select(c("epoch").cast("bigint").alias("epoch"), F.round("mean_score", R9).alias("mean_score"),
                     F.round("best", R9).alias("best"), "improved", "since_best", "stop")


def _acc_sql() -> str:
    return PW + "," + T.leaf_kinds_sql() + """,
acc AS (
  SELECT epoch, file, page_idx, t, greatest(0.0, 1.0 - CAST(count(*) FILTER (WHERE kind <> 'match') AS DOUBLE) / count(*)) AS accuracy
  FROM leaf_kinds GROUP BY epoch, file, page_idx, t
)"""


@query("e_field_accuracy", _acc_sql() + f"""
SELECT CAST(epoch AS BIGINT) AS epoch, file, page_idx, round(accuracy, {R9}) AS accuracy FROM acc""")
def e_field_accuracy(spark, sf):
    """Field accuracy per prediction (own definition, see README)."""
    acc = B.accuracies(B.scores(B.predictions(spark, sf)))
    return acc.select(c("epoch").cast("bigint").alias("epoch"), "file", "page_idx", F.round("accuracy", R9).alias("accuracy"))


@query("e_by_field", _acc_sql() + f"""
SELECT path, round(avg(CASE WHEN kind = 'match' THEN 1.0 ELSE 0.0 END), {R9}) AS accuracy, count(*) AS n
FROM leaf_kinds GROUP BY path""")
def e_by_field(spark, sf):
    """E13 (extension): accuracy per field path over all epochs."""
    bf = E.by_field(B.field_diffs(B.scores(B.predictions(spark, sf))))
    return bf.select("path", F.round("accuracy", R9).alias("accuracy"), "n")


@query("e_mean", _acc_sql() + f"""
SELECT CAST(epoch AS BIGINT) AS epoch, count(*) AS n, round(avg(accuracy), {R9}) AS mean_accuracy FROM acc GROUP BY epoch""")
def e_mean(spark, sf):
    """Mean accuracy and count of every epoch."""
    acc = B.accuracies(B.scores(B.predictions(spark, sf)))
    return acc.groupBy(c("epoch").cast("bigint").alias("epoch")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), R9).alias("mean_accuracy"))


@query("e_by_type", _acc_sql() + f"""
SELECT CAST(epoch AS BIGINT) AS epoch, t, count(*) AS n, round(avg(accuracy), {R9}) AS mean_accuracy FROM acc GROUP BY epoch, t""")
def e_by_type(spark, sf):
    """Mean accuracy by document type, of every epoch."""
    acc = B.accuracies(B.scores(B.predictions(spark, sf)))
    return acc.groupBy(c("epoch").cast("bigint").alias("epoch"), "t").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), R9).alias("mean_accuracy"))


@query("e_sample", PW + """
SELECT CAST(epoch AS BIGINT) AS epoch, file, page_idx FROM scores
WHERE idx % greatest(1, CAST(floor((SELECT count(*) FROM val) * 0.2) AS BIGINT)) = 0""")
def e_sample(spark, sf):
    """Every int(n * 0.2)-th document by position, its prediction in every epoch."""
    sc = B.scores(B.predictions(spark, sf)).drop("idx")
    val = B.targets(spark, sf).filter(c("split") == "validation").select("doc_key", "file", "page_idx")
    chosen = E.sample_every(val, [c("doc_key"), c("file"), c("page_idx")], 0.2).select("file", "page_idx")
    return sc.join(chosen, ["file", "page_idx"]).select(c("epoch").cast("bigint").alias("epoch"), "file", "page_idx")


@query("e_bad_cases", PW + """
SELECT CAST(epoch AS BIGINT) AS epoch, CAST(batch AS BIGINT) AS batch, file, page_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY epoch, batch ORDER BY idx) AS rn FROM scores) WHERE rn = 1 AND score > 0.02""")
def e_bad_cases(spark, sf):
    """First item of a batch scoring above a threshold (0.02 here, 0.5 by default)."""
    bc = E.bad_cases(B.scores(B.predictions(spark, sf)), "idx", 0.02)
    return bc.select(c("epoch").cast("bigint").alias("epoch"), c("batch").cast("bigint").alias("batch"), "file", "page_idx")


# =========================================================== C / I: diffs and inspection
@query("c_config_diff", _acc_sql() + f"""
SELECT CAST(epoch AS BIGINT) AS epoch, file, page_idx, path, kind FROM leaf_kinds WHERE kind <> 'match'""")
def c_config_diff(spark, sf):
    """Nested-document diff (truth vs parsed prediction, every epoch) as rows."""
    d = B.field_diffs(B.scores(B.predictions(spark, sf)))
    return d.filter(c("kind") != "match").select(c("epoch").cast("bigint").alias("epoch"), "file", "page_idx", "path", "kind")


@query("c_token_diff", TW + f""",
used AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TAGS_SQL}) AS token FROM targets) GROUP BY token),
other AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TAGS_SQL}) AS token FROM targets WHERE NOT (doc_key % 41 = 0)
  UNION ALL SELECT '<s_extra>' FROM targets WHERE doc_key % 43 = 0) GROUP BY token)
SELECT token, CASE WHEN coalesce(u.n, 0) > coalesce(o.n, 0) THEN 'a' ELSE 'b' END AS side,
  CAST(abs(coalesce(u.n, 0) - coalesce(o.n, 0)) AS BIGINT) AS n
FROM used u FULL JOIN other o USING (token) WHERE coalesce(u.n, 0) <> coalesce(o.n, 0)""")
def c_token_diff(spark, sf):
    """The tags of two token lists as multisets, with multiplicities; what each side has more.
    The second list lacks the pages with key % 41 = 0 and has a tag of its own."""
    tags = lambda df: df.select(F.explode(F.regexp_extract_all("sequence", F.lit(r"</?s_[A-Za-z0-9_]+>"), 0)).alias("token"))
    t = B.targets(spark, sf).select("doc_key", "sequence")
    extra = t.filter(c("doc_key") % 43 == 0).select(F.lit("<s_extra>").alias("token"))
    other = tags(t.filter(c("doc_key") % 41 != 0)).unionByName(extra)
    return C.multiset_diff(tags(t), other).groupBy("token", "side").agg(F.count(F.lit(1)).alias("n"))


@query("c_state_diff", """
SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'removed' WHEN vec_id % 17 = 0 THEN 'shape' ELSE 'changed' END AS kind
FROM embeddings WHERE vec_id % 13 = 0 OR vec_id % 11 = 0 OR vec_id % 17 = 0""")
def c_state_diff(spark, sf):
    """Key -> array state diff; the second state bumps element 1 when id % 11 = 0, is reshaped
    when id % 17 = 0 and lacks ids with id % 13 = 0."""
    a = table(spark, sf, "embeddings").select(c("vec_id").alias("key"), c("embedding").alias("values"), F.array(F.lit(8), F.lit(8)).alias("shape"))
    b = a.filter(c("key") % 13 != 0).withColumn(
        "values", F.when(c("key") % 11 == 0, F.transform("values", lambda x, i: F.when(i == 0, (x + 1).cast("float")).otherwise(x)))
        .otherwise(c("values"))).withColumn("shape", F.when(c("key") % 17 == 0, F.array(F.lit(4), F.lit(16))).otherwise(c("shape")))
    return C.state_diff(a, b, "key", "values", "shape").select(c("key").alias("vec_id"), "kind")


@query("c_settings_diff", """
WITH s AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS b FROM customer)
SELECT k, 'model.size' AS path, 'changed' AS kind, CAST(n AS VARCHAR) AS a_value, CAST(n + 1 AS VARCHAR) AS b_value FROM s WHERE k % 7 = 0
UNION ALL SELECT k, 'model.new', 'added', NULL, 'null' FROM s WHERE k % 5 = 0
UNION ALL SELECT k, 'tokens[]', 'removed', CASE WHEN n = 3 THEN '3' ELSE '3' END, NULL FROM s WHERE k % 11 = 0
UNION ALL SELECT k, 'note', 'removed', 'null', NULL FROM s WHERE k % 3 = 0""")
def c_settings_diff(spark, sf):
    """Nested settings texts of two runs, flattened; lists as multisets (the second run lists
    its tokens in another order), a NULL value on both sides is equal."""
    cu = table(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_nationkey").alias("n"))
    k, n = c("k"), c("n").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    a = cu.select("k", text('{"note": null, "model": {"size": ', n, ', "none": null}, "tokens": [1, 2, 2, 3, {"x": ', n, "}]}").alias("settings"))
    size = F.when(k % 7 == 0, (c("n") + 1).cast("string")).otherwise(n)
    new = F.when(k % 5 == 0, F.lit(', "new": null')).otherwise(F.lit(""))
    three = F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("3, "))
    note = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit('"note": null, '))
    b = cu.select("k", text("{", note, '"tokens": [', three, '{"x": ', n, '}, 2, 1, 2], "model": {"none": null, "size": ', size, new, "}}").alias("settings"))
    return C.settings_diff(a, b, ["k"]).select("k", "path", "kind", "a_value", "b_value")


@query("c_settings_compare", """
SELECT p_partkey AS k, r.rule, CASE r.rule WHEN 'image_size' THEN p_size % 9 <> 0 WHEN 'pad_token_id' THEN p_partkey % 4 <> 0
  WHEN 'tokens' THEN p_partkey % 6 <> 0 ELSE TRUE END AS ok
FROM part, (SELECT unnest(['max_position_embeddings', 'image_size', 'pad_token_id', 'eos_token_id', 'unk_token_id', 'tokens']) AS rule) r""")
def c_settings_compare(spark, sf):
    """Five settings and a token array of two models for each part; NULL equals NULL."""
    pt = table(spark, sf, "part").select(c("p_partkey").alias("k"), "p_size")
    base = pt.select("k", "p_size", F.lit(768).alias("max_position_embeddings"), c("p_size").alias("image_size"),
                     F.lit(None).cast("int").alias("pad_token_id"), F.lit(2).alias("eos_token_id"), F.lit(3).alias("unk_token_id"),
                     F.sequence(F.lit(1), F.lit(5)).alias("tokens"))
    k = c("k")
    other = base.withColumn("image_size", c("p_size") + F.when(c("p_size") % 9 == 0, 1).otherwise(0)) \
        .withColumn("pad_token_id", F.when(k % 4 == 0, F.lit(1))) \
        .withColumn("tokens", F.when(k % 6 == 0, F.reverse("tokens")).otherwise(c("tokens")))
    return C.compare_settings(base, other, ["k"])


@query("c_settings", TW + f"""
SELECT vendor, count(*) AS n_targets, CAST(max(len({_TOK_SQL})) AS INTEGER) AS max_tokens,
  max(len({_TOK_SQL})) <= 1536 AS fits FROM targets GROUP BY vendor""")
def c_settings(spark, sf):
    """Consistency of the length setting with the data: longest target per vendor fits."""
    t = B.targets(spark, sf).select("vendor", F.size(S.tokens(c("sequence"))).alias("n"))
    g = t.groupBy("vendor").agg(F.count(F.lit(1)).alias("n_targets"), F.max("n").cast("int").alias("max_tokens"))
    return g.withColumn("fits", c("max_tokens") <= S.MAX_LENGTH)


@query("c_sequence_equal", PW + """
SELECT file, page_idx, min(raw) = max(raw) AS equal FROM preds WHERE epoch < 2 GROUP BY file, page_idx HAVING count(*) = 2""")
def c_sequence_equal(spark, sf):
    """Output-sequence equality of two epochs per page."""
    p = B.predictions(spark, sf).select("epoch", "file", "page_idx", c("raw").alias("sequence"))
    return C.sequence_equal(p.filter(c("epoch") == 0), p.filter(c("epoch") == 1), ["file", "page_idx"])


@query("i_split_sizes", TW + """
SELECT split, count(*) AS n_rows, count(DISTINCT file) AS n_files FROM targets GROUP BY split""")
def i_split_sizes(spark, sf):
    """Sizes of both splits."""
    return C.split_sizes(B.build(spark, sf).metadata)


@query("i_vocab", TW + f"""
SELECT CAST(len({_VOCAB_SQL}) AS BIGINT) AS n_vocab, count(DISTINCT token) AS n_used_tags,
  count(DISTINCT token) FILTER (WHERE token LIKE '</%') AS n_new
FROM (SELECT unnest({_TAGS_SQL}) AS token FROM targets)""")
def i_vocab(spark, sf):
    """Vocabulary size, distinct tags used, tags new to a base vocabulary of open tags."""
    used = B.targets(spark, sf).select(F.explode(F.regexp_extract_all("sequence", F.lit(r"</?s_[A-Za-z0-9_]+>"), 0)).alias("token"))
    return used.agg(F.lit(len(S.vocabulary())).cast("bigint").alias("n_vocab"),
                    F.count_distinct("token").alias("n_used_tags"),
                    F.count_distinct(F.when(c("token").startswith("</"), c("token"))).alias("n_new"))


@query("i_shapes", TW + """
SELECT split, count(*) AS n, 1536 AS min_size, 1536 AS max_size FROM targets GROUP BY split""")
def i_shapes(spark, sf):
    """Every label array has the fixed length, per split."""
    t = S.label_ids(B.targets(spark, sf).select("split", "sequence"), "sequence").select("split", F.size("labels").alias("sz"))
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("sz").alias("min_size"), F.max("sz").alias("max_size"))


@query("i_format", TW + """
SELECT split, count(*) AS n_rows, count(*) AS n_valid FROM targets GROUP BY split""")
def i_format(spark, sf):
    """Every ground_truth parses and holds a gt_parse object (all rows, not the first)."""
    meta = B.build(spark, sf).metadata
    return meta.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(P.holds_object("ground_truth", "gt_parse")).alias("n_valid"))


@query("c_rules", TW + f""",
per_vendor AS (
  SELECT vendor, max(len({_TOK_SQL})) AS max_tokens, bool_and(seq || '</s>' LIKE '%</s>') AS eos_ok,
    bool_and(list_has_all({_VOCAB_SQL}, {_TAGS_SQL})) AS tags_ok
  FROM targets GROUP BY vendor
)
SELECT vendor, 'ends_with_eos' AS rule, eos_ok AS ok FROM per_vendor
UNION ALL SELECT vendor, 'fits_max_length', max_tokens <= 1536 FROM per_vendor
UNION ALL SELECT vendor, 'tags_in_vocabulary', tags_ok FROM per_vendor""")
def c_rules(spark, sf):
    """Consistency rules between settings and data, one row per vendor and rule."""
    voc = F.array(*[F.lit(t) for t in S.vocabulary()])
    t = B.targets(spark, sf).select(
        "vendor", F.size(S.tokens(c("sequence"))).alias("n_tokens"),
        c("sequence").endswith(F.lit("</s>")).alias("eos"),
        (F.size(F.array_except(F.regexp_extract_all("sequence", F.lit(r"</?s_[A-Za-z0-9_]+>"), 0), voc)) == 0)
        .alias("tags"))
    settings = t.groupBy("vendor").agg(F.max("n_tokens").alias("max_tokens"), F.bool_and("eos").alias("eos_ok"),
                                       F.bool_and("tags").alias("tags_ok"))
    return C.rule_results(settings, ["vendor"], [
        ("ends_with_eos", c("eos_ok")),
        ("fits_max_length", c("max_tokens") <= S.MAX_LENGTH),
        ("tags_in_vocabulary", c("tags_ok")),
    ])


@query("e_pair_missing", PW + f"""
SELECT count(*) FILTER (WHERE doc_key % 5 <> 0) AS n_paired, count(*) FILTER (WHERE doc_key % 5 = 0) AS n_missing
FROM val""")
def e_pair_missing(spark, sf):
    """Predictions paired with answers by key; an outer join reports answers
    with no prediction (here the printer skipped keys with key % 5 = 0)."""
    preds = B.predictions(spark, sf).filter((c("epoch") == B.EPOCHS - 1) & (c("doc_key") % 5 != 0)) \
        .select("file", "page_idx", "raw")
    answers = B.targets(spark, sf).filter(c("split") == "validation").select("file", "page_idx", "sequence")
    j = E.pair(preds, answers, ["file", "page_idx"], "right_outer")
    return j.agg(F.count_if(c("raw").isNotNull()).alias("n_paired"), F.count_if(c("raw").isNull()).alias("n_missing"))


@query("d_row_at", TW + f""",
ranked AS (
  SELECT file, page_idx, seq, row_number() OVER (ORDER BY doc_key, file, page_idx) - 1 AS pos
  FROM targets WHERE split = 'validation'
)
SELECT file, page_idx, array_to_string(({_IDS_SQL})[1:30], ',') AS first_labels
FROM ranked WHERE pos = 7""")
def d_row_at(spark, sf):
    """D8 + I1: the row at position 7 of the validation order and its first 30 label ids."""
    val = B.targets(spark, sf).filter(c("split") == "validation")
    row = D.row_at(val, [c("doc_key"), c("file"), c("page_idx")], 7)
    labels = F.slice("labels", 1, 30)
    return S.label_ids(row, "sequence").select("file", "page_idx", F.array_join(labels.cast("array<string>"), ",").alias("first_labels"))


_NAME_VOCAB_SQL = "[" + ", ".join(f"'{t}'" for t in S.name_vocabulary()) + "]"


@query("t_vocab_names", TW + f""",
used AS (SELECT DISTINCT unnest({_TAGS_SQL}) AS token FROM targets),
names AS (SELECT unnest({_NAME_VOCAB_SQL}) AS token)
SELECT token, 'a' AS side FROM used WHERE token NOT IN (SELECT token FROM names)
UNION ALL
SELECT token, 'b' AS side FROM names WHERE token NOT IN (SELECT token FROM used)""")
def t_vocab_names(spark, sf):
    """T5 coverage: tags the targets use ('a') vs a vocabulary built from field
    names ('b'); only fields whose name equals their code overlap."""
    used = B.targets(spark, sf).select(
        F.explode(F.regexp_extract_all("sequence", F.lit(r"</?s_[A-Za-z0-9_]+>"), 0)).alias("token")).distinct()
    names = spark.createDataFrame([(t,) for t in S.name_vocabulary()], "token string")
    return C.multiset_diff(used, F.broadcast(names))


# =========================================================== planted bad inputs
@query("s_metadata_readback", TW + """
SELECT split, CASE doc_key % 11 WHEN 0 THEN 'absent' WHEN 1 THEN 'not_json' WHEN 2 THEN 'no_gt_parse_object'
  WHEN 3 THEN 'no_gt_parse_object' ELSE 'ok' END AS outcome, count(*) AS n FROM targets GROUP BY 1, 2""")
def s_metadata_readback(spark, sf):
    """Targets written and read back, with absent, broken and non-object ones planted;
    every row is valid or quarantined with its reason."""
    import uuid

    from ..session import ensure_checkpoint_dir
    meta = B.targets(spark, sf).select("split", "file_name", "ground_truth", (c("doc_key") % 11).alias("m"))
    bad = (F.when(c("m") == 0, F.lit(None)).when(c("m") == 1, F.lit('{"gt_parse": {'))
           .when(c("m") == 2, F.lit('{"gt_parse":"{x"}')).when(c("m") == 3, F.lit('{"other": {}}')).otherwise(c("ground_truth")))
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/metadata-{uuid.uuid4().hex}"
    P.write_metadata(meta.withColumn("ground_truth", bad), path)
    back = P.read_metadata(spark, path)
    good = back.filter(c("gt_ok")).select("split", F.lit("ok").alias("outcome"))
    rest = P.quarantined_targets(back).select("split", c("reason").alias("outcome"))
    return good.unionByName(rest).groupBy("split", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s_quarantine", T.with_truth(T.BANK, T.deposit_truth("bank")) + """
SELECT CASE WHEN k % 7 = 0 THEN 'acme' END AS vendor, file, CAST(2 AS BIGINT) AS n_pages, 'empty_file,page_count,unknown_vendor' AS reasons
FROM bank_t WHERE k % 7 IN (0, 1)""")
def s_quarantine(spark, sf):
    """Pages of an unregistered or NULL vendor reject their file; none vanishes."""
    pages = fx.doc_pages(spark, sf, ["bank"])
    k = _file_key()
    odd = pages.withColumn("vendor", F.when(k % 7 == 0, F.lit("acme")).when(k % 7 == 1, F.lit(None)).otherwise(c("vendor")))
    v = B.R.file_verdicts(B.V.extract_records(odd, ["bank"]))
    return v.filter(F.array_contains(F.split("reasons", ","), "unknown_vendor")).select("vendor", "file", "n_pages", "reasons")


def _file_key():
    return F.regexp_extract("file", r"/(\d+)\.pdf$", 1).cast("bigint")


@query("v_planted_reasons", T.ALL_TRUTH + """
SELECT 'utility' AS vendor, file, 'missing_bill_date' AS reason FROM utility_t WHERE k % 53 = 1
UNION ALL SELECT 'telecom', file, 'missing_bill_date' FROM telecom_t WHERE k % 23 = 2
UNION ALL SELECT 'telecom', file, 'missing_new_balance' FROM telecom_t WHERE k % 19 = 3
UNION ALL SELECT 'credit', file, 'missing_dates' FROM credit_t WHERE k % 29 = 4
UNION ALL SELECT 'utility', file, 'page_number' FROM utility_t WHERE k % 47 = 5
UNION ALL SELECT 'bank', file, 'empty_file' FROM bank_t WHERE k % 43 = 6""")
def v_planted_reasons(spark, sf):
    """V5/V6/V9: dates, balances, page numbers and whole texts taken out of rendered pages; every reject has its reason."""
    V = B.V
    k, first = _file_key(), c("page_idx") == 0
    gone = lambda pattern: F.regexp_replace("text", "(?U)" + pattern, "")
    vendor = lambda v: c("vendor") == v
    text = (F.when(vendor("utility") & (k % 53 == 1) & first, gone(V.UT_BILL_DATE))
            .when(vendor("utility") & (k % 47 == 5) & ~first, gone(V.UT_PAGE))
            .when(vendor("telecom") & (k % 23 == 2) & (k % 19 == 3) & first, F.regexp_replace(gone(V.TC_INVOICE_DATE), "Amount Due", ""))
            .when(vendor("telecom") & (k % 23 == 2) & first, gone(V.TC_INVOICE_DATE))
            .when(vendor("telecom") & (k % 19 == 3) & first, gone(V.TC_DUE))
            .when(vendor("credit") & (k % 29 == 4) & first, F.regexp_replace("text", "FROM", "BETWEEN"))
            .when(vendor("bank") & (k % 43 == 6), F.lit("")).otherwise(c("text")))
    recs = V.extract_records(fx.doc_pages(spark, sf).withColumn("text", text))
    planted = ["missing_bill_date", "missing_new_balance", "missing_dates", "page_number", "empty_file"]
    return B.R.reasons_table(B.R.file_verdicts(recs)).filter(c("reason").isin(*planted))


@query("v_repeated_pages", T.with_truth(T.TELECOM) + """
SELECT file, r_balance_mismatch OR (k % 5 = 2 AND NOT r_page_domain AND NOT r_missing_field AND gst <> CASE WHEN k % 2 = 0 THEN 0.01 ELSE 987654.32 END)
  AS mismatch FROM telecom_t""")
def v_repeated_pages(spark, sf):
    """V4: a second page 2 whose sum differs (lower or higher) rejects the file."""
    pages = fx.doc_pages(spark, sf, ["telecom"]).select("vendor", "file", "page_idx", "text")
    k = _file_key()
    amount = F.when(k % 2 == 0, F.lit("GST 5% \\$0.01")).otherwise(F.lit("GST 5% \\$987,654.32"))
    again = pages.filter((c("page_idx") == 1) & (k % 5 == 2)).withColumn("page_idx", F.lit(2)) \
        .withColumn("text", F.regexp_replace(c("text"), F.lit(r"GST 5% \$[\d,]+\.\d{2}"), amount))
    v = B.R.file_verdicts(B.V.extract_records(pages.unionByName(again), ["telecom"]))
    return v.select("file", F.array_contains(F.split("reasons", ","), "balance_mismatch").alias("mismatch"))


@query("d_truth_values", TW + """
SELECT file, page_idx, concat_ws('|', """ + ", ".join(f"coalesce({v}, '~')" for _, v in T.GT_LEAVES) + """) AS leaves FROM targets""")
def d_truth_values(spark, sf):
    """D3: every leaf value of the JSON target, read back from its text."""
    leaves = [F.coalesce(F.get_json_object("ground_truth", f"$.gt_parse.{path}"), F.lit("~")) for path, _ in T.GT_LEAVES]
    return B.targets(spark, sf).select("file", "page_idx", F.concat_ws("|", *leaves).alias("leaves"))


@query("t_json", """
SELECT event_id,
  '<s_a>t' || event_id || '</s_a><s_b>1<sep/>None<sep/><s_x>' || event_type || '</s_x></s_b><s_c>True</s_c>' AS sorted_seq,
  '<s_b>1<sep/>None<sep/><s_x>' || event_type || '</s_x></s_b><s_a>t' || event_id || '</s_a><s_c>True</s_c>' AS document_seq,
  '{"a": "t' || event_id || '", "b": ["1", "None", {"x": "' || event_type || '"}], "c": "True"}' AS back FROM events""")
def t_json(spark, sf):
    """T1/T2/T11 without a schema: nested JSON with lists and nulls to tagged text, sorted and in document order, and back."""
    ev = table(spark, sf, "events").select("event_id", "event_type")
    js = F.concat(F.lit('{"b": [1, null, {"x": "'), c("event_type"), F.lit('"}], "a": {"text_sequence": "t'),
                  c("event_id").cast("string"), F.lit('"}, "c": true}'))
    df = ev.select("event_id", js.alias("js"))
    df = df.select("event_id", S.linearise_json(c("js")).alias("sorted_seq"), S.linearise_json(c("js"), False).alias("document_seq"))
    return df.withColumn("back", S.parse_json(c("sorted_seq")))


@query("e_early_stop_gated", PW + f"""
SELECT epoch, round(v, {R9}) AS mean_score, CAST(since_best AS INTEGER) AS since_best,
  COALESCE(epoch = min(CASE WHEN since_best >= 2 THEN epoch END) OVER (), FALSE) AS stop
FROM (SELECT *, n - max(CASE WHEN bp IS NULL OR v > bp THEN n END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS since_best
  FROM (SELECT *, max(v) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bp
    FROM (SELECT *, row_number() OVER (ORDER BY epoch) AS n
      FROM (SELECT CAST(epoch AS BIGINT) AS epoch, avg(bm) AS v
            FROM (SELECT epoch, batch, avg(score) AS bm FROM scores WHERE (epoch + 1) % 2 = 0 GROUP BY epoch, batch) GROUP BY epoch))))""")
def e_early_stop_gated(spark, sf):
    """E6 + E7: patience counts the checks made every second epoch (max mode, patience 2)."""
    st = E.epoch_stats(E.gate(B.scores(B.predictions(spark, sf)), 0, 2))
    es = E.early_stop(st, "mean_score", 2, "max")
    return es.select(c("epoch").cast("bigint").alias("epoch"), F.round("mean_score", R9).alias("mean_score"), "since_best", "stop")


@query("i_decode", TW + """
SELECT file, page_idx, seq || '</s>' AS text FROM targets""")
def i_decode(spark, sf):
    """Label ids decoded by look-up give the target sequence."""
    df = S.label_ids(B.targets(spark, sf).select("file", "page_idx", "sequence"), "sequence")
    return df.select("file", "page_idx", S.decode_ids(c("labels")).alias("text"))


# =========================================================== subword labels
# Folder of the public tokenizers' vocabulary files, a parameter of the library; these queries use a byte-level one.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Entries of that vocabulary, and the one token of the format among them.
TOKENIZER_SIZE = 50257
TOKENIZER_HOLDS = "Bill"


@query("t_subword_decode", TW + """
SELECT file, page_idx, seq || '</s>' AS text, FALSE AS truncated FROM targets""")
def t_subword_decode(spark, sf):
    """T7 + I2 by a subword tokenizer: the labels of every target, decoded, are the target."""
    words = SW.Subwords.load(spark, TOKENIZER)
    df = words.label_ids(B.targets(spark, sf).select("file", "page_idx", "sequence"), "sequence")
    return df.select("file", "page_idx", words.decode(c("labels")).alias("text"), "truncated")


@query("t_subword_added", TW + f""",
lacks AS (SELECT list_filter({_VOCAB_SQL} || ['<sep/>', '</s>'], lambda x: x <> '{TOKENIZER_HOLDS}') AS tokens),
voc AS (SELECT unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM lacks),
used AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq || '</s>', '</?s_[A-Za-z0-9_]+>|</s>')) AS token FROM targets) GROUP BY token)
SELECT token, CAST({TOKENIZER_SIZE} + place AS INTEGER) AS token_id, TRUE AS is_new, coalesce(n, 0) AS n_labels FROM voc LEFT JOIN used USING (token)
WHERE token LIKE '<%s_%>' OR token = '</s>'""")
def t_subword_added(spark, sf):
    """T6 + I2: the format's tags that a subword vocabulary lacks, the ids they get, and how many labels have them."""
    words = SW.Subwords.load(spark, TOKENIZER)
    labels = words.label_ids(B.targets(spark, sf).select("sequence"), "sequence").select(F.array_remove("labels", F.lit(S.IGNORE_ID)).alias("ids"))
    # The outer form: of the inner one Spark derives a filter on the array, and runs the tokenizer for that once more.
    ids = labels.select(F.explode_outer("ids").alias("token_id"))
    n = ids.filter(c("token_id") >= words.base_size).groupBy("token_id").agg(F.count(F.lit(1)).alias("n_labels"))
    tags = words.tokens_df(spark).filter(c("token").like("<%s_%>") | (c("token") == "</s>"))  # a row for each token
    return F.broadcast(tags).join(n, "token_id", "left").select("token", "token_id", "is_new", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


@query("t_subword_documents", """
SELECT doc_id, md5(text) AS text_md5 FROM documents""")
def t_subword_documents(spark, sf):
    """T7 + I2 over whole documents of any length: subword ids without a cut, decoded, are the text."""
    words = SW.Subwords.load(spark, TOKENIZER, [])
    row_batches(spark)
    ids = table(spark, sf, "documents").select("doc_id", words.ids(c("text")).alias("ids"))
    return ids.select("doc_id", F.md5(words.decode(c("ids"))).alias("text_md5"))
