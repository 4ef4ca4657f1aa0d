"""The ``opN_<name>`` queries of this subpackage over the given tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, html_extract, knn, language_id, language_model, line_dedup, mixing, periodic_runs, sharding, simhash, url_filter,
               warc, whitening)
from .common import WORD

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn(spark, sf_dir):
    return knn.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_warc(spark, sf_dir):
    index = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_records(index)


def op4_html_extract(spark, sf_dir):
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def _fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op3_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))[1].drop("body", "source")


def op5_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(_read(spark, sf_dir, "pages"), rules)


def op6_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_language_model(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 5) == 1, F.lit(False))
    out = language_model.score(docs, ~held_out)
    return out.withColumn("held_out", ~F.col("trained")).drop("trained")


def op8_simhash(spark, sf_dir):
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    told = language_id.predict(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_decontamination(spark, sf_dir):
    found = decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("body")


def op11_sharding(spark, sf_dir):
    return sharding.shard_rows(_read(spark, sf_dir, "documents"), n_shards=8, keep=["doc_id"])


def planted_runs(docs):
    """(doc_id, text) where a tenth of the ids repeat from word a on with period p, as the contract of op12 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    docs = docs.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    place = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    words = F.transform(place, lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(planted_runs(_read(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select("doc_id", "n_runs", "top.start", "top.length", "top.period",
                        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
                        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_whitening(spark, sf_dir):
    white = whitening.whiten(_read(spark, sf_dir, "embeddings"), components=32, scale=64, offset=1_000_000)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("pos", "c")
    out = white.select("vec_id", "n", "deviation", "identity_error", each)
    return out.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


QUERIES = {"op1_knn": op1_knn, "op2_warc": op2_warc, "op3_mixing": op3_mixing, "op4_html_extract": op4_html_extract,
           "op5_url_filter": op5_url_filter, "op6_line_dedup": op6_line_dedup,
           "op7_language_model": op7_language_model, "op8_simhash": op8_simhash, "op9_language_id": op9_language_id,
           "op10_decontamination": op10_decontamination, "op11_sharding": op11_sharding, "op12_periodic_runs": op12_periodic_runs,
           "op13_whitening": op13_whitening}

ORACLE = {
    "op1_knn": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5""",
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as sha, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(((cast('0x' || substr(sha, cast((i // 4) * 5 + 1 as int), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31) + 1 as int), 1)), '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from p""",
    "op3_mixing": r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                  md5(coalesce(cast(doc_id as varchar), '')) as ord from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as k from d group by source),
c as (select *, case k % 3 when 1 then 5 when 2 then 2 else 1 end as w, 3 * source_size as cap from s),
o as (select *, row_number() over (order by cap / w, source nulls last) as i from c),
v as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by i rows between unbounded preceding and 1 preceding), 0) as rest,
             sum(w) over () - coalesce(sum(w) over (order by i rows between unbounded preceding and 1 preceding), 0) as w_rest from o),
l as (select *, case when cast(rest as double) / cast(w_rest as double) * w <= cap then cast(rest as double) / cast(w_rest as double) end as lv from v),
t as (select source, source_size, least((select lv from l where lv is not null order by i limit 1) * w, cast(cap as double)) as target, cap from l),
p as (select d.*, t.source_size, t.target, cast(least(round(t.target), t.cap) as bigint) as words,
             cast(coalesce(sum(size) over (partition by d.source order by ord, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when size = 0 then 0 else cast(words // source_size * size
         + greatest(0, least(words % source_size, start + size) - start) as bigint) end as taken from p""",
    "op5_url_filter": r"""
with r(h, p, v) as (values ('org','/','allow'),('example.org','/es/','block'),('example.org','/en/1','block'),('com','/fr/','allow'),('com','/de/','block')),
u as (select row_number() over () as n, page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
m as (select u.n, h || p as rule, v, row_number() over (partition by u.n order by length(h || p) desc) as k
      from u join r on (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from u left join m on u.n = m.n and m.k = 1""",
    "op6_line_dedup": r"""
with l as (select doc_id, row_number() over () as n, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, n, unnest(ls) as line, unnest(range(len(ls))) as pos, len(ls) as c from l),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
g as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, g.owner is not null and g.owner <> k.doc_id as gone from k left join g on k.key = g.key)
select any_value(doc_id) as doc_id, any_value(cast(c as bigint)) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from j group by n""",
    "op11_sharding": r"""
with recursive bits(n, i, c) as (select cast(range as bigint), 0, cast(range as bigint) from range(256)
  union all select n, i + 1, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) from bits where i < 8),
crc as (select list(c order by n) as t from bits where i = 8),
d as (select doc_id, coalesce(text, '') as text, row_number() over () as n from documents),
k as (select doc_id, cast(strlen(text) + 1 as bigint) as size,
             list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) as bytes,
             md5(text)[:16] || md5(coalesce(cast(doc_id as varchar), ''))[:16] || md5(cast(n as varchar))[:16] as key from d),
e as (select g.d, substr(key, 1, g.d) as edge, sum(size) as b from k, (select 3 * range + 3 as d from range(16)) g group by all),
f as (select d, edge, coalesce(sum(b) over (partition by d order by edge rows between unbounded preceding and 1 preceding), 0) as below from e
      union all select range * 3 + 3, 'g', (select sum(size) from k) from range(16)),
t as (select i.range as i, (select sum(size) from k) / 8.0 as share from range(1, 8) i),
s as (select i, edge, row_number() over (partition by i order by abs(below - i * share) > 0.005 * share and d < 48, d, abs(below - i * share), below) as r from f, t),
a as (select k.*, cast((select count(*) from s where r = 1 and s.edge <= k.key) as integer) as shard from k)
select doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[cast(xor(c, x) & 255 as int) + 1])), 4294967295) as text_crc32,
       'bytes' as law, shard, row_number() over (partition by shard order by key) - 1 as slot, cast(null as integer) as grown_shard from a, crc""",
}
