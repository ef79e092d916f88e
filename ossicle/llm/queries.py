"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fmindex, mixing, neighbours, packing, quality, sharding, simhash, store, suffix, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=2)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), every=100, k=10)


def tokenizer_path() -> str:
    """The vocabulary file that the queries take; operators get any path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_digests(read(spark, sf_dir, "documents"), length=50)


def op5_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stored_documents(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents").select("doc_id"), shards=64, size=4099)


def op7_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.removed_digests(read(spark, sf_dir, "documents"), length=35)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return urls.judge(read(spark, sf_dir, "pages"), labels.select("doc_id", (1 - labels.quality).alias("bad")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"), block_size=16, temperature=0.5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Every 50-byte string of every text by its hex digits, and whether a smaller doc_id has it, too.
SUFFIX_SQL = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, unnest(range(n - 49)) as i, h from d where n >= 50),
s as (select doc_id, i, substr(h, 2 * i + 1, 100) as win from w),
o as (select win, min(doc_id) as owner from s group by 1),
r as (select s.doc_id, s.i from s join o using (win) where o.owner < s.doc_id),
g as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 50, true)::int as new from r),
m as (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as k from g),
p as (select doc_id, k, min(i) as a, max(i) + 50 as b from m group by all),
q as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before, lead(a) over (partition by doc_id order by a) is null as last from p),
t as (select q.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, (2 * before + 1)::bigint, (2 * (a - before))::bigint) || case when last then substr(h, (2 * b + 1)::bigint) else '' end, '' order by a) as kept from q join d using (doc_id) group by 1)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join t using (doc_id)
"""

#: Every window of 35 words by its text, and whether it starts twice or more.
WINDOWS_SQL = """
with d as (select doc_id, row_number() over () as row, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select row, unnest(range(len(ws) - 34)) as i, ws from d where len(ws) >= 35),
s as (select row, i, md5(array_to_string(ws[i + 1 : i + 35], ' ')) as win from w),
o as (select win from s group by 1 having count(*) > 1),
r as (select distinct row, i + j as i from s semi join o using (win), range(35) t(j)),
k as (select d.row, list(ws[x.i + 1] order by x.i) as kept, count(*) as n from d, lateral (select unnest(range(len(d.ws))) as i) x anti join r on r.row = d.row and r.i = x.i group by 1)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(array_to_string(coalesce(kept, []), ' ')) as kept_sha256 from d left join k using (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix": SUFFIX_SQL, "op6_sharding": sharding.sql("documents", "doc_id", 64, 4099), "op7_fmindex": WINDOWS_SQL}
