"""The queries of this package and their SQL. Each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_wrappers, mixing, packing, quality_classifier, quality_rules, sharding, simhash, store, token_store, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, store.new_path(spark, "digests"))
    out = exact_dedup.label_duplicates(_table(spark, sf_dir, "documents"), index)
    index.close()
    return out


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), trusted)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, quality_classifier.grades_of_labels(_table(spark, sf_dir, "labels")), 3)
    return quality_classifier.score_documents(docs, model)


def tokenizer_path() -> str:
    """The public tokenizer of the contracts, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.capture_histories(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.read_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_text(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_shards, op2_exact_dedup, op3_quality_rules, op4_mixture, op5_quality_classifier, op6_packing, op7_warc, op8_token_files, op9_simhash, op10_html_text,
    ]
    return {f.__name__: f for f in found}


OP2_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select *, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
    row_number() over (partition by text_sha256, doc_id) as nth from d)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id) and nth = 1 as kept, text_sha256 from g
"""

OP7_SQL = r"""
with p as (select page_id, lower(trim(coalesce(url, ''))) as u, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, u, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest,
    string_split(regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1), '^www[0-9]*[.]', ''), '.') as labels,
    regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, array_to_string(list_sort(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&')), '&') as query from p),
r as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id,
    case when u = '' then '' else array_to_string(list_reverse(labels), ',') || ')' || case when path = '' then '/' else path end || case when query = '' then '' else '?' || query end end as url_key from d)
-- a page was taken at the second of its id, so the merged index goes by URL key and id
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id <> first_id then first_id end as refers_to, row_number() over (order by encode(url_key), page_id) - 1 as place from r
"""

OP4_SQL = r"""
with recursive d0 as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
-- a document weighs in proportion to its words, from half of 200 to twice as many, in sixteenths
d as (select *, round(least(2.0::double, greatest(0.5::double, size / 200.0::double)) * 16)::bigint as w from d0),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, ([5, 2, 1])[((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::bigint as weight from s),
-- one round of stopping at the ceiling after another, as the words of the rule have it
r as (select 0 as round, source, source_size, weight, false as capped, 1.5 * (sum(source_size) over ()) / (sum(weight) over ()) as level from n
    union all
    select round + 1, source, source_size, weight, now as capped, case when now_rest > 0 then (1.5 * now_all - 2 * now_full) / now_rest else level end
    from (select *, sum(case when now then 0 else weight end) over () as now_rest, sum(source_size) over () as now_all, sum(case when now then source_size else 0 end) over () as now_full,
              sum(case when now and not capped then 1 else 0 end) over () as newly
          from (select *, capped or 2 * source_size::double / weight < level as now from r))
    where newly > 0),
t as (select source, source_size, least(2 * source_size::double, level * weight) as target from r where round = (select max(round) from r)),
-- the rate that makes min(2, rate * w) times sizes the target: weights in falling order reach 2 first
l0 as (select source, w, sum(size)::bigint as level_size from d group by source, w),
l1 as (select l0.*, t.target, coalesce(sum(level_size) over (partition by l0.source order by w desc rows between unbounded preceding and 1 preceding), 0)::bigint as full_size,
    (sum(w * level_size) over (partition by l0.source order by w desc rows between current row and unbounded following))::bigint as weighted from l0 join t on l0.source is not distinct from t.source),
l as (select source, min_by(rate, -w) filter (where rate * w <= 2) as rate from (select *, case when weighted > 0 then (target - 2 * full_size) / weighted end as rate from l1) group by source),
e as (select d.doc_id, d.size, t.source, t.source_size, t.target, d.u, coalesce(least(2.0::double, l.rate * d.w), 2.0::double) as e
    from d join t on d.source is not distinct from t.source join l on d.source is not distinct from l.source),
p as (select *, floor(e) as certain, e - floor(e) as p from e),
q as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q, target - sum(certain * size) over (partition by source) as need from p),
c as (select *, sum(size) over (partition by source order by q, doc_id, size rows unbounded preceding) as upto from q where p > 0
    union all select *, 0 from q where p <= 0)
select doc_id, size, source_size, round(target, 6) as target, ((certain + case when p > 0 and upto - size / 2.0 <= need then 1 else 0 end) * size)::bigint as taken from c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op4_mixture": OP4_SQL, "op7_warc": OP7_SQL}
