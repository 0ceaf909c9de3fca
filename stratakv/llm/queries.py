"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, language_model, mixing, quality_classifier, quality_rules, simhash, toxicity, url_filter
from .common import remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("failed")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_classifier.classify(docs, quality_classifier.train(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.classify(docs, toxicity.train(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_simhash_near_dedup, op3_url_filter, op4_exact_dedup, op5_pitman_yor_lm, op6_adaptive_quality, op7_source_mixing, op8_byte_bpe, op9_quality_classifier, op10_toxicity)}

ORACLES: dict[str, str] = {
    "op3_url_filter": r"""
with rules(r_host, r_path, r_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p as (select page_id, coalesce(substr(url, instr(url, '://') + 3), '') as rest, coalesce(instr(url, '://'), 0) > 0 as there from pages),
q as (select page_id, case when there then translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
  case when there then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path from p),
m as (select q.*, r_host || r_path as rule, r_verdict, row_number() over (partition by page_id order by length(r_host) desc nulls last, length(r_path) desc) as k
  from q left join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from m where k = 1""",
    "op4_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from n window w as (partition by norm)""",
    "op7_source_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || substr(md5('mix' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
c as (select *, (rank % 3 + 1)::bigint as weight, 3 * source_size as cap, (3 * source_size)::double / (rank % 3 + 1)::double as ratio from w),
l as (select *, ((sum(source_size) over () - coalesce(sum(cap) over b, 0))::double / (sum(weight) over () - coalesce(sum(weight) over b, 0))::double) as level
  from c window b as (order by ratio, rank rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when source_size = 0 then 0.0 else least(cap::double, weight * (max(case when level <= ratio then level end) over ())) end as target from l),
b as (select *, floor(target)::bigint as budget from t),
e as (select *, case when source_size = 0 then 0 else budget // source_size end as turns from b),
r as (select d.doc_id, d.size, e.source_size, e.target, e.turns, e.budget - e.turns * e.source_size as rest,
  sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as before
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (turns * size + greatest(0, least(size, rest - before)))::bigint as taken from r""",
}
