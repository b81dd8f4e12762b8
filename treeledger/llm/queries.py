"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import ann, chat, html_extract, media, mixing, near_dedup, pii, piece_codec, quality, url_filter
from treeledger.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path() -> str:
    """Place of the public vocabulary file; each executor finds its own copy."""
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_table(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_table(table(spark, sf_dir, "documents"), piece_model_path())


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_conversations(turns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(table(spark, sf_dir, "documents"), words=4)


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return media.find_copies(media.render(vectors, copies=True), media.render(vectors))


OP7_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
  cast(sum(24 + length(replace(replace(role, '<|', '<||'), chr(10), '<|n|>')) + length(replace(text, '<|', '<||'))) as bigint) as formatted_chars
from turns group by conv_id
"""

OP8_SQL = r"""
with recursive docs as (
  select doc_id, source, coalesce('=' || source, 'null') as key,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as words
  from documents
),
totals as (select key, cast(sum(words) as bigint) as sum, count(*) as docs from docs group by key),
ends as (select min(sum) filter (sum > 0) / cast(max(sum) as double) as ratio, max(sum) as top from totals),
halves as (
  select 0 as i, cast(0 as double) as lo, cast(1 as double) as hi
  union all
  select i + 1, case when pow(ratio, (lo + hi) / 2 - 1) <= 2 then lo else (lo + hi) / 2 end, case when pow(ratio, (lo + hi) / 2 - 1) <= 2 then (lo + hi) / 2 else hi end
  from halves, ends where i < 50
),
exponent as (select case when pow(ratio, -1) <= 2 then 0 else ceil(hi * 1000000) / 1000000 end as a, top from halves, ends where i = 50),
micro as (
  select key, sum, docs, case when sum > 0 then cast(round(pow(sum / cast(top as double), a - 1) * 1000000) as bigint) else 1000000 end as micro
  from totals, exponent
),
plan as (
  select *, (micro // 1000000) * sum + ((micro % 1000000) * sum) // 1000000 as budget, cast(micro // 1000000 as int) as full_passes from micro
),
sized as (select *, budget - full_passes * sum as rest, greatest(1, cast(ceil(sum(budget) over () / 1000000.0) as bigint), cast(ceil(sum(docs) over () / 200000.0) as bigint)) as blocks from plan),
copies as (
  select doc_id, source, d.key, words, sum, budget, full_passes, rest, blocks, cast(e.epoch as int) as epoch,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || '-' || cast(e.epoch as varchar)), 1, 15) as bigint) as h
  from docs d join sized using (key), lateral (select unnest(range(0, case when rest > 0 then full_passes + 1 else full_passes end)) as epoch) e
),
summed as (select *, sum(words) over (partition by key, epoch order by h) as upto from copies),
taken as (
  select *, cast(case when budget > 0 then least(floor((epoch * sum + upto - words) / cast(budget as double) * blocks), blocks - 1) else h % blocks end as bigint) as block
  from summed where epoch < full_passes or upto <= rest
)
select doc_id, source, words, epoch, block, cast(row_number() over (partition by block order by h, doc_id nulls first, key, words) as int) as place
from taken
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_html_extract": op2_html_extract,
    "op3_quality": op3_quality,
    "op4_piece_codec": op4_piece_codec,
    "op5_nearest": op5_nearest,
    "op6_pii": op6_pii,
    "op7_chat_format": op7_chat_format,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_media_copies": op10_media_copies,
}

SQL: dict[str, str] = {"op7_chat_format": OP7_SQL, "op8_mixing": OP8_SQL}
