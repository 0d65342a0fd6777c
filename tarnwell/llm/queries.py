"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import langid, linecrf, oracles, quality
from tarnwell.llm.align import cross_alignment
from tarnwell.llm.chat import preference_pairs, runs_text
from tarnwell.llm.decontam import decontaminate
from tarnwell.llm.hnsw import near_vectors
from tarnwell.llm.licenses import scan_licenses
from tarnwell.llm.near_dups import near_duplicates
from tarnwell.llm.packing import pack
from tarnwell.llm.repeats import remove_repeats
from tarnwell.llm.ring import bounded_ring_shards
from tarnwell.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    light = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return bounded_ring_shards(light, "doc_id").withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op4_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    dictionaries = langid.train(docs.where(~held_out))
    return langid.predict(docs, dictionaries).withColumn("held_out", held_out)


def op5_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("h1", "h2", "group_class")


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    turns = table(spark, sf_dir, "conversations").withColumns({"pair_id": F.shiftright("conv_id", 1), "side": F.col("conv_id").bitwiseAND(F.lit(1).cast("long"))})
    made = preference_pairs(turns, "pair_id", "side")
    return made.withColumns({"chosen_mask": runs_text(F.col("chosen_mask")), "rejected_mask": runs_text(F.col("rejected_mask"))})


OP7_SQL = """
with t as (
  select conv_id >> 1 as pair_id, conv_id & 1 as side, role, text,
         '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) as shown,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from conversations where conv_id is not null),
m as (
  select coalesce(c.pair_id, r.pair_id) as pair_id,
         min(coalesce(c.k, r.k)) filter (where c.k is null or r.k is null or c.role is distinct from r.role or c.text is distinct from r.text) as odd,
         max(c.k) as nc, max(r.k) as nr
  from (select * from t where side = 0) c full join (select * from t where side = 1) r on c.pair_id = r.pair_id and c.k = r.k group by 1),
n as (select pair_id, nc, nr, coalesce(odd - 1, nc) as np from m),
x as (
  select t.*, np, coalesce(sum(length(shown)) over (partition by t.pair_id, side order by k rows between unbounded preceding and 1 preceding), 0) as b,
         coalesce(sum(case when k <= np then length(shown) end) over (partition by t.pair_id, side), 0) as p
  from t join n on t.pair_id = n.pair_id)
select n.pair_id, n.np as n_prompt, n.nc - n.np as n_chosen, n.nr - n.np as n_rejected,
       coalesce(string_agg(shown, '' order by k) filter (where side = 0 and k <= n.np), '') as prompt,
       case when nc is not null then coalesce(string_agg(shown, '' order by k) filter (where side = 0 and k > n.np), '') end as chosen,
       case when nr is not null then coalesce(string_agg(shown, '' order by k) filter (where side = 1 and k > n.np), '') end as rejected,
       case when nc is not null then coalesce(string_agg((b - p + instr(shown, chr(10)))::bigint || '-' || (b - p + length(shown))::bigint, ',' order by k) filter (where side = 0 and k > n.np and role = 'assistant'), '') end as chosen_mask,
       case when nr is not null then coalesce(string_agg((b - p + instr(shown, chr(10)))::bigint || '-' || (b - p + length(shown))::bigint, ',' order by k) filter (where side = 1 and k > n.np and role = 'assistant'), '') end as rejected_mask
from n join x on n.pair_id = x.pair_id group by n.pair_id, n.np, n.nc, n.nr
"""


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_hnsw_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linecrf.rule_lines(docs, linecrf.train(docs, table(spark, sf_dir, "labels"))).drop("boilerplate")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return cross_alignment(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


QUERIES = {"op1_ring_shards": op1_ring_shards, "op2_winnowing": op2_winnowing, "op3_license_scan": op3_license_scan, "op4_compression_langid": op4_compression_langid, "op5_minhash_near_dups": op5_minhash_near_dups, "op6_quality_cotraining": op6_quality_cotraining, "op7_preference_pairs": op7_preference_pairs, "op8_cost_packing": op8_cost_packing, "op9_hnsw_near_dups": op9_hnsw_near_dups, "op10_suffix_repeats": op10_suffix_repeats, "op11_line_labels": op11_line_labels, "op12_whitening": op12_whitening, "op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {"op2_winnowing": oracles.WINNOWING, "op5_minhash_near_dups": oracles.NEAR_DUPLICATES, "op7_preference_pairs": OP7_SQL, "op9_hnsw_near_dups": oracles.NEAR_VECTORS, "op10_suffix_repeats": oracles.REPEATS}
