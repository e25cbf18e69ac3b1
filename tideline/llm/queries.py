"""The operators as queries over the corpus tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, hard_negatives, hilbert, html_text, language_id, minhash, packing, pii, prefix_trie, quality, spaced_seeds, suffix_dedup, toxicity
from .common import table


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op6_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op11_segment_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", hard_negatives.relabelled(rows["vec_id"], rows["label"], 7, 10)))


def op12_z_fast_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), every=5, heads=9)


def op13_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity_mil, op2_hilbert_shards, op3_best_fit_packing, op4_minhash_near_dedup, op5_bit_sliced_top_k, op6_quality_ftrl, op7_html_extraction, op8_pii_weak_supervision, op9_spaced_seed_decontamination, op10_suffix_array_dedup, op11_segment_hard_negatives, op12_z_fast_prefix_trie, op13_kneser_ney_language_id)}
ORACLE_SQL: dict[str, str] = {
    "op5_bit_sliced_top_k": """
        with v as (
            select vec_id, [floor(256 * cast(x as double)) for x in embedding] as q
            from embeddings
            where embedding is not null and vec_id is not null
              and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
        s as (
            select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
            from v a join v b on a.vec_id <> b.vec_id
            where a.vec_id % 50 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
        from s
        qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
    "op11_segment_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   [floor(256 * cast(x as double)) for x in embedding] as q
            from embeddings
            where embedding is not null and vec_id is not null and label is not null
              and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
        s as (
            select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, cast(list_inner_product(a.q, b.q) as bigint) as score
            from v a join v b on a.vec_id <> b.vec_id
            where a.vec_id % 100 = 0),
        p as (
            select anchor_id, vec_id as positive_id, score as positive_score,
                   cast(row_number() over (partition by anchor_id order by score desc, vec_id) as int) as positive_rank
            from s where label = anchor_label
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (
            select p.*, s.vec_id as negative_id, s.score as negative_score
            from p join s using (anchor_id)
            where s.label <> s.anchor_label and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
        select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as int) as rank,
               negative_id, positive_score, negative_score, positive_rank
        from n
        qualify row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) <= 10""",
    # The first CTEs are the CRC-32 of the ids' digits, bit by bit; paths are lists of turns, and a node is a list.
    "op12_z_fast_prefix_trie": """
        with recursive crc(conv_id, s, step, c) as (
            select distinct conv_id, cast(conv_id as varchar), 0, cast(4294967295 as bigint) from conversations where conv_id is not null
            union all
            select conv_id, s, step + 1, case when x & 1 = 1 then xor(x >> 1, cast(3988292384 as bigint)) else x >> 1 end
            from (select *, case when step % 8 = 0 then xor(c, cast(ascii(substr(s, step // 8 + 1, 1)) as bigint)) else c end as x from crc where step < 8 * length(s))),
        own as (
            select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first) as turns
            from conversations where conv_id is not null group by conv_id),
        built as (
            select o.conv_id, list_concat(coalesce(b.turns[1:h.h], []), o.turns[h.h + 1:]) as path
            from own o join (select conv_id, xor(c, cast(4294967295 as bigint)) % 9 as h from crc where step = 8 * length(s)) h using (conv_id)
            left join own b on b.conv_id = o.conv_id - o.conv_id % 5),
        steps as (select conv_id, len(path) as n, unnest(range(0, len(path) + 1)) as depth, path from built),
        nodes as (
            select path[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs,
                   sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth), '')) as ends_sha256
            from steps group by 1, 2),
        kids as (select node[1:depth - 1] as node, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2),
        full_ as (select n.*, coalesce(k.n_children, 0) as n_children, case when n.depth > 0 then (n.n_convs - 1) * octet_length(encode(n.node[n.depth].t)) else 0 end as saved from nodes n left join kids k using (node, depth)),
        above as (select node[1:up] as node, up as depth, sum(saved) as saved_tokens, count(case when n_children = 0 then 1 end) as n_leaves
                  from (select *, unnest(range(0, depth + 1)) as up from full_) group by 1, 2)
        select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, a.n_leaves, cast(a.saved_tokens as bigint) as saved_tokens, f.ends_sha256
        from full_ f join above a using (node, depth) left join nodes p on p.depth = f.depth - 1 and p.node = f.node[1:f.depth - 1]""",
}
