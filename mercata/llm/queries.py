"""Registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from mercata.llm import (
    chat, decontaminate, embedding_lsh, licenses, line_dedup, main_text, packing, prefix_trie, quality, repair, sharding, simhash, warc,
)
from mercata.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10
    )
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / lang / thousands of the id (none: the directory above) / id."""
    docs = table(spark, sf_dir, "documents")
    group = F.expr("doc_id div 1000")
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.when(group > 0, group.cast("string")), F.col("doc_id").cast("string")
    )
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")), id_col="doc_id", count_all=True)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves go into the shards; what is told of them is read off the rows there."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select(
        "doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its neighbour's last answer (no turns if that leaves none)."""
    turns = table(spark, sf_dir, "conversations")
    out = chat.format_pairs(turns, chat.swapped_answers(turns), key="conv_id", keep_chosen=True)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select(
        "conv_id",
        "n_prompt",
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen", 256).alias("chosen_sha256"),
        F.sha2("rejected", 256).alias("rejected_sha256"),
        spans("chosen_spans").alias("chosen_spans"),
        spans("rejected_spans").alias("rejected_spans"),
        "same",
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.extract(table(spark, sf_dir, "pages"), min_tokens=8)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_removed")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.repair(repair.damage(table(spark, sf_dir, "conversations")))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return out.select(F.col("id").alias("conv_id"), *counts, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.rebuild(prefix_trie.sequences(table(spark, sf_dir, "conversations")), every=20, heads=4)
    return prefix_trie.prefix_trie(convs).drop("node", "parent")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_warc": op5_warc,
    "op6_license_scan": op6_license_scan,
    "op7_shard": op7_shard,
    "op8_preference_pairs": op8_preference_pairs,
    "op9_quality": op9_quality,
    "op10_pack": op10_pack,
    "op11_main_text": op11_main_text,
    "op12_repair": op12_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
