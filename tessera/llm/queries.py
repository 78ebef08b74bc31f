"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosted, chat, infill, line_dedup, maxscore, merkle, mixing, onebit, packing, quality_rules, rans, repeats, simhash
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


#: A conversation whose texts hold the template's own control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_trees(chat.reply_chains(turns)))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(spark, table(spark, sf_dir, "documents"))


def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.integer_vectors(table(spark, sf_dir, "embeddings"))
    return maxscore.search(vectors.where(F.col("vec_id") % 20 == 0), vectors)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = boosted.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = onebit.real_vectors(table(spark, sf_dir, "embeddings"))
    return onebit.search(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents"), merkle.lower_some()))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_chat_format,
        op3_best_fit_packing,
        op4_suffix_array_dedup,
        op5_mix_sources,
        op6_simhash_near_dedup,
        op7_quality_rules,
        op8_token_output,
        op9_maxscore_topk,
        op10_quality_classifier,
        op11_one_bit_search,
        op12_fill_in_middle,
        op13_merkle_manifest,
    )
}
ORACLE_SQL = {"op1_line_dedup": line_dedup.oracle(), "op5_mix_sources": mixing.oracle(), "op13_merkle_manifest": merkle.oracle()}
