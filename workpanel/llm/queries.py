"""The registered queries: each applies one operator, with production
parameters, to its whole table.  ``ORACLES`` holds DuckDB SQL for those that
SQL can express; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workpanel.llm.common import table
from workpanel.llm.decontamination import contaminated
from workpanel.llm.hard_negatives import hard_negatives
from workpanel.llm.language import languages
from workpanel.llm.ngram_join import ngram_components
from workpanel.llm.oracle_sql import COLLOCATIONS, DECONTAMINATION, HARD_NEGATIVES, LINE_RULES
from workpanel.llm.packing import pack_documents
from workpanel.llm.phrases import collocations
from workpanel.llm.pii import pseudonymise
from workpanel.llm.quality_classifier import quality_scores
from workpanel.llm.quality_rules import clean_lines
from workpanel.llm.quotations import chat_messages
from workpanel.llm.sharding import shard_documents
from workpanel.llm.token_counts import token_counts
from workpanel.llm.toxicity import toxicity_scores

TOKEN_LIMIT = 1024


def pii_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms; a deployment sets ``spark.workpanel.pii.key``."""
    return spark.conf.get("spark.workpanel.pii.key", "workpanel-test-key")


def tokenizer_file(name: str) -> str:
    """The tokenizers' folder is a parameter: ``WORKPANEL_TOKENIZERS``, else the installed package."""
    if folder := os.environ.get("WORKPANEL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudonymise(docs.select("doc_id", "text"), pii_key(spark))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_universe_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          "base_failed", "kept", "n_lines", "n_bad_lines")


def fold(n: int) -> Column:
    """The row's fold: crc32 of its id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold(4) == 2, F.lit(False))
    scored = quality_scores(docs, labels.filter(fold(4) != 2), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_messages(table(spark, sf_dir, "conversations"))


def op9_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op10_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold(5) == 0, F.lit(False))
    scored = toxicity_scores(docs, ~held, labels.filter(fold(5) != 0).select("doc_id", "toxic"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_four_russians_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


def op12_byte_convolution_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(4) == 2, F.lit(False))
    learn = F.coalesce(fold(4) != 2, F.lit(False))
    return languages(docs, learn).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op13_dynamic_itemset_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_feistel_pseudonyms, op2_spaced_seed_decontamination,
    op3_universe_partition_join, op4_line_first_rules,
    op5_positive_unlabelled_quality, op6_shortest_pack_first,
    op7_two_tier_token_counts, op8_quotation_linking, op9_balanced_label_propagation,
    op10_weak_supervision_toxicity, op11_four_russians_hard_negatives,
    op12_byte_convolution_language, op13_dynamic_itemset_collocations)}

ORACLES = {
    "op2_spaced_seed_decontamination": DECONTAMINATION,
    "op4_line_first_rules": LINE_RULES,
    "op11_four_russians_hard_negatives": HARD_NEGATIVES,
    "op13_dynamic_itemset_collocations": COLLOCATIONS,
}
