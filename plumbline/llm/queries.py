"""One query per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.ann import nearest_neighbours
from plumbline.llm.base import table
from plumbline.llm.bpe import decoded, encoded, id_count
from plumbline.llm.brown import class_scores
from plumbline.llm.collocations import collocations
from plumbline.llm.conversations import damaged, repaired_conversations
from plumbline.llm.decontaminate import contamination
from plumbline.llm.jaccard import jaccard_components
from plumbline.llm.langid import identified
from plumbline.llm.lines import deduplicated_lines
from plumbline.llm.mixing import mixture
from plumbline.llm.records import token_records
from plumbline.llm.secrets import count_of, joined, secret_spans
from plumbline.llm.toxicity import toxicity
from plumbline.session import spread


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return report.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("base"), F.col("spans")
    counts = [count_of(base, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), count_of(spans, "random").alias("n_random"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def op10_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(damaged(table(spark, sf_dir, "conversations")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    coded = docs.select("doc_id", encoded(F.col("text"), *vocabulary).alias("ids"))
    return coded.select(
        "doc_id",
        id_count(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), *vocabulary), 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_decontaminate": op2_decontaminate,
    "op3_jaccard": op3_jaccard,
    "op4_secrets": op4_secrets,
    "op5_token_records": op5_token_records,
    "op6_toxicity": op6_toxicity,
    "op7_mix_sources": op7_mix_sources,
    "op8_line_dedup": op8_line_dedup,
    "op9_language": op9_language,
    "op10_class_model": op10_class_model,
    "op11_collocations": op11_collocations,
    "op12_conversations": op12_conversations,
    "op13_byte_bpe": op13_byte_bpe,
}
