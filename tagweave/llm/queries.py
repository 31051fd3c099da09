"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import decontaminate, langid, lexical, linejoin, nearest, neardup, packing, partcodes, quality, slots, sql, substring, tilejoin, toxicity
from tagweave.llm.registry import register, table
from tagweave.session import scratch_path


@register()
def op7_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register(sql.PASSAGES)
def op5_passage_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register(sql.SHINGLE_COMPONENTS)
def op6_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register()
def op4_similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linejoin.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@register()
def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@register()
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.materialise(table(spark, sf_dir, "documents"), scratch_path(spark, "training"))


def held_out() -> Column:
    """Rows that teach nothing: one in three, by the checksum of the id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@register()
def op8_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@register()
def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = langid.identify(docs, langid.fit(docs, ~held_out()))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register()
def op1_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", F.size("votes").alias("n_votes"), "posterior", "score", "keep")


@register()
def op3_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register(sql.JACCARD_COMPONENTS)
def op11_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tilejoin.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


@register(sql.PART_CODES)
def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = partcodes.encode_parts(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(partcodes.codebooks_sha256(books)).alias("codebooks_sha256"))


@register(sql.RANKED_DOCUMENTS)
def op13_ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
