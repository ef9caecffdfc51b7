"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_site_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.style_tree import main_text

    return main_text(table(spark, folder, "pages"))


def op3_impact_ordered_search(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.impact_index import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.line_rules import line_rules

    return line_rules(table(spark, folder, "documents")).select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_tournament_packing(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.packing import pack

    return pack(table(spark, folder, "documents"))


def op6_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.partenum import jaccard_components

    return jaccard_components(table(spark, folder, "documents"))


def op7_heap_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.token_count import token_counts

    return token_counts(table(spark, folder, "documents"))


def op8_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.kneser_ney import score

    return score(table(spark, folder, "documents"))


def op9_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.pseudonyms import pseudonymise

    return pseudonymise(table(spark, folder, "documents")).select(F.col("doc.doc_id").alias("doc_id"), "n_found", "n_replaced", F.col("cleaned").alias("text"))


def op10_template_tree(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.templates import drop_recurring

    return drop_recurring(table(spark, folder, "documents")).select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("cleaned").alias("text"))


def op11_angular_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.angular_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.two_fit import pack_two_fit

    return pack_two_fit(table(spark, folder, "documents")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from panelscope.llm.merkle import manifest

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(table(spark, folder, "documents"), {"n_chars": F.col("n_chars") + 1}, tampered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {name: fn for name, fn in globals().items() if name.startswith("op") and name[2:3].isdigit()}
    found = dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from panelscope.llm.oracles import SQL

    return dict(SQL)
