"""Queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from paceline.llm import docprint, langid, leakage, linedup, mixture, resample, secretscan, shards, simhash, suffixmerge, tokenalign, toxicity, wordrepeat
from paceline.llm.common import documents

QUERIES = {
    "op1_suffix_array_dedup": lambda spark, d: suffixmerge.byte_report(documents(spark, d)),
    "op2_source_mixture": lambda spark, d: mixture.mixture_report(documents(spark, d)),
    "op3_line_dedup": lambda spark, d: linedup.line_report(documents(spark, d)),
    "op4_secret_scan": lambda spark, d: secretscan.scan(documents(spark, d)),
    "op5_substring_dedup": lambda spark, d: wordrepeat.word_report(documents(spark, d)),
    "op6_shuffle_shards": lambda spark, d: shards.shard_report(documents(spark, d)),
    "op7_simhash_near_dedup": lambda spark, d: simhash.near_duplicate_report(documents(spark, d)),
    "op8_document_fingerprints": lambda spark, d: docprint.compare_edits(documents(spark, d)),
    "op9_language_id": lambda spark, d: langid.language_report(documents(spark, d)),
    "op10_benchmark_leakage": lambda spark, d: leakage.leakage_report(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op11_importance_resampling": lambda spark, d: resample.resample_report(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op12_toxicity": lambda spark, d: toxicity.toxicity_report(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op13_tokenizer_alignment": lambda spark, d: tokenalign.align(documents(spark, d)),
}

ORACLE_SQL = {
    "op2_source_mixture": mixture.MIXTURE_SQL.format(docs="documents"),
    "op3_line_dedup": linedup.LINES_SQL,
    "op10_benchmark_leakage": leakage.LEAKAGE_SQL,
    "op11_importance_resampling": resample.RESAMPLE_SQL,
}
