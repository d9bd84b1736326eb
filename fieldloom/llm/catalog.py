"""The subpackage's queries by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import chat, codebooks, collocations, decontam, langid, licences, lines, lmscore, neardup, packing, pii, sketches, suffixes
from fieldloom.plans.tables import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -1, whose texts are made of control strings."""
    own = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    turns = chat.canonical_rows(table(spark, sf_dir, "conversations")).union(chat.canonical_rows(spark.sql(own)))
    return chat.digests(chat.format_turns(turns))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_lines": op2_lines,
    "op3_pii": op3_pii,
    "op4_chat": op4_chat,
    "op5_language": op5_language,
    "op6_fingerprints": op6_fingerprints,
    "op7_lm_scores": op7_lm_scores,
    "op8_decontamination": op8_decontamination,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_packing": op10_packing,
    "op11_licences": op11_licences,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": neardup.RESULT_SQL,
    "op2_lines": lines.REPORT_SQL,
    "op4_chat": chat.DIGESTS_SQL,
    "op9_repeated_bytes": suffixes.RESULT_SQL,
    "op12_vector_codes": codebooks.RESULT_SQL,
    "op13_collocations": collocations.RESULT_SQL,
}
