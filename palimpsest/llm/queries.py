"""The queries of the text problems on the tables of a data directory, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import packing, subjects, tokens, truncation
from palimpsest.session import table

_TEXTS = ["old_text", "new_text"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the archive's changes that lost their end."""
    cut = truncation.cut_values(table(spark, sf_dir, "act_archive"), "change_id", "source", _TEXTS)
    return cut.select(F.col("id").cast("bigint").alias("change_id"), "field")


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source of the archive delivers cut texts."""
    return truncation.cut_rates(table(spark, sf_dir, "act_archive"), "change_id", "source", _TEXTS)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text again from its ids, by its digest and length (the exact round trip)."""
    encoded = tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.decode(encoded, tokens.pieces(spark)).select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("n_chars"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in containers of 2,048 tokens of byte_bpe_50k."""
    sizes = tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(sizes.select(F.col("doc_id").alias("item"), "size")).select(F.col("item").alias("doc_id"), "part", "start", "size", "container")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of every text."""
    return subjects.subject_areas(table(spark, sf_dir, "documents"))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts deal with each area; areas without a text count 0."""
    areas = table(spark, sf_dir, "subject_areas").select("area", "title_en")
    counts = p10_found(spark, sf_dir).groupBy("area").agg(F.count("*").alias("n"))
    return areas.join(counts, "area", "left").select("area", "title_en", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_texts"))


QUERIES = {f.__name__: f for f in (p4_found, p4_sources, p8_ids, p8_decoded, p9_containers, p10_found, p10_composition)}

#: DuckDB statements; the others are not expressible in SQL and are tested against brute force in tests/llm.
SQL = {
    # The round trip must give back every text.
    "p8_decoded": "SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
}
