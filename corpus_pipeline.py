"""The corpus pipeline: what a training corpus goes through, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and reread. All but the last return the columns
of ``documents``; texts that a stage changes get their ``n_chars`` anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratebook.llm import decontamination, language_id, line_dedup, packing, simhash
from ratebook.llm.common import stored, table
from ratebook.llm.queries import WORD_END, WORD_VOCABULARY


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of before, n_chars counted anew where the operator may have changed the text."""
    if "n_chars" in before.columns:
        kind = before.schema["n_chars"].dataType
        after = after.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return after.select(*before.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or far from every language go."""
    model = language_id.fit(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    return language_id.predict(docs, model, "_stage_").where("NOT _stage_rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites repeat; every document stays."""
    return _counted(docs, line_dedup.remove_boilerplate(docs, counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; null ids come last.

    Rows are told apart by their place in the stored table, so rows that share a doc_id, or have none, stay unless
    their texts are near copies.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    found = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    members = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = members.groupBy("_group").agg(first.alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; every document stays."""
    return _counted(docs, decontamination.remove_hits(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, WORD_VOCABULARY, WORD_END)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontamination", contamination),
    ("packing", packed),
]

#: XXH64 fingerprints, n-gram centroids and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
