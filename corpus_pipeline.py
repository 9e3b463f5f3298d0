"""The corpus pipeline: toxicity, line dedup, near copies, benchmark decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalgrid.llm.jaccard_join import families
from signalgrid.llm.line_chunks import remove
from signalgrid.llm.prefix_bpe import encode
from signalgrid.llm.spaced_seeds import contaminated
from signalgrid.llm.tables import materialise, read
from signalgrid.llm.toxicity_chain import chain_scores

SHINGLE_WORDS, SIMILARITY = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject."""
    return chain_scores(docs, read(spark, sf_dir, "labels")).where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated chunks of lines; those of which nothing is left go. n_chars follows the text."""
    cleaned = remove(docs).where(~F.col("emptied"))
    chars = {"n_chars": F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(chars).select(*docs.columns) if chars else cleaned.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, and of rows with that id the
    one whose text has the smallest digest. A row is known by its id and its text's digest, so rows that share
    an id with a copy stay. Repeated rows become one; rows without an id stay."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    keyed = docs.withColumn("_digest", digest)
    groups = materialise(families(keyed, SHINGLE_WORDS, SIMILARITY, ("_digest",)), "near-groups").where("doc_id is not null and root is not null")
    first = Window.partitionBy("root").orderBy("_digest")  # rows of one id: few, whatever the size of the group
    later = groups.where("doc_id = component_id").select("root", "doc_id", "_digest").distinct().withColumn("_n", F.row_number().over(first)).where("_n > 1")
    copies = groups.where("doc_id <> component_id").select("doc_id", "_digest").unionByName(later.select("doc_id", "_digest")).distinct()
    return keyed.join(copies, ["doc_id", "_digest"], "left_anti").dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contaminated(docs, read(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents left."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontamination", decontamination), ("encoding", encoding)]

#: A fitted classifier and the tokenizer's merges have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
