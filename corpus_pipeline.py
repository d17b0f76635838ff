"""Corpus cleaning pipeline: each stage works on all documents that the stage before it kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import byte_bpe, decontaminate, near_dedup, substring, toxicity
from trendloom.llm.graph import stored


MARK = "__in_"  # input columns other than id and text go through a stage under this prefix, so no column of an operator meets them


def aside(docs: DataFrame) -> DataFrame:
    return docs.select(*[c if c in ("doc_id", "text") else F.col(c).alias(MARK + c) for c in docs.columns])


def with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from rows that went aside, with n_chars brought up to date."""
    columns = {c: F.col(c if c in ("doc_id", "text") else MARK + c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return changed.select(*[v.alias(c) for c, v in columns.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    return toxicity.with_score(docs, model, score_col="__score").where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every near-duplicate class; rows without id stay."""
    classes = near_dedup.near_duplicate_classes(docs)
    return docs.join(classes.where("id <> class_id").select(F.col("id").alias("__copy_id")), F.col("doc_id") == F.col("__copy_id"), "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; texts that change are joined by single spaces, texts left without words go."""
    cut = substring.remove_repeated_words(aside(docs).withColumnRenamed("text", "__text"), text_col="__text")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("__text"))
    return with_text(cut.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text), docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; texts that are mostly such passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_text(decontaminate.remove_spans(decontaminate.contamination(aside(docs), benchmark)), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number and digest of the token ids, digest of the decoded bytes."""
    return byte_bpe.digest_rows(docs, extra=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeated_passages), ("decontamination", cut_benchmark_passages), ("byte_bpe", tokenise),
]

#: SQL cannot express the trained, sketched and indexed stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
