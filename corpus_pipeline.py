"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` applies them to the
``documents`` table.

1. quality        documents that the classifier rejects go
2. near_dedup     one document of each SimHash group stays
3. substring      duplicate spans are cut out of the texts; every document stays
4. decontaminate  documents that hold a benchmark item go
5. mix            documents are emitted by their source's repetition rate, numbered in ``copy_no``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpairs.llm.decontaminate import drop_contaminated
from textpairs.llm.mix_weights import mix_documents
from textpairs.llm.quality import keep_good
from textpairs.llm.simhash import keep_one
from textpairs.llm.substring import remove_repeats
from textpairs.session import cuts, drop_cuts, scratch_path, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one(docs, repeats=False)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    out = remove_repeats(docs)
    n_chars = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring", substring),
          ("decontaminate", decontaminate), ("mix", mix)]

#: The trained classifier and the hashed searches have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote on its way, and its input, go when it is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}", "llm")
        with cuts(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_cuts(spark, [before])
        before = path
    return docs
