"""Training-text pipeline over documents: classify, deduplicate, decontaminate, mix, tokenize.

Each stage gets the rows that the one before kept and, but for the last, returns the columns of documents.
The order of the stages is given; a later round of any stage can start from the Parquet of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import scratch_path, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quantloom.llm.quality_classifier import classify

    return classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quantloom.llm.simhash_dedup import near_dedup

    # two independent fingerprints, so that a radius which catches copies with several changed words meets no others
    return near_dedup(docs, radius=14, second_seed=43, tile_rows=16384).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quantloom.llm.decontamination import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from quantloom.llm.source_mixing import replicate

    return replicate(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quantloom.llm.source_mixing import mixed_order
    from quantloom.llm.token_file import token_digest

    # the mixed order is made again from the rows: Parquet gives them back as its files and the cores have it
    tokens = token_digest(mixed_order(docs), public_tokenizers.path("word_bpe_49k.json"), order="shuffle_key")
    return tokens.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
