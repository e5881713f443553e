"""A corpus from raw documents: five of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept, read back from Parquet. All but the last return the columns of documents;
the last returns where each piece of a document lies in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phasewise.llm import fertility, packing, quality, scratch, similar, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on words and tokens keep."""
    return fertility.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rated 0.5 or better; the model learns from labelled ones among them."""
    scratch.clear(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts that share 0.8 of their five-word shingles or more."""
    scratch.clear(spark)
    return similar.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that one with a smaller doc_id has."""
    scratch.clear(spark)
    return substring.remove_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin, offset and capacity of each piece of each document."""
    scratch.clear(spark)
    return packing.pack_documents(docs)


#: A stage deletes the scratch tables of those before it, whose results are written by then.
STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Tokenisers and a trained model are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{scratch.root(spark)}/stage-{scratch.token()}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
