"""Training corpus pipeline: toxic documents go, one document of each near-duplicate group stays, benchmark passages
leave the texts, documents are repeated to target domain weights, and what is left is written as token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigspark.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from sigspark.llm.scratch import Scratch

#: No SQL expresses a trained field, MinHash or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None

#: Target shares of tokens. Rates are at least 1 here, so that mixing repeats documents and loses none: of a domain that has more
#: than its target share of 1.25 times all tokens nothing can be taken away, and a warning gives the shares reached.
TARGETS = {"good": 0.9, "plain": 0.1}


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go. The field is trained on labelled rows of docs."""
    field = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, field, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: the smallest doc_id of each component stays."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more of a test item leave the text; documents of more than half such words go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, one to three times each, until tokens of the domains of labels have the target shares."""
    labelled = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.repeat_by_rate(docs, labelled, TARGETS, budget=1.25, low=1.0, high=3.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files."""
    import public_tokenizers

    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))["documents"]


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark), ("mixing", mix), ("token output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents, each stage's result written and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(i))
    return docs
