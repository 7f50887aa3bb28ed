"""Corpus pipeline: filter, dedup, decontaminate, mix and encode ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Defined results: an empty table goes through all stages as one. Rows with null or repeated ids are
judged by id and text, and stay if nothing speaks against their text: the classifier keeps them as
it keeps others; of rows equal in id and text one passes near-dedup, rows without words all do; a null
text is clean for decontamination, has no words to mix and so is left out by the mix; every row that is
left has ids in the shards, the end id at least. Very long texts are read whole by all stages. Extra
columns are carried along, also under names that the stages use for their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewarden.llm import decontaminate, minhash, mixing, quality, token_shards
from casewarden.storage import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near-duplicates stays."""
    return minhash.keep_one_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are left out or repeated as the mix takes them."""
    return mixing.repeat_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ids in wavelet matrix shards, one row per document read back from them."""
    return token_shards.token_table(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
    ("token_shards", token_stage),
]

#: The classifier and the signatures cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
