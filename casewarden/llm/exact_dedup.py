"""Exact dedup by content sort.

Rows are range-partitioned on the leading normalised bytes (Spark samples the splitters; the
SHA-256 and a split number of the row extend that key, so that the sample stays small, a common
prefix does not fill one range and a large group of copies spreads over ranges). Each range is
sorted externally by its key and the whole normalised text, and a window walks over neighbours
that are equal in full. What one group left in several splits is then merged by
(leading bytes, SHA-256, byte length): one row per group and split.

Defined results: null text is empty and equals other empty texts; null doc_id sorts after all
others; of repeated rows exactly one is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Over so many splits a group of equal texts spreads.
SPLITS = 16


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def content_sort_groups(docs: DataFrame, splits: int = SPLITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, one row per row."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.length(text).alias("n_cp"), normalised(F.col("text")).alias("norm"))
    d = d.select(
        "doc_id", "n_cp", "norm",
        F.substring("norm", 1, 16).alias("lead"),
        F.sha2("norm", 256).alias("sha"),
        F.octet_length("norm").alias("n_bytes"),
        F.pmod(F.xxhash64("doc_id"), F.lit(splits)).alias("split"),
    )
    d = d.repartitionByRange("lead", "sha", "split")
    equal = Window.partitionBy("lead", "sha", "split", "norm")
    best = equal.orderBy(F.col("n_cp").desc(), F.col("doc_id").asc_nulls_last())
    d = d.withColumn("place", F.row_number().over(best)).withColumn("n", F.count(F.lit(1)).over(equal))
    rows = d.select("doc_id", "n_cp", "lead", "sha", "n_bytes", "split", "place", "n")
    top = F.struct("n_cp", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("back"))
    per_split = rows.where("place = 1").select("lead", "sha", "n_bytes", "split", "n", top.alias("top"))
    groups = per_split.groupBy("lead", "sha", "n_bytes").agg(
        F.sum("n").alias("group_size"), F.max(F.struct("top", "split")).alias("top")
    )
    out = rows.join(groups, ["lead", "sha", "n_bytes"])
    return out.select(
        "doc_id",
        F.bitwise_not("top.top.back").alias("keep_id"),
        "group_size",
        ((F.col("place") == 1) & (F.col("split") == F.col("top.split"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
