"""File streams that are drained once per run, and captured so that a run can be resumed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | None = None, max_files: int | None = None) -> DataFrame:
    """New Parquet files at ``path`` (a folder, one file or a pattern); ``max_files`` of them make a batch."""
    if schema is None:
        schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, the path may be one file or a folder


def run_batches(rows: DataFrame, state_dir: str, step: Callable[[DataFrame, int], None]) -> list[dict]:
    """Call ``step`` with every batch that the checkpoint does not hold yet, then end: the batches' progress.

    A batch whose run failed is given again under the same number, so ``step`` must bear repeats.
    """
    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", state_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def capture(rows: DataFrame, home: str, progress: list[dict] | None = None) -> DataFrame:
    """Drain the stream into ``home`` and return what this run added; its batches' progress joins ``progress``.

    ``home/state`` remembers which files were read: a second run adds nothing, and after new files
    only their rows. Each batch has a folder of its own that a repeat of the batch overwrites.
    """
    added: list[str] = []

    def store(batch: DataFrame, number: int) -> None:
        path = f"{home}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        added.append(path)

    seen = run_batches(rows, f"{home}/state", store)
    if progress is not None:
        progress += seen
    spark = rows.sparkSession
    return spark.read.schema(rows.schema).parquet(*added) if added else spark.createDataFrame([], rows.schema)


def captured(spark: SparkSession, home: str, schema: StructType) -> DataFrame:
    """All rows that runs on ``home`` have added."""
    return spark.read.schema(schema).parquet(f"{home}/rows")


def dedupe_stream(rows: DataFrame, key: list[str], at: str, delay: str, ledger: DataFrame | None = None) -> DataFrame:
    """The first row of each key; keys that the ledger holds are no news.

    Repeats are known for ``delay`` after a row's event time and then forgotten, so state is bounded by the
    rows of that span; a later repeat is behind the watermark and dropped as late, or known to the ledger.
    """
    once = rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)
    return once if ledger is None else once.join(ledger.select(*key).distinct(), key, "left_anti")


def interval_stream(left: DataFrame, right: DataFrame, key: str, start: str, at: str, hours: int = 24, how: str = "inner") -> DataFrame:
    """Rows of two streams of one key, the right one's ``at`` at most ``hours`` after the left one's ``start``.

    Both columns carry a watermark; state lasts until the span has passed it. Keyed by (key, day): a left
    row is on its own day, a right one on every day its partners can have, so a pair meets once and a
    busy key is spread over its days. With how = 'left' a left row that found none comes out, with
    nulls, once the watermark has passed its span.
    """
    span = F.make_dt_interval(F.lit(0), F.lit(hours))
    left = left.withColumn("_day", F.to_date(start)).withColumnRenamed(key, "_key")
    right = right.withColumn("_on", F.explode(F.sequence(F.to_date(F.col(at) - span), F.to_date(at))))
    within = F.expr(f"`{at}` >= `{start}` AND `{at}` <= `{start}` + INTERVAL {int(hours)} HOURS")
    same = (F.col("_key") == F.col(key)) & (F.col("_day") == F.col("_on")) & within
    both = left.join(right, same, "left_outer" if how == "left" else how)
    return both.drop(key, "_day", "_on").withColumnRenamed("_key", key)


def onward_stream(alerts: DataFrame, tx: DataFrame, hours: int = 24, delay: str = "1 hour", how: str = "inner") -> DataFrame:
    """Wages of alerted employers and the recipients' transfers after them, both from the stream ``tx``.

    Any wage moves the watermark of wages, any transfer that of transfers, also between unknown accounts;
    state goes by the earlier of both. Event times are timestamps (session time zone), since watermarks take
    no timestamp without zone.
    """
    tx = tx.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    wages = tx.where("transaction_type = 'PAYROLL'").select(
        F.col("from_account_id").alias("account_id"), F.col("to_account_id").alias("worker_id"),
        F.col("transaction_id").alias("payroll_id"), F.col("at").alias("payroll_at"), F.col("cents").alias("payroll_cents"),
    )
    wages = wages.join(alerts.select("case_id", "account_id"), "account_id").drop("account_id")
    moves = tx.where("transaction_type = 'TRANSFER'").select(
        F.col("from_account_id").alias("worker_id"), F.col("to_account_id").alias("controller_id"),
        F.col("transaction_id").alias("transfer_id"), F.col("at").alias("transfer_at"), F.col("cents").alias("transfer_cents"),
    )
    pairs = interval_stream(wages, moves, "worker_id", "payroll_at", "transfer_at", hours, how)
    gap = F.expr("timestampdiff(HOUR, date_trunc('HOUR', payroll_at), date_trunc('HOUR', transfer_at))")
    return pairs.select("case_id", "worker_id", "controller_id", "payroll_id", "transfer_id", "payroll_cents", "transfer_cents", gap.alias("hours"))
