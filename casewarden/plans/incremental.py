"""Queries of file streams, of the incremental pipeline and of tables that are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewarden.operators import ledgers as L
from casewarden.sources.adapters import adapters
from casewarden.sources.keyed_table import KeyedTable
from casewarden.storage import fresh_folder, written
from casewarden.streaming import changes as C
from casewarden.streaming.pipeline import TransactionPipeline

Tables = dict[str, DataFrame]
#: Rows of a file that is delivered to a stream; larger tables are more files, not larger ones.
FILE_ROWS = 500_000


def even_alerts(t: Tables) -> DataFrame:
    """Alerts on even employers only, so that the pipeline opens cases."""
    return t["alerts"].where("int(substr(account_id, 7)) % 2 = 0")


def _number(column: str) -> str:
    return f"int(substr({column}, 4))"


def _delivered(spark: SparkSession, rows: DataFrame, batches: int = 1, end: str | None = None, times: int = 1) -> tuple[str, int]:
    """``rows`` as files of about ``FILE_ROWS`` by time, and how many of them make one of so many batches.

    They are delivered so many ``times``; ``end`` appends a wage and a transfer of nobody that long after the last.
    """
    path = fresh_folder(spark, "delivered")
    files = max(1, -(-rows.count() // (batches * FILE_ROWS)))
    for _ in range(times):
        rows.repartitionByRange(batches * files, "ts").write.mode("append").parquet(path)
    if end:
        last = rows.agg((F.max("ts") + F.expr(end)).alias("ts")).withColumn("transaction_type", F.explode(F.array(F.lit("PAYROLL"), F.lit("TRANSFER"))))
        last = last.withColumn("from_account_id", F.lit("NOBODY"))
        last.select(*[F.col(c) if c in last.columns else F.lit(None).cast(k).alias(c) for c, k in rows.dtypes]).coalesce(1).write.mode("append").parquet(path)
    return path, files


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = C.file_stream(spark, f"{sf_dir}/events.parquet")
    return C.capture(events.select("event_id", "user_id", F.upper("event_type").alias("kind")), fresh_folder(spark, "changes"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events delivered twice, every fifth known to the ledger before."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    path, files = _delivered(spark, events, times=2)
    twice = C.file_stream(spark, path, events.schema, files).withColumn("at", F.col("ts").cast("timestamp"))
    once = C.dedupe_stream(twice, ["event_id"], "at", "60 days", events.where("event_id % 5 = 0"))
    return C.capture(once.select("event_id", "user_id", "event_type"), fresh_folder(spark, "dedupe"))


def _onward(how: str, end: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = adapters(spark, sf_dir)
        stream = C.file_stream(spark, _delivered(spark, t["transactions"], end=end)[0], t["transactions"].schema)
        return C.capture(C.onward_stream(t["alerts"], stream, how=how), fresh_folder(spark, "onward"))

    return run


def interval_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wage with its transfers, or none; rows three days after the last one close all spans."""
    return _onward("left", "INTERVAL 3 DAYS")(spark, sf_dir).select("payroll_id", "transfer_id")


def processed(spark: SparkSession, sf_dir: str, batches: int) -> TransactionPipeline:
    """The pipeline after a run over all transactions, in so many batches of files.

    Before: even employers have cases, every fifth transaction of theirs is in the ledger, and the audit
    holds every seventh.
    """
    t, home = adapters(spark, sf_dir), fresh_folder(spark, "pipeline")
    accounts, cases = written(t["accounts"].select("account_id"), "accounts"), even_alerts(t)
    path, files = _delivered(spark, t["transactions"], batches)
    tx = spark.read.schema(t["transactions"].schema).parquet(path)
    none = spark.createDataFrame([], "transaction_id string")
    ledger = L.processing_events(tx.where(f"{_number('transaction_id')} % 5 = 0"), accounts, cases, none)
    audit = L.pipeline_audit(L.processing_events(tx.where(f"{_number('transaction_id')} % 7 = 0"), accounts, cases, none), spark.createDataFrame([], "audit_event_id string"))
    p = TransactionPipeline.create(home, accounts, cases, ledger, audit, buckets=4)
    p.run(C.file_stream(spark, path, tx.schema, files))
    return p


def _pipeline(show: Callable[[TransactionPipeline], DataFrame], batches: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: show(processed(spark, sf_dir, batches))


def _new_events(p: TransactionPipeline) -> DataFrame:
    return p.read("ledger").where("batch >= 0").drop("batch")


def _new_audit(p: TransactionPipeline) -> DataFrame:
    return p.read("audit").where(f"{_number('object_id')} % 7 <> 0 OR case_id LIKE 'CASE-AUTO-%'")


def _summary(p: TransactionPipeline) -> DataFrame:
    s = p.read("summary").agg(F.sum("processed").alias("processed"))
    return s.select("processed", F.concat(F.lit("Processed "), F.col("processed").cast("string"), F.lit(" new transaction(s).")).alias("summary"))


def _by_case(p: TransactionPipeline) -> DataFrame:
    """Cases with their ledger and audit rows, earlier ones included."""
    count = F.count(F.lit(1))
    rows = p.read("cases").join(p.read("ledger").groupBy("case_id").agg(count.alias("events")), "case_id", "left")
    rows = rows.join(p.read("audit").groupBy("case_id").agg(count.alias("audited")), "case_id", "left")
    return rows.select("case_id", F.col("case_id").like("CASE-AUTO-%").alias("opened"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("audited", F.lit(0)).alias("audited"))


def _table(build: Callable[[Tables], DataFrame], keys: list[str], change: Callable[[KeyedTable, Tables], None]) -> Callable[[SparkSession, str], DataFrame]:
    """A table that is written, changed twice alike, and read as a later run would."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = adapters(spark, sf_dir)
        table = KeyedTable.create(build(t), fresh_folder(spark, "table"), keys, buckets=8)
        for _ in range(2):
            change(table, t)
        return KeyedTable.open(spark, table.path).read()

    return run


def _high(t: Tables) -> DataFrame:
    return t["alerts"].where("priority = 'HIGH'").select("case_id", F.lit("X").alias("account_id"), F.lit("Y").alias("priority"))


def _cases(t: Tables) -> DataFrame:
    return even_alerts(t).select("case_id", "account_id", "priority")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src_change_stream": change_stream,
    "stream_dedupe": stream_dedupe,
    "stream_wage_harvest": _onward("inner", None),
    "join_interval_stream": interval_stream,
    "stream_new_transactions": _pipeline(_by_case, 2),
    "pipe_auto_case": _pipeline(lambda p: p.read("cases").where("case_id LIKE 'CASE-AUTO-%'")),
    "pipe_processing_events": _pipeline(_new_events),
    "pipe_audit_events": _pipeline(_new_audit),
    "pipe_batch_summary": _pipeline(_summary),
    "merge_upsert_all": _table(_cases, ["case_id"], lambda table, t: table.merge(_high(t))),
    "merge_upsert_partial": _table(_cases, ["case_id"], lambda table, t: table.merge(_high(t), ["priority"])),
    "merge_insert_only": _table(
        lambda t: _cases(t).drop("priority"), ["case_id"],
        lambda table, t: table.insert_absent(t["alerts"].select("case_id", F.concat(F.lit("NEW-"), "account_id").alias("account_id"))),
    ),
    "sink_delete_where": _table(lambda t: t["accounts"].select("account_id", "sector"), ["account_id"], lambda table, t: table.delete_where(F.col("sector") == "RETAIL")),
    "sink_update_where": _table(
        lambda t: t["alerts"].select("case_id", "alert_status", "priority"), ["case_id"],
        lambda table, t: table.update_where(F.col("priority") == "HIGH", {"alert_status": F.lit("REVIEWED")}),
    ),
}
