"""Incremental processing of new transactions: cases, processing ledger, audit, summary.

Each batch of a file stream is one step, in this order: open cases for paying accounts that have
none; one ledger row per new transaction and case; one audit row per ledger row; one summary row. All
four go into keyed tables under one home folder by identifiers that depend on the rows alone, and
ledger and summary carry the batch's number. A step that is repeated, because it failed half-way or
because its commit was lost, finds its own rows and changes nothing. The checkpoint is in the home folder
too, so a later run goes on where the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewarden.operators import ledgers as L
from casewarden.sources.keyed_table import BUCKETS, KeyedTable
from casewarden.storage import written
from casewarden.streaming.changes import run_batches

TABLES = {"cases": ["case_id"], "ledger": ["processing_event_id"], "audit": ["audit_event_id"], "summary": ["batch"]}
#: Stands for ledger rows that were there before the first batch.
EARLIER = -1


class TransactionPipeline:
    def __init__(self, spark: SparkSession, home: str, accounts: DataFrame, tables: dict[str, KeyedTable]):
        self.spark, self.home, self.accounts, self.tables = spark, home, accounts, tables

    @classmethod
    def create(cls, home: str, accounts: DataFrame, alerts: DataFrame, ledger: DataFrame, audit: DataFrame, buckets: int = BUCKETS) -> TransactionPipeline:
        """Tables under ``home`` with the rows that are known so far: cases, processing events, audit rows."""
        spark = accounts.sparkSession
        first = {
            "cases": alerts.select("case_id", "account_id", "alert_status"),
            "ledger": ledger.withColumn("batch", F.lit(EARLIER).cast("long")),
            "audit": audit,
            "summary": spark.createDataFrame([], "batch long, processed long, summary string"),
        }
        tables = {name: KeyedTable.create(df, f"{home}/{name}", TABLES[name], buckets) for name, df in first.items()}
        return cls(spark, home, accounts, tables)

    @classmethod
    def open(cls, home: str, accounts: DataFrame) -> TransactionPipeline:
        """The pipeline that an earlier run left under ``home``."""
        spark = accounts.sparkSession
        return cls(spark, home, accounts, {name: KeyedTable.open(spark, f"{home}/{name}") for name in TABLES})

    def step(self, batch: DataFrame, number: int) -> None:
        """Process one batch; a repeat under the same number changes nothing."""
        batch = written(batch.select("transaction_id", "ts", "from_account_id", "to_account_id").dropDuplicates(["transaction_id"]), "batch")
        if batch.isEmpty():
            return
        cases, ledger = self.tables["cases"], self.tables["ledger"]
        cases.insert_absent(L.auto_cases(batch, self.accounts, cases.read()))
        done = ledger.read().where(F.col("batch") != number)
        events = L.processing_events(batch, self.accounts, cases.read(), done).withColumn("batch", F.lit(number).cast("long"))
        ledger.insert_absent(events)
        mine = ledger.read().where(F.col("batch") == number)
        self.tables["audit"].insert_absent(L.pipeline_audit(mine, self.tables["audit"].read()))
        self.tables["summary"].merge(L.batch_summary(mine).select(F.lit(number).cast("long").alias("batch"), "processed", "summary"))

    def run(self, transactions: DataFrame) -> list[dict]:
        """Process all batches of the stream that earlier runs have not."""
        return run_batches(transactions, f"{self.home}/checkpoint", self.step)

    def read(self, table: str) -> DataFrame:
        return self.tables[table].read()
