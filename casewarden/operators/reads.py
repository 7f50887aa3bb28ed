"""Investigator reads, run for all cases at once; one case is a filter on case_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewarden.operators.network import EXTERNAL, nodes


def triage_queue(alerts: DataFrame, accounts: DataFrame, risk: DataFrame) -> DataFrame:
    q = alerts.select("case_id", "account_id", "priority").join(accounts.select("account_id", "display_name"), "account_id")
    q = q.join(risk.select("case_id", "risk_score", "risk_band", "evidence_strength", "recommended_route"), "case_id", "left")
    return q.orderBy(F.col("risk_score").desc_nulls_last(), "case_id")


def case_signals(signals: DataFrame) -> DataFrame:
    """A case's signals, most points first, then by name."""
    s = signals.select("case_id", "signal_type", "detected", "points")
    return s.repartition("case_id").sortWithinPartitions("case_id", F.col("points").desc(), "signal_type")


def case_documents(docs: DataFrame) -> DataFrame:
    d = docs.select("case_id", "document_id", "document_type", "confidence", F.array_join("risk_indicators", ", ").alias("indicators"), "uploaded_seq")
    return d.repartition("case_id").sortWithinPartitions("case_id", "uploaded_seq")


def case_intelligence(alerts: DataFrame, edges: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Watchlist rows on the case's account or any account of its network. Levels sort as text."""
    who = alerts.select("case_id", "account_id").unionByName(nodes(edges).where(F.col("account_id") != EXTERNAL)).distinct()
    w = watchlist.withColumnRenamed("matched_account_id", "account_id")
    rows = who.join(w, "account_id").select("case_id", "watchlist_id", "account_id", "risk_level", "match_strength")
    return rows.repartition("case_id").sortWithinPartitions("case_id", F.col("risk_level").desc(), F.col("match_strength").desc(), "watchlist_id")


def case_transactions(alerts: DataFrame, edges: DataFrame, tx: DataFrame) -> DataFrame:
    """From or to the case's account, or from a source account of its network; each once."""
    own = alerts.select("case_id", "account_id")
    sent = own.unionByName(edges.select("case_id", F.col("source").alias("account_id"))).distinct()
    t = tx.select("transaction_id", "transaction_type", "cents", "from_account_id", "to_account_id")
    out = t.join(sent, F.col("from_account_id") == F.col("account_id"))
    back = t.where("to_account_id IS NOT NULL").join(own, F.col("to_account_id") == F.col("account_id"))
    return out.unionByName(back).drop("account_id").dropDuplicates(["case_id", "transaction_id"])


def newest(df: DataFrame, order: list[str]) -> DataFrame:
    """Histories per case, newest first."""
    return df.repartition("case_id").sortWithinPartitions("case_id", *[F.col(c).desc() for c in order])


def latest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n newest rows of each case."""
    w = Window.partitionBy("case_id").orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def largest_transaction(case_tx: DataFrame) -> DataFrame:
    return case_tx.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total_cents"),
        F.max_by("transaction_id", F.struct("cents", "transaction_id")).alias("largest_id"), F.max("cents").alias("largest_cents"),
    )
