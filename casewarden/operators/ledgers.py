"""Upserts, validation and append-only ledgers.

Functions return a new DataFrame; ``sources.keyed_table`` writes them. Identifiers are functions of the
business key, so applying the same input twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that the ledgers accept.
DECISIONS = ("ESCALATE_TO_SAR", "REQUEST_MORE_EVIDENCE", "MONITOR_CASE", "CLOSE_AS_FALSE_POSITIVE")
ROLES = ("USER", "ASSISTANT")
AGENTS = ("risk", "typology", "network", "evidence", "brief", "orchestrator")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Matched rows take the ``update`` columns (default all) from source; new rows are inserted."""
    rest = [c for c in target.columns if c not in keys]
    update = rest if update is None else update
    s = source.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_s_{c}") for c in rest])
    t = target.select(*keys, F.lit(True).alias("_old"), *rest)
    both = t.join(s, keys, "full_outer")
    taken = F.col("_new") & F.col("_old").isNull()

    def value(c: str) -> Column:
        from_source = (F.col("_new").isNotNull() if c in update else F.lit(False)) | F.coalesce(taken, F.lit(False))
        return F.when(from_source, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in target.columns])


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.select(*target.columns).join(target.select(*keys), keys, "left_anti"))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def checked(df: DataFrame, required: list[str] = (), key: list[str] = ()) -> DataFrame:
    """``df`` with ``reasons``: what is wrong with a row, none for valid rows.

    Required and key columns must not be null, and a key must occur once. Keys that occur more often are
    few columns wide and counted with partial sums; no task gets all the rows of one.
    """
    needed = [*key, *[c for c in required if c not in key]]
    reasons = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in needed]).cast("array<string>"))
    if not key:
        return df.withColumn("reasons", reasons)
    again = duplicate_keys(df, key).select(*[F.col(k).alias(f"_{k}") for k in key], "copies")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    copies = F.when(F.col("copies").isNotNull(), F.array(F.concat(F.lit(f"{', '.join(key)} occurs "), F.col("copies").cast("string"), F.lit(" times"))))
    return df.join(again, same, "left").withColumn("reasons", F.concat(reasons, F.coalesce(copies, F.array().cast("array<string>")))).select(*df.columns, "reasons")


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows of ``checked`` that nothing is wrong with."""
    return rows.where(F.size("reasons") == 0).drop("reasons")


def violations(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, reason): one row for each thing wrong with a row of ``checked``."""
    return rows.select(*columns, F.explode("reasons").alias("reason"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def checked_decisions(requests: DataFrame, allowed: tuple[str, ...] = DECISIONS) -> DataFrame:
    """Adds ``reason``, null for valid requests. A null code is invalid, and so is blank text."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(~F.coalesce(F.col("decision").isin(*allowed), F.lit(False)), "unknown decision")
    reason = reason.when(blank("reviewer_name"), "reviewer is missing").when(blank("rationale"), "rationale is missing")
    return requests.withColumn("reason", reason)


def decision_audit(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        F.concat(F.lit("AUD-"), "decision_id").alias("audit_event_id"), "case_id", F.col("decided_at").alias("event_ts"), F.lit("HUMAN").alias("actor_type"),
        F.col("reviewer_name").alias("actor_name"), F.lit("REVIEWER_DECISION").alias("event_type"),
        F.concat("decision", F.lit(": "), "rationale").alias("event_detail"), F.lit("DECISION").alias("object_type"), F.col("decision_id").alias("object_id"),
    )


def apply_alert_status(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """The latest decision of a case sets its status and assignee."""
    last = decisions.groupBy("case_id").agg(F.max_by(F.struct("decision", "reviewer_name"), F.struct("decided_at", "decision_seq")).alias("d"))
    status = F.when(F.col("d.decision") == "REQUEST_MORE_EVIDENCE", "EVIDENCE_REQUESTED").when(F.col("d").isNotNull(), "REVIEWED").otherwise(F.col("alert_status"))
    return alerts.join(last, "case_id", "left").select("case_id", "account_id", status.alias("alert_status"), F.col("d.reviewer_name").alias("assigned_to"))


def checked_messages(requests: DataFrame, alerts: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    known = alerts.select("case_id", F.lit(True).alias("_case")).distinct()
    reason = F.when(~F.coalesce(F.upper("message_role").isin(*roles), F.lit(False)), "unknown role").when(F.col("_case").isNull(), "unknown case")
    return requests.join(known, "case_id", "left").withColumn("reason", reason).drop("_case")


def message_audit(messages: DataFrame) -> DataFrame:
    user = F.upper("message_role") == "USER"
    return messages.select(
        F.concat(F.lit("AUD-"), "message_id").alias("audit_event_id"), "case_id", "message_ts", F.when(user, "HUMAN").otherwise("SYSTEM").alias("actor_type"),
        F.concat(F.lit("COPILOT_"), F.upper("message_role"), F.lit("_MESSAGE")).alias("event_type"), F.col("message_id").alias("object_id"),
    )


def checked_executions(requests: DataFrame, alerts: DataFrame, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    known = alerts.select("case_id", F.lit(True).alias("_case")).distinct()
    reason = F.when(~F.coalesce(F.lower("agent_name").isin(*agents), F.lit(False)), "unknown agent").when(F.col("_case").isNull(), "unknown case")
    return requests.join(known, "case_id", "left").withColumn("reason", reason).drop("_case")


def linked_decisions(decisions: DataFrame, audit: DataFrame, how: str = "inner") -> DataFrame:
    """Decisions with the audit row of a human that names them as its object and their reviewer as its actor."""
    a = audit.where("object_type = 'DECISION' AND actor_type = 'HUMAN'").select("audit_event_id", "object_id", "actor_name")
    return decisions.join(a, (F.col("object_id") == F.col("decision_id")) & (F.col("actor_name") == F.col("reviewer_name")), how)


def ledger_links(decisions: DataFrame, audit: DataFrame) -> DataFrame:
    """Decisions, their audit rows, and pairs that agree on object and actor: one row."""
    linked = linked_decisions(decisions, audit, "left")
    return linked.agg(
        F.count_distinct("decision_id").alias("decisions"), F.count("audit_event_id").alias("linked"), F.bool_or(F.col("decision") == "ESCALATE_TO_SAR").alias("any_escalated")
    )


def auto_cases(batch: DataFrame, accounts: DataFrame, alerts: DataFrame) -> DataFrame:
    """A case for each paying account (payee if there is no payer) that is known and has none."""
    who = batch.select(F.coalesce("from_account_id", "to_account_id").alias("account_id")).distinct()
    new = who.join(accounts.select("account_id"), "account_id").join(alerts.select("account_id"), "account_id", "left_anti")
    return new.select(F.concat(F.lit("CASE-AUTO-"), F.replace("account_id", F.lit("ACC-"), F.lit(""))).alias("case_id"), "account_id", F.lit("OPEN").alias("alert_status"))


def processing_events(batch: DataFrame, accounts: DataFrame, alerts: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per transaction and case, for transactions that the ledger does not hold."""
    tx = batch.select("transaction_id", "ts", F.coalesce("from_account_id", "to_account_id").alias("account_id"))
    new = tx.join(ledger.select("transaction_id"), "transaction_id", "left_anti").join(accounts.select("account_id"), "account_id")
    return new.join(alerts.select("case_id", "account_id"), "account_id").select(
        F.concat(F.lit("PRC-"), "transaction_id", F.lit("-"), "case_id").alias("processing_event_id"), "transaction_id", "case_id", "account_id",
        F.col("ts").alias("processed_at"), F.lit("PROCESSED").alias("processing_status"),
    )


def pipeline_audit(events: DataFrame, audit: DataFrame) -> DataFrame:
    rows = events.select(
        F.concat(F.lit("AUD-"), "processing_event_id").alias("audit_event_id"), "case_id", F.col("processed_at").alias("event_ts"),
        F.lit("TRANSACTION_PROCESSED").alias("event_type"), F.col("transaction_id").alias("object_id"),
    )
    return rows.join(audit.select("audit_event_id"), "audit_event_id", "left_anti")


def batch_summary(events: DataFrame) -> DataFrame:
    n = F.count_distinct("transaction_id")
    return events.agg(n.alias("processed"), F.concat(F.lit("Processed "), n.cast("string"), F.lit(" new transaction(s).")).alias("summary"))


def processing_status(events: DataFrame, risk: DataFrame) -> DataFrame:
    return events.join(risk.select("case_id", "risk_score", "risk_band", "recommended_route"), "case_id", "left").select(
        "processing_event_id", "transaction_id", "case_id", "processing_status", "risk_score", "risk_band", "recommended_route"
    )
