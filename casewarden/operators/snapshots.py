"""Stored results and ledger rows: risk and brief snapshots, message and execution rows, case JSON.

Identifiers are functions of the case, and the time is a parameter, so that a repeated run
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewarden.operators.ledgers import merge_upsert

AT = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"
SCORE = ["risk_score", "risk_band", "evidence_strength", "recommended_route"]
BRIEF = ["executive_summary", "recommended_action"]


def _id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), "case_id")


def risk_rows(risk: DataFrame, at: str = AT) -> DataFrame:
    return risk.select(_id("RSK-").alias("score_id"), "case_id", *SCORE, F.expr(at).alias("calculated_at"))


def risk_score_snapshot(risk: DataFrame, scores: DataFrame, at: str = AT) -> DataFrame:
    """Stored scores with those of ``risk`` put in or replaced."""
    return merge_upsert(scores, risk_rows(risk, at), ["score_id"])


def _audit(rows: DataFrame, prefix: str, kind: str, detail: Column, at: str) -> DataFrame:
    return rows.select(_id(prefix).alias("audit_event_id"), "case_id", F.expr(at).alias("event_ts"), F.lit(kind).alias("event_type"), detail.alias("event_detail"))


def risk_audit_rows(risk: DataFrame, at: str = AT) -> DataFrame:
    detail = F.concat(
        F.lit("Calculated "), F.col("risk_score").cast("string"), F.lit("/100 "), "risk_band", F.lit(" risk with "), "evidence_strength", F.lit(" evidence.")
    )
    return _audit(risk, "AUD-RSK-", "RISK_CALCULATED", detail, at)


def audit_snapshot(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Stored events keep their time and take the new detail."""
    return merge_upsert(audit, rows, ["audit_event_id"], ["event_detail"])


def brief_rows(brief: DataFrame, at: str = AT) -> DataFrame:
    return brief.select(_id("BRF-").alias("brief_id"), "case_id", *BRIEF, F.expr(at).alias("generated_at"))


def brief_snapshot(brief: DataFrame, briefs: DataFrame, at: str = AT) -> DataFrame:
    """Stored briefs take new texts and keep the time of their first."""
    return merge_upsert(briefs, brief_rows(brief, at), ["brief_id"], BRIEF)


def brief_audit_rows(brief: DataFrame, at: str = AT) -> DataFrame:
    return _audit(brief, "AUD-BRF-", "BRIEF_GENERATED", F.concat(F.lit("Brief generated: "), "recommended_action"), at)


def source_list(names: str) -> Column:
    """Comma-separated names as an array; none for null and empty text."""
    return F.when(F.coalesce(names, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(names, ","))


def message_rows(valid: DataFrame, provider: str = "RULES", grounding: str = "EVIDENCE_TABLES") -> DataFrame:
    """Message ledger rows: who said what in which session, on which sources, made and grounded how."""
    return valid.select(
        "message_id", "case_id", "session_id", "message_ts", F.upper("message_role").alias("message_role"), "actor_name", "message_text",
        source_list("sources").alias("source_objects"), F.lit(provider).alias("model_provider"), F.lit(grounding).alias("grounding_mode"),
    )


def execution_rows(valid: DataFrame) -> DataFrame:
    """Execution ledger rows: request and session, why the agent was asked, what it said, on which sources."""
    return valid.select(
        "execution_id", "request_id", "case_id", "session_id", F.lower("agent_name").alias("agent_name"), "executed_at",
        F.lit("COMPLETED").alias("execution_status"), "routing_reason", "agent_response", source_list("sources").alias("source_objects"),
    )


def execution_audit(executions: DataFrame) -> DataFrame:
    """Audit rows of execution rows; the metadata name request, session, reason, sources and status."""
    about = F.struct("request_id", "session_id", "agent_name", "routing_reason", "source_objects", "execution_status")
    return executions.select(
        F.concat(F.lit("AUD-"), "execution_id").alias("audit_event_id"), "case_id", F.col("executed_at").alias("event_ts"), F.lit("AGENT").alias("actor_type"),
        F.col("agent_name").alias("actor_name"), F.lit("AGENT_EXECUTION").alias("event_type"), F.concat("agent_name", F.lit(" answered; see the execution.")).alias("event_detail"),
        F.lit("AGENT_EXECUTION").alias("object_type"), F.col("execution_id").alias("object_id"), F.to_json(about, {"ignoreNullFields": "false"}).alias("event_metadata"),
    )


def evidence_json(alerts: DataFrame, entities: DataFrame, docs: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Document and watchlist identifiers of every case; empty arrays where there are none."""
    d = docs.groupBy("case_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    w = entities.join(watchlist.select(F.col("matched_account_id").alias("account_id"), "watchlist_id"), "account_id")
    w = w.groupBy("case_id").agg(F.array_sort(F.collect_set("watchlist_id")).alias("watchlist"))
    rows = alerts.select("case_id").join(d, "case_id", "left").join(w, "case_id", "left")
    empty = F.array().cast("array<string>")
    both = F.struct(*[F.coalesce(c, empty).alias(c) for c in ("documents", "watchlist")])
    return rows.select("case_id", F.to_json(both).alias("payload"))
