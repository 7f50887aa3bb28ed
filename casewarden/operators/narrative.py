"""Texts and JSON per case. They grow with their case, because one text per case is the product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(order: list[str], text: Column, separator: str = "\n") -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("line"))))
    return F.array_join(F.transform(rows, lambda x: x["line"]), separator)


def signal_text(signals: DataFrame, with_points: bool = True) -> DataFrame:
    """Detected signals, most points first, then by name."""
    shown = F.col("signal_type")
    shown = F.concat(shown, F.lit(" ("), F.col("points").cast("string"), F.lit(" points)")) if with_points else shown
    s = signals.where("detected").withColumn("less", -F.col("points"))
    return s.groupBy("case_id").agg(_lines(["less", "signal_type"], shown).alias("signal_text"))


def evidence_text(docs: DataFrame) -> DataFrame:
    shown = F.concat("document_id", F.lit(": "), F.array_join("risk_indicators", ", "), F.lit(" ["), F.col("confidence").cast("string"), F.lit("]"))
    return docs.groupBy("case_id").agg(_lines(["document_id"], shown).alias("evidence_text"))


def audit_timeline(audit: DataFrame, label: str = "event_type") -> DataFrame:
    shown = F.concat(F.date_format("event_ts", "yyyy-MM-dd HH:mm"), F.lit(" "), F.col(label))
    return audit.groupBy("case_id").agg(_lines(["event_ts", "audit_event_id"], shown).alias("timeline"))


def missing_evidence(document_points: DataFrame, low: int = 75) -> DataFrame:
    """No documents; a document of low confidence; otherwise what is always open."""
    text = F.when(F.col("documents") == 0, "No documents are on file.").when(F.col("min_confidence") < low, "A document was read with low confidence; verify identity.")
    return document_points.select("case_id", text.otherwise("Ownership records and interviews are open.").alias("missing_evidence"))


def case_brief(alerts: DataFrame, accounts: DataFrame, risk: DataFrame, signal: DataFrame, missing: DataFrame, timeline: DataFrame) -> DataFrame:
    b = alerts.select("case_id", "account_id").join(accounts.select("account_id", "display_name"), "account_id").join(risk, "case_id")
    for part in (signal, missing, timeline):
        b = b.join(part, "case_id", "left")
    summary = F.concat("display_name", F.lit(" scores "), F.col("risk_score").cast("string"), F.lit("/100 ("), F.lower("risk_band"), F.lit(")."))
    guess = F.when(F.col("risk_score") >= 90, "Organised exploitation is likely.").otherwise("Evidence does not yet support one explanation.")
    action = (
        F.when(F.col("recommended_route") == "ESCALATE_TO_SAR", "Prepare a report for review.")
        .when(F.col("recommended_route") == "REQUEST_MORE_EVIDENCE", "Ask for more evidence.")
        .when(F.col("recommended_route") == "MONITOR_CASE", "Keep the case under watch.")
        .otherwise("Close after a second look.")
    )
    return b.select(
        "case_id", summary.alias("executive_summary"), guess.alias("hypothesis"), F.coalesce("signal_text", F.lit("No signal detected.")).alias("evidence_summary"),
        "missing_evidence", action.alias("recommended_action"), F.coalesce("timeline", F.lit("No events.")).alias("timeline"),
    )


def case_prompt(brief: DataFrame, evidence: DataFrame) -> DataFrame:
    p = brief.join(evidence, "case_id", "left")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Case "), "case_id"), "executive_summary", F.lit("Signals:"), "evidence_summary", F.lit("Documents:"),
        F.coalesce("evidence_text", F.lit("none")), F.lit("Open:"), "missing_evidence",
    )
    return p.select("case_id", text.alias("prompt_text"))


def json_of(df: DataFrame, columns: list[str], name: str = "payload") -> DataFrame:
    """One JSON object per case, null members kept."""
    return df.select("case_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def json_array(df: DataFrame, order: list[str], columns: list[str], name: str = "payload") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("o"))))
    return df.groupBy("case_id").agg(F.to_json(F.transform(rows, lambda x: x["o"]), {"ignoreNullFields": "false"}).alias(name))
