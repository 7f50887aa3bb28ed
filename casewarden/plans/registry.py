"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casewarden.functions.primitives import PRIMITIVES
from casewarden.operators import acceptance as A
from casewarden.operators import detectors as D
from casewarden.operators import evidence as E
from casewarden.operators import ledgers as L
from casewarden.operators import narrative as X
from casewarden.operators import network as N
from casewarden.operators import reads as R
from casewarden.operators import routing as Q
from casewarden.operators import scoring as S
from casewarden.operators import snapshots as Z
from casewarden.plans import incremental
from casewarden.plans.incremental import even_alerts
from casewarden.plans.oracle import ORACLE_SQL  # noqa: F401
from casewarden.sources.adapters import Tables, adapters
from casewarden.sources.files import append_table, export_csv, overwrite_table, parse_json_columns, read_csv_checked, read_csv_typed, read_export, write_csv
from casewarden.storage import fresh_folder, written

_BUILD: dict[str, Callable[[Tables], DataFrame]] = {}


def _valid(t: Tables) -> DataFrame:
    return L.checked_decisions(t["decisions"]).where("reason IS NULL")


def _ledger(tx: DataFrame) -> DataFrame:
    """A ledger that holds every fifth transaction already."""
    return tx.where("int(substr(transaction_id, 4)) % 5 = 0").select("transaction_id")


def _events(t: Tables, tx: DataFrame | None = None) -> DataFrame:
    tx = t["transactions"] if tx is None else tx
    return L.processing_events(tx, t["accounts"], t["alerts"], _ledger(tx))


#: Put before a user's text, so that every route and topic occurs.
ASKED = ("Review score, typology, network, evidence and brief.", "Why this score?", "The payroll evidence?", "Connected accounts?", "What is missing?", "Which country?", "What do you recommend?", "Hello.")


def _questions(t: Tables) -> DataFrame:
    first = F.element_at(F.array(*[F.lit(a) for a in ASKED]), (F.length(F.coalesce("message_text", F.lit(""))) % len(ASKED) + 1).cast("int"))
    return t["messages"].where("message_role = 'USER'").select("message_id", "case_id", F.concat(first, F.lit(" "), F.coalesce("message_text", F.lit(""))).alias("question"))


def _responses(t: Tables) -> DataFrame:
    """A payload for each assistant message: its text, then two tools; some texts tell of a failure or name a score, some payloads are cut off."""
    n = F.length(F.coalesce("message_text", F.lit("")))
    text = F.concat("message_text", F.when(n % 11 == 0, " The analysis failed.").otherwise(""), F.when(n % 4 == 0, " Score 92 of 100.").otherwise(""))
    names = F.array(*[F.lit(name) for name in Q.TOOLS])
    kind = "struct<type: string, text: string, tool_use: struct<name: string>>"

    def tool(i):
        return F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.element_at(names, (i % len(Q.TOOLS) + 1).cast("int")).alias("name")).alias("tool_use")).cast(kind)

    said = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<name: string>").alias("tool_use")).cast(kind)
    status = F.when(n % 5 == 0, "failed").otherwise("completed")
    payload = F.to_json(F.struct(status.alias("status"), F.array(said, tool(n), tool(n * 2), tool(n)).alias("content")))
    return t["messages"].where("message_role = 'ASSISTANT'").select("message_id", F.when(n % 7 == 0, F.lit("{cut")).otherwise(payload).alias("payload"))


#: Answers per case by specialist, in order.
_ANSWERS: dict[str, Callable[[Tables], DataFrame]] = {
    "risk": lambda t: Q.answer_risk(E.risk(t), [*[n.lower() for n in S.TYPES], "intelligence", "document"]),
    "typology": lambda t: Q.answer_typology(t["alerts"], E.signals(t), E.case_transactions(t), Q.case_countries(E.case_transactions(t), E.transactions(t))),
    "network": lambda t: Q.answer_network(t["alerts"], N.network_summary(E.edges(t)), E.signal_tables(t)["ACCOUNT_CONTROL"]),
    "evidence": lambda t: Q.answer_evidence(E.brief(t), E.document_points(t), E.intelligence_points(t)),
    "brief": lambda t: Q.answer_brief(E.brief(t)),
}


def _asked(t: Tables) -> Tables:
    """The tables with the cases that questions are about; nobody picks among the answers of others.

    Accounts, transactions and logins stay whole: what is known of a case may lie with any of them.
    """
    cases = written(_questions(t).select("case_id").distinct(), "asked")
    own = {n: t[n].join(cases, "case_id", "left_semi").select(*t[n].columns) for n in ("alerts", "documents", "audit")}
    return Tables({**t, **own, "alerts": written(own["alerts"], "alerts")})


def _synthesis(t: Tables) -> DataFrame:
    some = _asked(t)
    return Q.synthesis(_questions(t), {n: written(a(some), f"answer_{n}") for n, a in _ANSWERS.items()})


def _messages(t: Tables) -> DataFrame:
    return L.checked_messages(t["messages"], t["alerts"]).where("reason IS NULL")


def _executions(t: Tables) -> DataFrame:
    return L.checked_executions(t["executions"], even_alerts(t)).where("reason IS NULL")


def _joined(rows: DataFrame) -> DataFrame:
    """Ledger rows with their sources as one text."""
    return rows.withColumn("source_objects", F.array_join("source_objects", "|"))


def _links(t: Tables) -> DataFrame:
    """Decisions linked to an audit in which every tenth has no row and every sixth names another actor."""
    audit = L.decision_audit(_valid(t).where("decision_seq % 10 <> 0"))
    other = F.when(F.expr("int(substr(object_id, 5)) % 6 = 0"), "somebody else").otherwise(F.col("actor_name"))
    return L.linked_decisions(_valid(t), audit.withColumn("actor_name", other)).select("decision_id", "audit_event_id")


def _acceptance(t: Tables) -> DataFrame:
    """Scores against their components, and ledgers against an audit that lacks every tenth decision."""
    cases, runs = t["alerts"], Z.execution_rows(_executions(t))
    sides = [
        (A.expected_scores(E.typology_points(t), E.intelligence_points(t), E.document_points(t)), A.actual_scores(E.risk(t))),
        A.ledger_checks(cases, runs, Z.execution_audit(runs), "execution_audits"),
        A.ledger_checks(cases, _valid(t), L.decision_audit(_valid(t).where("decision_seq % 10 <> 0")), "decision_audits"),
    ]
    expected, actual = (reduce(DataFrame.unionByName, [s[i] for s in sides]) for i in (0, 1))
    return A.reconcile(expected, actual)


def _parsed(t: Tables) -> DataFrame:
    """Audit metadata as an object and two columns as an array, some of either cut off."""
    n = F.expr("int(substr(audit_event_id, 5))")
    about = F.when(n % 13 == 0, "{cut").otherwise(F.col("event_metadata"))
    names = F.when(n % 17 == 0, "[cut").otherwise(F.to_json(F.array("event_type", "actor_name")))
    rows = parse_json_columns(t["audit"].select("audit_event_id", about.alias("about"), names.alias("names")), {"about": "k int", "names": "array<string>"})
    return rows.select("audit_event_id", (F.col("about.k") * 2).alias("twice"), F.get("names", F.lit(0)).alias("name"), F.array_join("errors", ",").alias("errors"))


def _stored(t: Tables, rows: DataFrame, key: str, old: dict[str, str]) -> DataFrame:
    """An earlier table like ``rows``: cases of high priority, and as many that are gone now."""
    high = t["alerts"].where("priority = 'HIGH'").select("case_id")
    was = rows.join(high, "case_id").withColumns({c: F.expr(e) for c, e in old.items()}).select(*rows.columns)
    return was.unionByName(was.withColumns({c: F.concat(F.lit("OLD-"), c) for c in (key, "case_id")}))


def _snapshot(rows: Callable, merge: Callable, source: Callable, key: str, old: dict[str, str]) -> Callable[[Tables], DataFrame]:
    def build(t: Tables) -> DataFrame:
        df = source(t)  # written by the evidence stage; read twice: new rows, and stored ones derived from them
        return merge(df, _stored(t, rows(df), key, old))

    return build


_LONG_AGO = "TIMESTAMP_NTZ '2023-12-31 00:00:00'"
_OLD_EVENT = {"event_ts": _LONG_AGO, "event_detail": "'old'"}
_SIGNALS = {"sig_wage_harvesting": 0, "sig_account_control": 1, "sig_spending_anomaly": 2, "sig_geographic_risk": 3, "sig_sector_risk": 4}
for _name, _i in _SIGNALS.items():
    _BUILD[_name] = lambda t, i=_i: E.signal_tables(t)[S.TYPES[i]]

_BUILD |= {
    "src_parquet_adapters": lambda t: t["transactions"],
    "onward_transfers": lambda t: D.onward_transfers(t["alerts"], t["transactions"]),
    "join_interval": lambda t: D.onward_transfers(t["alerts"], t["transactions"], 12).select("payroll_id", "transfer_id"),
    "shared_access": lambda t: D.shared_access(t["signals"]),
    "worker_flows": lambda t: D.worker_flows(t["alerts"], t["transactions"]),
    "network_members": E.members,
    "corridors": lambda t: D.corridors(t["alerts"], t["accounts"], t["transactions"]),
    "foreign_cash": lambda t: D.foreign_cash(E.members(t), t["alerts"], t["accounts"], t["transactions"]),
    "edges_payroll": lambda t: N.payroll_edges(t["alerts"], t["transactions"]),
    "edges_onward": lambda t: N.onward_edges(E.members(t), E.controllers(t), t["transactions"]),
    "edges_shared_access": lambda t: N.shared_access_edges(E.members(t), t["signals"]),
    "case_network": E.edges,
    "node_roles": lambda t: N.node_roles(E.edges(t), t["alerts"]),
    "node_labels": lambda t: N.node_labels(E.edges(t), t["accounts"]),
    "network_summary": lambda t: N.network_summary(E.edges(t)),
    "all_signals": E.signals,
    "typology_points": E.typology_points,
    "case_entities": E.entities,
    "intelligence_points": E.intelligence_points,
    "document_points": E.document_points,
    "risk_summary": E.risk,
    "brief_signal_text": lambda t: X.signal_text(E.signals(t)),
    "brief_evidence_text": lambda t: X.evidence_text(t["documents"]),
    "brief_audit_timeline": lambda t: X.audit_timeline(t["audit"], "actor_name"),
    "missing_evidence": lambda t: X.missing_evidence(E.document_points(t)),
    "case_brief": E.brief,
    "case_prompt": lambda t: X.case_prompt(E.brief(t), X.evidence_text(t["documents"])),
    "case_json_risk": lambda t: X.json_of(E.risk(t), ["risk_score", "risk_band", "recommended_route"]),
    "case_json_typologies": lambda t: X.json_array(E.signals(t), ["signal_type"], ["signal_type", "detected", "points"]),
    "case_json_network": lambda t: X.json_array(E.edges(t), ["relationship_type", "source", "target"], ["relationship_type", "source", "target", "event_count", "total_cents"]),
    "decisions_validate": lambda t: L.checked_decisions(t["decisions"]).select("decision_id", "reason"),
    "decisions_apply": lambda t: _valid(t).select("decision_id", "case_id", "decision", "reviewer_name", "rationale", "decided_at"),
    "decisions_audit": lambda t: L.decision_audit(_valid(t)),
    "decisions_alert_status": lambda t: L.apply_alert_status(t["alerts"], _valid(t)),
    "messages_validate": lambda t: L.checked_messages(t["messages"], even_alerts(t)).select("message_id", "reason"),
    "messages_audit": lambda t: L.message_audit(L.checked_messages(t["messages"], t["alerts"]).where("reason IS NULL")),
    "executions_validate": lambda t: L.checked_executions(t["executions"], even_alerts(t)).select("execution_id", "reason"),
    "ledger_link_check": lambda t: L.ledger_links(_valid(t), L.decision_audit(_valid(t).where("decision_seq % 10 <> 0"))),
    "messages_apply": lambda t: _joined(Z.message_rows(_messages(t))),
    "executions_apply": lambda t: _joined(Z.execution_rows(_executions(t))),
    "executions_audit": lambda t: Z.execution_audit(Z.execution_rows(_executions(t))),
    "risk_score_snapshot": _snapshot(Z.risk_rows, Z.risk_score_snapshot, E.risk, "score_id", {"risk_band": "'OLD'", "calculated_at": _LONG_AGO}),
    "risk_audit_event": _snapshot(Z.risk_audit_rows, lambda r, a: Z.audit_snapshot(Z.risk_audit_rows(r), a), E.risk, "audit_event_id", _OLD_EVENT),
    "brief_snapshot": _snapshot(Z.brief_rows, Z.brief_snapshot, E.brief, "brief_id", {"executive_summary": "'old'", "generated_at": _LONG_AGO}),
    "brief_audit_event": _snapshot(Z.brief_audit_rows, lambda b, a: Z.audit_snapshot(Z.brief_audit_rows(b), a), E.brief, "audit_event_id", _OLD_EVENT),
    "case_json_brief": lambda t: X.json_of(E.brief(t), ["executive_summary", "hypothesis", "recommended_action"]),
    "case_json_evidence": lambda t: Z.evidence_json(t["alerts"], E.entities(t), t["documents"], t["watchlist"]),
    "pipe_status": lambda t: L.processing_status(_events(t, E.transactions(t)), E.risk(t)),
    "read_triage_queue": lambda t: R.triage_queue(t["alerts"], t["accounts"], E.risk(t)),
    "read_documents": lambda t: R.case_documents(t["documents"]),
    "read_intelligence": lambda t: R.case_intelligence(t["alerts"], E.edges(t), t["watchlist"]),
    "read_transactions": E.case_transactions,
    "read_decisions": lambda t: R.newest(_valid(t).select("case_id", "decision_id", "decision", "decided_at"), ["decided_at", "decision_id"]),
    "read_audit": lambda t: R.newest(t["audit"].select("case_id", "audit_event_id", "event_ts", "event_type", "event_detail"), ["event_ts", "audit_event_id"]),
    "topk_recent_processing": lambda t: R.latest(_events(t).select("case_id", "processing_event_id", "processed_at"), ["processed_at", "processing_event_id"], 10),
    "topk_chat_history": lambda t: R.latest(t["messages"].select("case_id", "message_id", "message_ts"), ["message_ts", "message_id"], 20),
    "topk_largest_transaction": lambda t: R.largest_transaction(E.case_transactions(t)),
    "validate_not_null": lambda t: L.violations(L.checked(t["transactions"], ["to_account_id", "counterparty_country"]), "transaction_id"),
    "validate_rows": lambda t: L.checked(t["signals"], ["login_result"], ["account_id", "device_id", "ip_address"]).select("signal_id", F.get("reasons", F.lit(0)).alias("reason")),
    "join_ledger_link": _links,
    "join_self_theta_pairs": lambda t: N.shared_access_pairs(E.members(t), t["signals"]),
    "ledger_acceptance": _acceptance,
    "read_signals": lambda t: R.case_signals(E.signals(t)),
    "src_parse_json_cols": _parsed,
    "validate_unique_key": lambda t: L.duplicate_keys(t["signals"], ["account_id", "device_id", "ip_address"]),
}


_BUILD |= {
    "route_questions": lambda t: Q.routed(_questions(t)).select("message_id", "case_id", F.array_join("routes", ", ").alias("routes")),
    **{f"route_{n}_topic": lambda t, n=n: Q.topics(_questions(t), n) for n in Q.TOPICS},
    **{f"answer_{n}": a for n, a in _ANSWERS.items()},
    "answer_synthesis": _synthesis,
    "tool_trace": lambda t: Q.tool_trace(_responses(t)),
    "tool_trace_quality": lambda t: Q.trace_quality(_responses(t), expected=2),
    "read_agent_runs": lambda t: R.newest(Z.execution_rows(_executions(t)).select("case_id", "execution_id", "agent_name", "executed_at"), ["executed_at", "execution_id"]),
}


def _run(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(adapters(spark, sf_dir))


#: Queries over evidence tables that the caller may share.
BUILD: dict[str, Callable[[Tables], DataFrame]] = {**_BUILD, **PRIMITIVES}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _run(f) for k, f in BUILD.items()}


def _sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, t = fresh_folder(spark, "overwrite"), adapters(spark, sf_dir)
    overwrite_table(t["alerts"].where("priority = 'HIGH'"), path)
    return overwrite_table(t["alerts"].where("priority = 'MEDIUM'"), path).select("case_id", "priority")


def _sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, t = fresh_folder(spark, "append"), adapters(spark, sf_dir)
    for kind in ("CORPORATE", "INDIVIDUAL"):
        rows = append_table(t["accounts"].where(F.col("account_type") == kind).select("account_id", "account_type", "country"), path)
    return rows


def _csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case's audit trail, then that of every third case again, re-read."""
    path = fresh_folder(spark, "export")
    said = F.concat(F.lit('it said "'), "event_detail", F.lit('",\r\nthen left'))
    rows = adapters(spark, sf_dir)["audit"].select("case_id", "audit_event_id", "event_ts", "actor_type", "actor_name", "event_type", said.alias("event_detail"))
    order = [F.col("event_ts").desc(), F.col("audit_event_id")]
    export_csv(rows, path, "case_id", order)
    export_csv(rows.where("int(substr(case_id, 6)) % 3 = 0").withColumn("event_detail", F.concat(F.lit("again: "), "event_detail")), path, "case_id", order)
    return read_export(spark, path, rows.schema)


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV with a number that is none in every tenth, and why they were not taken."""
    path, kyc = fresh_folder(spark, "csv"), adapters(spark, sf_dir)["kyc"]
    count = F.when(F.expr("int(substr(account_id, 7)) % 10 = 3"), "abc").otherwise(F.col("declared_employee_count").cast("string"))
    write_csv(kyc.select(F.col("account_id").alias("Account_ID"), count.alias("DECLARED_EMPLOYEE_COUNT")), path)
    schema = StructType.fromDDL("account_id string, owner_status string, declared_employee_count int")
    return L.violations(read_csv_checked(spark, path, schema), "account_id")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, kyc = fresh_folder(spark, "csv"), adapters(spark, sf_dir)["kyc"]
    write_csv(kyc.toDF(*[c.upper() for c in kyc.columns]), path)
    return read_csv_typed(spark, path, kyc.schema)


QUERIES |= {"sink_overwrite": _sink_overwrite, "sink_append": _sink_append, "src_csv_typed": _csv, "src_csv_rejects": _csv_rejects, "sink_csv_export": _csv_export, **incremental.QUERIES}
