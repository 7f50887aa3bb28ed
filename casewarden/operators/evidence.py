"""One evidence stage per run: what several operators need is computed once, written, and read by all of them.

The fact table is scanned once, by the stage that writes ``transactions``; detectors, network, score and
brief read the written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from casewarden.operators import detectors as D
from casewarden.operators import narrative as X
from casewarden.operators import network as N
from casewarden.operators import reads as R
from casewarden.operators import scoring as S
from casewarden.sources.adapters import Tables


def transactions(t: Tables) -> DataFrame:
    return t.once("transactions", lambda: t["transactions"])


def accounts(t: Tables) -> DataFrame:
    return t.once("accounts", lambda: t["accounts"])


def workers(t: Tables) -> DataFrame:
    return t.once("workers", lambda: D.workers(t["alerts"], transactions(t)))


def steps(t: Tables) -> DataFrame:
    return t.once("steps", lambda: N.transfer_steps(transactions(t)))


def controllers(t: Tables) -> DataFrame:
    return t.once("controllers", lambda: N.controllers(t["alerts"], transactions(t), workers(t), steps(t)))


def members(t: Tables) -> DataFrame:
    return t.once("members", lambda: N.network_members(t["alerts"], transactions(t), 2, workers(t), steps(t)))


def edges(t: Tables) -> DataFrame:
    return t.once("edges", lambda: N.case_network(t["alerts"], transactions(t), t["signals"], members(t), controllers(t)))


def signal_tables(t: Tables) -> dict[str, DataFrame]:
    """Each detector's rows, by its name."""
    tx, alerts = transactions(t), t["alerts"]
    return {
        "WAGE_HARVESTING": D.wage_harvesting(D.onward_transfers(alerts, tx)),
        "ACCOUNT_CONTROL": D.account_control(alerts, accounts(t), t["signals"]),
        "SPENDING_ANOMALY": D.spending_anomaly(D.worker_flows(alerts, tx, workers(t))),
        "GEOGRAPHIC_RISK": D.geographic_risk(D.corridors(alerts, accounts(t), tx, workers(t)), D.foreign_cash(members(t), alerts, accounts(t), tx)),
        "SECTOR_RISK": D.sector_risk(alerts, accounts(t), t["kyc"]),
    }


def signals(t: Tables) -> DataFrame:
    return t.once("signals", lambda: S.all_signals(signal_tables(t)))


def typology_points(t: Tables) -> DataFrame:
    return S.typology_points(t["alerts"], signals(t))


def entities(t: Tables) -> DataFrame:
    return S.case_entities(t["alerts"], edges(t))


def intelligence_points(t: Tables) -> DataFrame:
    return t.once("intelligence", lambda: S.intelligence_points(t["alerts"], entities(t), t["watchlist"]))


def document_points(t: Tables) -> DataFrame:
    return t.once("document_points", lambda: S.document_points(t["alerts"], t["documents"]))


def risk(t: Tables) -> DataFrame:
    return t.once("risk", lambda: S.risk_summary(typology_points(t), intelligence_points(t), document_points(t)))


def brief(t: Tables) -> DataFrame:
    build = lambda: X.case_brief(
        t["alerts"], accounts(t), risk(t), X.signal_text(signals(t)), X.missing_evidence(document_points(t)), X.audit_timeline(t["audit"])
    )
    return t.once("brief", build)


def case_transactions(t: Tables) -> DataFrame:
    return t.once("case_transactions", lambda: R.case_transactions(t["alerts"], edges(t), transactions(t)))
