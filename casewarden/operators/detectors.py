"""Typology detectors: one row per case and signal, thresholds and points as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RISK_SECTORS = ("CONSTRUCTION", "AGRICULTURE", "HOSPITALITY", "LABOUR_SERVICES")


def _case_payroll(alerts: DataFrame, tx: DataFrame) -> DataFrame:
    p = tx.where("transaction_type = 'PAYROLL'").select(
        F.col("from_account_id").alias("account_id"), F.col("to_account_id").alias("worker_id"),
        F.col("transaction_id").alias("payroll_id"), F.col("ts").alias("payroll_ts"), F.col("cents").alias("payroll_cents"),
    )
    return alerts.select("case_id", "account_id").join(p, "account_id")


def workers(alerts: DataFrame, tx: DataFrame) -> DataFrame:
    return _case_payroll(alerts, tx).where("worker_id IS NOT NULL").select("case_id", "worker_id").distinct()


def onward_transfers(alerts: DataFrame, tx: DataFrame, hours: int = 24) -> DataFrame:
    """Wages and the recipient's transfers within ``hours`` after them.

    Keyed by (account, day): a wage is put on every day its window touches, a transfer on its
    own, so each pair meets once and a busy account is spread over its days.
    """
    end = F.col("payroll_ts") + F.make_dt_interval(F.lit(0), F.lit(hours))
    wages = _case_payroll(alerts, tx).withColumn("until", end)
    wages = wages.withColumn("day", F.explode(F.sequence(F.to_date("payroll_ts"), F.to_date("until"))))
    moves = tx.where("transaction_type = 'TRANSFER'").select(
        F.col("from_account_id").alias("worker_id"), F.to_date("ts").alias("day"), F.col("transaction_id").alias("transfer_id"),
        F.col("to_account_id").alias("controller_id"), F.col("ts").alias("transfer_ts"), F.col("cents").alias("transfer_cents"),
    )
    pairs = wages.join(moves, ["worker_id", "day"]).where("transfer_ts BETWEEN payroll_ts AND until")
    gap = F.expr("timestampdiff(HOUR, date_trunc('HOUR', payroll_ts), date_trunc('HOUR', transfer_ts))")
    return pairs.select("case_id", "worker_id", "controller_id", "payroll_id", "transfer_id", "payroll_cents", "transfer_cents", gap.alias("hours"))


def wage_harvesting(onward: DataFrame, min_workers: int = 3, min_ratio: float = 0.70, points: int = 25) -> DataFrame:
    """The ratio is tested after rounding to three places."""
    g = onward.groupBy("case_id").agg(
        F.count_distinct("worker_id").alias("workers"), F.count_distinct("controller_id").alias("controllers"),
        F.round(F.sum("transfer_cents").cast("double") / F.nullif(F.sum("payroll_cents"), F.lit(0)), 3).alias("ratio"),
        F.round(F.avg("hours"), 1).alias("avg_hours"),
    )
    hit = F.coalesce((F.col("workers") >= min_workers) & (F.col("ratio") >= min_ratio), F.lit(False))
    return g.withColumn("detected", hit).withColumn("points", F.when(hit, points).otherwise(0))


def shared_access(signals: DataFrame) -> DataFrame:
    """(device, ip, account, accounts on it) over successful logins, long form: no account lists."""
    seen = signals.where("login_result = 'SUCCESS'").select("device_id", "ip_address", "account_id").distinct()
    return seen.join(_group_sizes(seen), ["device_id", "ip_address"])


def _group_sizes(seen: DataFrame) -> DataFrame:
    return seen.groupBy("device_id", "ip_address").agg(F.count(F.lit(1)).alias("shared_accounts"))


def account_control(alerts: DataFrame, accounts: DataFrame, signals: DataFrame, min_shared: int = 4, points: int = 25) -> DataFrame:
    """Largest login group that any account of the alerted employer is seen on."""
    employer = alerts.select("case_id", "account_id").join(accounts.select("account_id", "employer_id"), "account_id").select("case_id", "employer_id")
    seen = signals.select("account_id", "device_id", "ip_address").distinct()
    sizes = _group_sizes(signals.where("login_result = 'SUCCESS'").select("device_id", "ip_address", "account_id").distinct())
    sized = seen.join(sizes, ["device_id", "ip_address"])
    best = accounts.select("account_id", "employer_id").join(sized, "account_id").groupBy("employer_id").agg(
        F.max(F.struct("shared_accounts", "device_id", "ip_address")).alias("g")
    )
    g = employer.join(best, "employer_id").groupBy("case_id").agg(F.max("g").alias("g")).select("case_id", "g.shared_accounts", "g.device_id", "g.ip_address")
    hit = F.col("shared_accounts") >= min_shared
    return g.withColumn("detected", hit).withColumn("points", F.when(hit, points).otherwise(0))


def worker_flows(alerts: DataFrame, tx: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """What wage recipients (``at``, if known) send, by kind."""
    out = tx.select(F.col("from_account_id").alias("worker_id"), "transaction_type", "cents")
    moved = F.col("transaction_type").isin("TRANSFER", "CASH_WITHDRAWAL")
    at = workers(alerts, tx) if at is None else at
    return at.join(out, "worker_id").groupBy("case_id", "worker_id").agg(
        F.sum(F.when(moved, F.col("cents")).otherwise(0)).alias("moved_cents"),
        F.sum(F.when(F.col("transaction_type") == "CARD", F.col("cents")).otherwise(0)).alias("card_cents"),
        F.sum("cents").alias("outgoing_cents"),
    )


def spending_anomaly(flows: DataFrame, min_ratio: float = 0.80, min_workers: int = 3, points: int = 14) -> DataFrame:
    """The ratio is tested unrounded."""
    ratio = F.col("moved_cents").cast("double") / F.nullif("outgoing_cents", F.lit(0))
    everyday = F.col("card_cents").cast("double") / F.nullif("outgoing_cents", F.lit(0))
    g = flows.groupBy("case_id").agg(
        F.count_if(ratio >= min_ratio).alias("anomalous"), F.round(F.avg(ratio), 3).alias("avg_moved"), F.round(F.avg(everyday), 3).alias("avg_everyday")
    )
    hit = F.col("anomalous") >= min_workers
    return g.withColumn("detected", hit).withColumn("points", F.when(hit, points).otherwise(0))


def corridors(alerts: DataFrame, accounts: DataFrame, tx: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Countries of wage recipients (``at``, if known) other than the employer's."""
    at = workers(alerts, tx) if at is None else at
    home = alerts.select("case_id", "account_id").join(accounts.select("account_id", F.col("country").alias("employer_country")), "account_id")
    away = at.join(accounts.select(F.col("account_id").alias("worker_id"), F.col("country").alias("worker_country")), "worker_id")
    both = home.select("case_id", "employer_country").join(away.select("case_id", "worker_country"), "case_id")
    return both.where("employer_country <> worker_country").distinct()


def foreign_cash(members: DataFrame, alerts: DataFrame, accounts: DataFrame, tx: DataFrame) -> DataFrame:
    home = alerts.select("case_id", "account_id").join(accounts.select("account_id", F.col("country").alias("employer_country")), "account_id").drop("account_id")
    cash = tx.where("transaction_type = 'CASH_WITHDRAWAL'").select(F.col("from_account_id").alias("account_id"), "counterparty_country")
    found = members.join(cash, "account_id").join(home, "case_id").where("counterparty_country <> employer_country")
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("foreign_cash"))


def geographic_risk(pairs: DataFrame, cash: DataFrame, min_countries: int = 3, min_cash: int = 1, points: int = 12) -> DataFrame:
    g = pairs.groupBy("case_id").agg(
        F.count_distinct("worker_country").alias("countries"), F.array_join(F.array_sort(F.collect_set("worker_country")), ",").alias("country_list")
    )
    g = g.join(cash, "case_id", "left").withColumn("foreign_cash", F.coalesce("foreign_cash", F.lit(0)))
    hit = (F.col("countries") >= min_countries) & (F.col("foreign_cash") >= min_cash)
    return g.withColumn("detected", hit).withColumn("points", F.when(hit, points).otherwise(0))


def sector_risk(alerts: DataFrame, accounts: DataFrame, kyc: DataFrame, sectors: tuple[str, ...] = RISK_SECTORS, points: int = 8) -> DataFrame:
    g = alerts.select("case_id", "account_id").join(accounts.select("account_id", "sector"), "account_id").join(kyc, "account_id")
    hit = F.coalesce(F.col("sector").isin(*sectors) & (F.col("owner_status") != "COMPLETE"), F.lit(False))
    g = g.select("case_id", "sector", "owner_status", "declared_employee_count", hit.alias("detected"))
    return g.withColumn("points", F.when(F.col("detected"), points).otherwise(0))
