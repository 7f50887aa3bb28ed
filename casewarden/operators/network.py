"""Case network: members and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewarden.operators.detectors import workers

#: Stands for a cash-out without a target account; it is no account and is never joined as one.
EXTERNAL = "EXTERNAL_CASH"


#: Members of a group that are paired within one task.
TILE = 512


def transfer_steps(tx: DataFrame) -> DataFrame:
    """(account_id, next): accounts and those they ever transferred to."""
    step = tx.where("transaction_type = 'TRANSFER' AND to_account_id IS NOT NULL")
    return step.select(F.col("from_account_id").alias("account_id"), F.col("to_account_id").alias("next")).distinct()


def _next_hop(rows: DataFrame, steps: DataFrame) -> DataFrame:
    return rows.join(steps, "account_id").select("case_id", F.col("next").alias("account_id")).distinct()


def _recipients(alerts: DataFrame, tx: DataFrame, at: DataFrame | None) -> DataFrame:
    return (workers(alerts, tx) if at is None else at).select("case_id", F.col("worker_id").alias("account_id"))


def controllers(alerts: DataFrame, tx: DataFrame, at: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Whom wage recipients (``at``, if known) transfer to."""
    return _next_hop(_recipients(alerts, tx, at), transfer_steps(tx) if steps is None else steps)


def network_members(alerts: DataFrame, tx: DataFrame, hops: int = 2, at: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Wage recipients (``at``, if known) and whoever their transfers reach in ``hops`` steps, once per case."""
    reached = _recipients(alerts, tx, at)
    steps = transfer_steps(tx) if steps is None else steps
    members = reached
    for _ in range(hops):
        reached = _next_hop(reached, steps)
        members = members.unionByName(reached)
    return members.distinct()


def payroll_edges(alerts: DataFrame, tx: DataFrame) -> DataFrame:
    p = tx.where("transaction_type = 'PAYROLL' AND to_account_id IS NOT NULL").select(F.col("from_account_id").alias("source"), F.col("to_account_id").alias("target"), "cents")
    p = p.groupBy("source", "target").agg(F.count(F.lit(1)).alias("event_count"), F.sum("cents").alias("total_cents"))
    e = alerts.select("case_id", F.col("account_id").alias("source")).join(p, "source")
    return e.select("case_id", "source", "target", F.lit("PAYROLL").alias("relationship_type"), "event_count", "total_cents")


def onward_edges(members: DataFrame, control: DataFrame, tx: DataFrame) -> DataFrame:
    out = tx.where("transaction_type = 'CASH_WITHDRAWAL' OR transaction_type = 'TRANSFER' AND to_account_id IS NOT NULL")
    out = out.select(F.col("from_account_id").alias("account_id"), F.coalesce("to_account_id", F.lit(EXTERNAL)).alias("target"), "transaction_type", "cents")
    out = out.groupBy("account_id", "target", "transaction_type").agg(F.count(F.lit(1)).alias("event_count"), F.sum("cents").alias("total_cents"))
    flag = control.select("case_id", "account_id", F.lit(True).alias("controls"))
    kind = F.when(F.col("transaction_type") == "CASH_WITHDRAWAL", "CASH_OUT").when(F.col("controls"), "CONSOLIDATION").otherwise("FUNDS_TO_CONTROLLER")
    e = members.join(flag, ["case_id", "account_id"], "left").join(out, "account_id")
    return e.select("case_id", F.col("account_id").alias("source"), "target", kind.alias("relationship_type"), "event_count", "total_cents")


def pairs_within(rows: DataFrame, group: list[str], member: str, tile: int = TILE) -> DataFrame:
    """Unordered pairs of each group's members, source < target. ``rows`` are distinct; null members have no pairs.

    Members of a large group are dealt to tiles by a hash, and every two tiles (and each tile with
    itself) meet under a key of their own: n members make (n / tile)**2 / 2 keys of at most about
    2 * tile rows, not one of n. A group that fits one tile is one key.
    """
    rows = rows.where(F.col(member).isNotNull())
    size = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    dealt = rows.join(size, group).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_tiles")).cast("int"))
    low = dealt.select(*group, F.col(member).alias("_a"), F.col("_own").alias("_low"), F.explode(F.sequence("_own", F.col("_tiles") - 1)).alias("_high"))
    high = dealt.select(*group, F.col(member).alias("_b"), F.col("_own").alias("_high"), F.explode(F.sequence(F.lit(0), "_own")).alias("_low"))
    pairs = low.join(high, [*group, "_low", "_high"]).where((F.col("_low") < F.col("_high")) | (F.col("_a") < F.col("_b")))
    return pairs.select(*group, F.least("_a", "_b").alias("source"), F.greatest("_a", "_b").alias("target"))


def shared_access_pairs(members: DataFrame, signals: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of a case's members on one device and address, any login result. Output is n (n - 1) / 2
    per case and group of n members: the feature itself, within one case."""
    seen = members.join(signals.select("account_id", "device_id", "ip_address").distinct(), "account_id")
    return pairs_within(seen, ["case_id", "device_id", "ip_address"], "account_id", tile)


def shared_access_edges(members: DataFrame, signals: DataFrame, tile: int = TILE) -> DataFrame:
    """Each pair of a case's members that shares any device and address, once."""
    pairs = shared_access_pairs(members, signals, tile).select("case_id", "source", "target").distinct()
    return pairs.select("*", F.lit("SHARED_DEVICE_IP").alias("relationship_type"), F.lit(1).cast("long").alias("event_count"), F.lit(0).cast("long").alias("total_cents"))


def case_network(alerts: DataFrame, tx: DataFrame, signals: DataFrame, members: DataFrame | None = None, control: DataFrame | None = None) -> DataFrame:
    members = network_members(alerts, tx) if members is None else members
    onward = onward_edges(members, controllers(alerts, tx) if control is None else control, tx)
    return payroll_edges(alerts, tx).unionByName(onward).unionByName(shared_access_edges(members, signals))


def nodes(edges: DataFrame) -> DataFrame:
    """(case_id, account_id): all ends of edges, once."""
    return edges.select("case_id", F.explode(F.array("source", "target")).alias("account_id")).distinct()


def node_roles(edges: DataFrame, alerts: DataFrame) -> DataFrame:
    """The first rule that holds names a node."""
    ends = edges.select(
        "case_id", F.explode(F.array(F.struct(F.col("source").alias("n"), F.lit(False).alias("arrives")), F.struct(F.col("target").alias("n"), F.lit(True).alias("arrives")))).alias("e"), "relationship_type"
    ).select("case_id", F.col("e.n").alias("account_id"), F.when(F.col("e.arrives"), F.col("relationship_type")).alias("into"))
    kinds = {"CASH_OUT": "Cash-out", "CONSOLIDATION": "Funnel", "FUNDS_TO_CONTROLLER": "Controller", "PAYROLL": "Worker"}
    flags = [F.coalesce(F.bool_or(F.col("into") == k), F.lit(False)).alias(k) for k in kinds]
    g = ends.groupBy("case_id", "account_id").agg(*flags)
    first = alerts.select("case_id", "account_id", F.lit(True).alias("primary"))
    g = g.join(first, ["case_id", "account_id"], "left")
    role = F.when(F.col("primary"), "Primary employer").when(F.col("account_id") == EXTERNAL, "Cash-out")
    for k, name in kinds.items():
        role = role.when(F.col(k), name)
    return g.select("case_id", "account_id", role.otherwise("Connected").alias("role"))


def node_labels(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Names; the cash sentinel is labelled apart from the join."""
    n = nodes(edges)
    known = n.where(F.col("account_id") != EXTERNAL).join(accounts.select("account_id", "display_name"), "account_id", "left")
    known = known.select("case_id", "account_id", F.coalesce("display_name", "account_id").alias("label"))
    return known.unionByName(n.where(F.col("account_id") == EXTERNAL).withColumn("label", F.lit("Cash withdrawals")))


def network_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("case_id", "relationship_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("total_cents").alias("total_cents"))
