import duckdb
import pytest

from casewarden.operators import detectors as D
from casewarden.operators import ledgers as L
from casewarden.operators import network as N
from casewarden.plans.registry import BUILD, ORACLE_SQL, QUERIES
from casewarden.sources.adapters import adapters

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def tables(spark, sf):
    return adapters(spark, sf)


#: Given three suppliers' worth of rows, these have nothing to return.
EMPTY = set()


def equal(c, name, df):
    q = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in q.description]
    want = sorted(map(repr, q.fetchall()))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
    assert want or name in EMPTY


@pytest.mark.parametrize("name", sorted(BUILD))
def test_sql(duck, tables, name):
    equal(duck, name, BUILD[name](tables))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(BUILD)))
def test_sql_of_written_tables(spark, sf, duck, name):
    equal(duck, name, QUERIES[name](spark, sf))


@pytest.fixture()
def alerts(spark):
    return spark.createDataFrame([("C1", "E")], "case_id string, account_id string")


def payments(spark, rows):
    schema = "transaction_id string, transaction_type string, ts string, from_account_id string, to_account_id string, cents long, counterparty_country string"
    return spark.createDataFrame([(f"T{i}", *r) for i, r in enumerate(rows)], schema).selectExpr("* except (ts)", "cast(ts as timestamp_ntz) as ts")


def test_window_edges(spark, alerts):
    pay = ("PAYROLL", "2024-01-01 10:30:00", "E", "W", 100, None)
    moves = [("TRANSFER", t, "W", "K", 90, None) for t in ("2024-01-01 10:29:59", "2024-01-01 10:30:00", "2024-01-02 10:30:00", "2024-01-02 10:30:01")]
    got = D.onward_transfers(alerts, payments(spark, [pay, *moves])).select("transfer_id", "hours").collect()
    assert sorted(map(tuple, got)) == [("T2", 0), ("T3", 24)]


@pytest.mark.parametrize(("cents", "n", "hit"), [(69_960, 3, True), (69_940, 3, False), (70_000, 2, False)])
def test_wage_ratio_is_rounded_first(spark, alerts, cents, n, hit):
    rows = [r for i in range(n) for r in (("PAYROLL", "2024-01-01 08:00:00", "E", f"W{i}", 100_000, None), ("TRANSFER", "2024-01-01 09:00:00", f"W{i}", "K", cents, None))]
    assert D.wage_harvesting(D.onward_transfers(alerts, payments(spark, rows))).first().detected is hit


@pytest.mark.parametrize(("moved", "hit"), [(79_990, False), (80_000, True)])
def test_spending_ratio_is_not_rounded(spark, alerts, moved, hit):
    rows = [r for i in range(3) for r in (("PAYROLL", "2024-01-01 08:00:00", "E", f"W{i}", 1, None), ("TRANSFER", "2024-01-01 09:00:00", f"W{i}", "K", moved, None), ("CARD", "2024-01-03 09:00:00", f"W{i}", None, 100_000 - moved, None))]
    assert D.spending_anomaly(D.worker_flows(alerts, payments(spark, rows))).first().detected is hit


def test_cycle_and_cash(spark, alerts):
    rows = [("PAYROLL", "2024-01-01 08:00:00", "E", "W", 10, None), ("TRANSFER", "2024-01-01 09:00:00", "W", "K", 9, None), ("TRANSFER", "2024-01-01 09:00:00", "K", "W", 5, None), ("CASH_WITHDRAWAL", "2024-01-01 09:00:00", "K", None, 4, "X")]
    tx = payments(spark, rows)
    members = N.network_members(alerts, tx)
    assert sorted(r.account_id for r in members.collect()) == ["K", "W"]
    kinds = sorted((r.source, r.target, r.relationship_type) for r in N.onward_edges(members, N.controllers(alerts, tx), tx).collect())
    assert kinds == [("K", "EXTERNAL_CASH", "CASH_OUT"), ("K", "W", "CONSOLIDATION"), ("W", "K", "FUNDS_TO_CONTROLLER")]


def test_replay_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "n"), (3, None, "m")], "k int, v string, w string")
    once = L.merge_upsert(old, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "B", None), (3, None, "m")]
    assert sorted(map(tuple, L.merge_upsert(once, new, ["k"], ["v"]).collect())) == sorted(map(tuple, once.collect()))
    added = L.insert_if_absent(old, new, ["k"])
    assert sorted(map(tuple, L.insert_if_absent(added, new, ["k"]).collect())) == sorted(map(tuple, added.collect()))


def test_plans(spark, sf):
    for name in ("onward_transfers", "case_network", "risk_summary"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
